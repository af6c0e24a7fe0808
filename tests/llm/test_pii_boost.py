import hashlib
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from wardline.llm import pii_boost as PII

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
SCHEMA = "doc_id long, text string, spans string, rest int"


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def naive(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m[0].split(".")),
                    "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


NOTHING = PII.Model([], [], [None] * 4)
ODD = ["", None, "a@b", "a@b.c", "x.a@b.c_d@e.f@g.h", "@@a@b..c", "1.2.3.4.5.6.7.8", "300.1.1.1 001.002.003.255", "1.2.3", "1..2.3.4",
       "4111 1111 1111 1111", "4111-1111-1111-1112", "41111111111111114111111111111111", "+1 (476) 555-3818", "+1 476", "++12 345 678 9012 345",
       "😀 é 10.0.0.1 😀 a@b.co.uk", "a%+-._@x-y.z-w", "+1(212)5551234.", "1" * 3000, "+" * 500 + "1234567890", "a" * 4000, "1 " * 3000, "1.2." * 999,
       "a@b.c" * 300, "5105 1051 0510 5100+1 212 555 1234", "1.1.1.1@2.2.2.2", "\t192.168.0.1\n192.168.0.256", "1-2-3-4 5 6 7 8 9 0 1 2 3 7"]


def base_of(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    rows = PII.find(df, NOTHING).collect()
    assert len(rows) == len(texts)
    return {r["doc_id"]: [tuple(x) for x in r["base"]] for r in rows}


def test_base_spans(spark):
    got = base_of(spark, ODD)
    for i, t in enumerate(ODD):
        assert got[i] == naive(t), t


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("012345@.+- ()aZé😀\n", max_size=60), min_size=60, max_size=60))
def test_base_spans_of_any_text(spark, texts):
    got = base_of(spark, texts)
    assert [got[i] for i in range(len(texts))] == [naive(t) for t in texts]


def card(rng):
    d = "4" + "".join(str(rng.randint(0, 9)) for _ in range(14))
    return next(d + str(i) for i in range(10) if luhn(d + str(i)))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    w = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs = []
    for i in range(400):
        c, n = card(rng), rng.randint
        docs.append((i, rng.choice([
            f"{w()} write to {w()}.{n(1, 99)}@{w()}.example.com, {w()}", f"{w()} host {n(1, 255)}.{n(0, 255)}.{n(0, 255)}.{n(0, 255)} {w()}",
            f"{w()} version {n(300, 900)}.{n(0, 9)}.{n(0, 9)}.{n(0, 9)} {w()}", f"{w()} pays {c[:4]} {c[4:8]} {c[8:12]} {c[12:]} {w()}",
            f"{w()} order {int(c) + 1} {w()}", f"{w()} call +1 ({n(200, 999)}) 555-{n(1000, 9999)} {w()}", f"{w()} {n(10, 99)} {n(10000000, 99999999)}0 {w()}",
            f"{w()} {w()}@{w()} {w()}", f"{w()}"]), "x", 1))
    return docs, w, rng


@pytest.fixture(scope="module")
def model(spark, corpus):
    return PII.train(spark.createDataFrame(corpus[0], SCHEMA).repartition(3), precision=0.9)


def test_added_spans(spark, corpus, model):
    docs, w, rng = corpus
    c = card(rng)
    texts = [f"{w()} {c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]} {w()}", f"{w()} 45.josé@{w()}.example.com, {w()}", f"{w()} {int(c) + 1} {w()}", docs[0][1]]
    rows = {r["doc_id"]: r for r in PII.find(spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA), model).collect()}
    found = {i: [(PII.KINDS[x["kind"]], texts[i][x["s"]:x["e"]]) for x in r["added"]] for i, r in rows.items()}
    assert ("card", texts[0].split()[1]) in found[0] and found[2] == [] and found[3] == []
    assert ("email", texts[1].split()[1].rstrip(",")) in found[1]


def test_training_is_by_all_documents(spark, corpus, model):
    assert model.trees and all(t is None or 0.5 <= t < 1 for t in model.thresholds)
    rows = PII.examples(spark.createDataFrame(corpus[0], SCHEMA), "doc_id", "text")
    assert rows.agg(F.sum(F.col("y") * F.col("n"))).first()[0] == sum(len(naive(d[1])) for d in corpus[0])


def test_base_stays_and_added_touch_none(spark, corpus, model):
    docs = corpus[0]
    for r in PII.find(spark.createDataFrame([*docs, *docs[:3], (None, docs[1][1], "x", 1)], SCHEMA), model).collect():
        base = [tuple(x) for x in r["base"]]
        assert base == naive(r["text"])
        assert not [x for x in r["added"] for s, _, e in base if x["s"] < e and s < x["e"]]


def test_empty_table_and_no_examples(spark):
    df = spark.createDataFrame([], SCHEMA)
    m = PII.train(df)
    assert m.thresholds == [None] * 4 and PII.find(df, m).count() == 0


def test_redaction(spark):
    text = "x a@b.co y 10.0.0.1@z.org é +1 212 555 1234"
    df = PII.find(spark.createDataFrame([(1, text, "", 1)], SCHEMA), NOTHING)
    got = df.select(PII.redacted(F.col("text"), F.transform("base", lambda x: F.struct(
        x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))), "#").alias("t")).first()["t"]
    assert got == "x # y # é #"


def test_query(spark, sf_dir):
    from wardline.llm.queries import QUERIES

    got = QUERIES["op2_boosted_pii"](spark, sf_dir)
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())
    texts = dict(tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = naive(texts[r["doc_id"]])
        line = ",".join(f"{PII.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PII.KINDS] == [sum(x[1] == i for x in base) for i in range(4)]
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))
