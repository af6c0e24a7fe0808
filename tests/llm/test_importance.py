import random
import string
import zlib
from collections import Counter
from math import log

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardline.llm import importance as IMP

SCHEMA = "doc_id long, text string, key string, log_weight int"
M = (1 << 64) - 1


def mix(x):
    x = ((x ^ (x >> 31)) * 0x9E3779B97F4A7C15) & M
    return x ^ (x >> 29)


def naive(text, buckets):
    """Buckets of words, runs of ASCII marks, and neighbours."""
    words, run = [], ""
    marks = set(string.punctuation)
    kind = None
    for c in (text or "").lower() + " ":
        now = "blank" if c in " \t\n\v\f\r" else "mark" if c in marks else "word"
        if now != kind and run:
            words.append(run)
            run = ""
        kind = now
        if now != "blank":
            run += c
    code = [zlib.crc32(w.encode()) for w in words]
    return Counter([mix(c) % buckets for c in code] + [mix((mix(a) + b + 1) & M) % buckets for a, b in zip(code, code[1:])])


TEXTS = ["The THE cat, the!! cat", "", None, " ", "a | b &&& c.d É é", "x" * 300, "one\ntwo\tthree ** one", "a_b a'b", "ß ÀB"]


@pytest.mark.parametrize("low", [0, 3])
def test_features(low):
    doc, bucket = IMP.features(pa.array(TEXTS, pa.string())[low:], 1 << 12)
    for i, t in enumerate(TEXTS[low:]):
        assert Counter(bucket[doc == i].tolist()) == naive(t, 1 << 12), t


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = " ".join(f"{rng.choice(words)}!!" if bad else rng.choice(words) for _ in range(rng.randint(5, 80)))
        docs.append((i, text, "x", 1))
        if i % 3:
            labels.append((i, int(not bad), 0))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("chunk", [50, 1 << 20])
def test_weights_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(IMP, "CHUNK", chunk)
    docs, labels = corpus(120)
    docs += [(1, docs[1][1], "x", 1), (None, "w1 w2", "x", 1), (500, None, "x", 1)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    model = IMP.fit(df, spark.createDataFrame(labels, LABELS), buckets=512, prior=3.0)
    good = {i for i, q, _ in labels if q and zlib.crc32(str(i).encode()) % 5}
    target, every = Counter(), Counter()
    for i, t, *_ in docs:
        f = naive(t, 512)
        every += f
        target += f if i in good else Counter()
    share = sum(target.values()) / sum(every.values())
    ratio = {b: log((target[b] + 3) / (every[b] * share + 3)) for b in range(512)}
    assert model.ratio == pytest.approx([ratio[b] for b in range(512)])
    got = IMP.with_weight(df, model.ratio, F.col("doc_id"), F.col("text").alias("t")).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["log_weight"] == pytest.approx(sum(n * ratio[b] for b, n in naive(r["t"], 512).items()), abs=1e-9)


def test_sample_keeps_good_and_drops_bad(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, SCHEMA)
    model = IMP.fit(df, spark.createDataFrame(labels, LABELS), prior=3.0)
    kept = {r["doc_id"] for r in IMP.resample(df, model, F.col("doc_id"), F.col("key").alias("log")).collect()}
    assert all(i in kept for i in range(400) if i % 4) and len([i for i in kept if i % 4 == 0]) < 5
    rows = IMP.accepted(df, model).collect()
    assert {r["doc_id"] for r in rows} == kept and rows[0].asDict().keys() == {"doc_id", "text", "key", "log_weight"}


def test_sample_size_is_the_weights_over_the_cut(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, SCHEMA)
    model = IMP.fit(df, spark.createDataFrame(labels, LABELS), prior=3.0)
    n = IMP.with_weight(df, model.ratio, F.col("doc_id")).filter(F.col("log_weight") >= model.cut).count()
    assert IMP.resample(df, model, F.col("doc_id")).count() == n


def test_repeated_rows_go_together(spark):
    docs, labels = corpus(60)
    df = spark.createDataFrame([*docs, *docs], SCHEMA)
    kept = Counter(r["doc_id"] for r in IMP.resample(df, IMP.fit(df, spark.createDataFrame(labels, LABELS)), F.col("doc_id")).collect())
    assert set(kept.values()) == {2}


def test_without_labels_all_stay(spark):
    df = spark.createDataFrame([*corpus(20)[0], (None, None, None, None)], SCHEMA)
    for labels in ([], [(1, None, 1), (None, 1, 0)], [(1, 1, None), (1, 1, 0)]):
        model = IMP.fit(df, spark.createDataFrame(labels, LABELS))
        assert model.cut == float("-inf") and IMP.accepted(df, model).count() == 21
    empty = df.limit(0)
    assert IMP.resample(empty, IMP.fit(empty, spark.createDataFrame([], LABELS)), F.col("doc_id")).count() == 0


def test_label_rules_and_bound(spark):
    rows = [(1, 1, 0), (1, 0, 0), (2, 1, 1), (3, 1, None), (4, None, 0), (None, 1, 0)]
    got = {tuple(r) for r in IMP.labelled(spark.createDataFrame(rows, LABELS)).collect()}
    assert got == {(1, False), (2, False), (3, True)}
    many = spark.range(5000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert 800 <= IMP.labelled(many, 1000).count() <= 1000


def test_best_cut():
    w, g = np.array([-5.0, -4, -3, 1, 2, 3]), np.array([False, False, True, False, True, True])
    assert IMP.best_cut(w, g, 10) == -3.5 and IMP.best_cut(w, g, 0.01) == 1.5
    assert IMP.best_cut(w, np.ones(6, bool), 10) == float("-inf")


def test_kth_largest(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=3000), np.full(500, 0.25), [1e9, -1e9]])
    df = spark.createDataFrame([(float(v),) for v in values], "key double")
    down = sorted(values.tolist(), reverse=True)
    for k in (1, 2, 700, 1500, 1800, 3502):
        assert IMP.kth_largest(df, k, bins=8, few=10) == down[k - 1]


def test_noise_is_gumbel(spark):
    g = np.array([r[0] for r in spark.range(20000).select(IMP.gumbel(F.col("id"), 5)).collect()])
    assert abs(g.mean() - 0.5772) < 0.03 and abs(g.var() - np.pi**2 / 6) < 0.08


def test_labelled_documents(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # enough labels to learn from
    from wardline.llm.queries import QUERIES

    kept = QUERIES["op5_importance_resampling"](spark, sf_dir).select("doc_id", F.lit(1).alias("kept"))
    got = spark.read.parquet(f"{sf_dir}/labels.parquet").join(kept, "doc_id", "left").groupBy("quality", "toxic").agg(
        F.avg(F.coalesce("kept", F.lit(0)))).collect()
    share = {(r[0], r[1]): r[2] for r in got}
    assert share[1, 0] >= 0.97 and all(s <= 0.5 for k, s in share.items() if k != (1, 0)), share


def shares(spark, labels, kept):
    """Share of the labelled documents that stay, by (quality, toxic)."""
    rows = labels.join(kept.select("doc_id", F.lit(1).alias("kept")), "doc_id", "left").groupBy("quality", "toxic").agg(F.avg(F.coalesce("kept", F.lit(0))))
    return {(q, t): share for q, t, share in rows.collect()}


def test_toxic_documents_of_good_prose_go(spark):
    rng = random.Random(4)
    words, insults = [f"w{i}" for i in range(300)], [f"insult{i}" for i in range(6)]
    docs, labels = [], []
    for i in range(900):
        bad, toxic = i % 4 == 0, i % 7 == 0
        text = [f"{rng.choice(words)}!!" if bad else rng.choice(words) for _ in range(rng.randint(40, 400))]
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(insults).upper()
        docs.append((i, " ".join(text), "x", 1))
        labels.append((i, int(not bad), int(toxic)))
    df, known = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)
    model = IMP.fit(df, known, prior=3.0)
    share = shares(spark, known, IMP.resample(df, model, F.col("doc_id")))
    assert share[1, 0] >= 0.99 and share[1, 1] <= 0.02 and share[0, 0] <= 0.05 and share[0, 1] <= 0.05
    assert shares(spark, known, IMP.accepted(df, model)) == share


def test_toxicity_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(IMP, "CHUNK", 50)
    rows = [("a b b", True), ("a b c", True), ("c d", True), ("b d", False), ("e d", False), (None, False), ("", True)]
    got = IMP.fit_toxicity(spark.createDataFrame(rows, "text string, toxic boolean").repartition(3), 0.1)
    sets = [(set(naive(t, 1 << 64)), x) for t, x in rows]
    want = {}
    for f in set().union(*(s for s, _ in sets)):
        n, other = (sum(f in s for s, x in sets if x == kind) for kind in (True, False))
        if n > 1 and (ratio := log((n + 0.1) / (other * 4 / 3 + 0.1))) > 0:
            want[f] = ratio
    assert dict(zip(got.codes.tolist(), got.ratio.tolist())) == pytest.approx(want) and len(want) == 4


def test_labelled_toxic_documents(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    from wardline.llm.queries import QUERIES

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    share = shares(spark, labels, QUERIES["op5_importance_resampling"](spark, sf_dir))
    assert share[1, 0] >= 0.97 and share[1, 1] <= 0.5 and share[0, 1] <= 0.5
