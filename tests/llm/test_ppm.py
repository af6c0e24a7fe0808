from collections import Counter, defaultdict
from math import log2

import pytest
from pyspark.sql import functions as F

from wardline.llm import ppm as PPM

SCHEMA = "doc_id long, text string, lang string, score string"
ROWS = [(1, "The cat sat on the mat. the hat", "en", "x"), (2, "the the the cat", "en", "x"), (3, "le chat est là", "fr", None),
        (4, "là où est le chat élégant", "fr", "x"), (5, None, "en", "x"), (6, "no label", None, "x"), (7, "", "fr", "x")]


def naive(rows, order=3, share=10**9):
    """Counts by context, then PPM-C with exclusion, byte by byte; contexts below the share of every language are no nodes."""
    seen = defaultdict(lambda: defaultdict(Counter))
    alphabet, kept_of = Counter(), {}
    for _, text, lang, _ in rows:
        if text is None or lang is None:
            continue
        data = b"\0\0\0" + text.lower().encode()
        for i in range(order, len(data)):
            alphabet[data[i]] += 1
            for k in range(order + 1):
                seen[lang][data[i - k:i]][data[i]] += 1
    others = 256 - 1 - len(alphabet)  # zero is never coded
    for lang, trees in seen.items():
        whole = sum(trees[b""].values())
        kept_of[lang] = {c for c, n in trees.items() if sum(n.values()) * share >= whole}
    kept = set().union(*kept_of.values())

    def prob(lang, ctx, sym):
        def dist(ctx):
            if ctx is None:
                return {s: 1 / (len(alphabet) + 1) for s in [*alphabet, "other"]}
            below = dist(ctx[1:] if ctx else None)
            c = seen[lang].get(ctx, Counter()) if ctx in kept else Counter()
            n, u = sum(c.values()), len(c)
            if not n:
                return below
            rest = sum(p for s, p in below.items() if s not in c)
            return {s: c[s] / (n + u) if s in c else u / (n + u) * below[s] / rest for s in below}
        d = dist(ctx)
        return d[sym] if sym in d else d["other"] / others

    def bits(text, lang):
        data = b"\0\0\0" + text.lower().encode()
        return sum(-log2(prob(lang, data[i - order:i], data[i])) for i in range(order, len(data)))
    return bits




@pytest.mark.parametrize("share", [10**9, 4096, 9])
def test_exact_code_lengths(spark, monkeypatch, share):
    df = spark.createDataFrame(ROWS, SCHEMA)
    counts = PPM.context_counts(df)
    model = PPM.train(counts, min_share=share)
    bits = naive(ROWS, share=share)
    for size in (1 << 20, 5):  # texts whole and in parts
        monkeypatch.setattr(PPM, "CHUNK", size)
        for text in ("the chat", "élan zq", "a", "mat the où"):
            got = sum(model.code_lengths(d, s).sum(0) for d, s, _ in PPM.chunked([(0, PPM.clean(text))]))
            assert got == pytest.approx([bits(text, "en"), bits(text, "fr")], rel=1e-5)


def test_parts_count_alike(monkeypatch):
    import numpy as np

    def counted():
        return Counter(c for d, s, _ in PPM.chunked([(0, b"abcdefgh" * 3), (1, b"xyz")]) for c in PPM.grams(d, s).tolist())
    whole = counted()
    monkeypatch.setattr(PPM, "CHUNK", 4)
    assert counted() == whole and sum(whole.values()) == 27
    assert np.uint32(0) not in whole


def test_predictions_and_odd_rows(spark):
    df = spark.createDataFrame([*ROWS, (8, "12 34 !!", "en", "x"), (8, "12 34 !!", "en", "x"), (None, "the cat", None, "x")], SCHEMA)
    model = PPM.train(PPM.context_counts(df))
    got = PPM.predict(df, model, F.col("doc_id"), F.col("score").alias("text")).collect()
    assert len(got) == 10
    by = {r["doc_id"]: r for r in got}
    assert by[1]["lang_pred"] == by[None]["lang_pred"] == "en" and by[4]["lang_pred"] == "fr"
    assert all(by[i]["lang_pred"] == "und" and by[i][2 + 1] == 0 for i in (5, 7, 8))
    assert all(0 <= r[3] <= 1 for r in got)


def test_bounded_nodes(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    model = PPM.train(PPM.context_counts(df), min_share=10)
    assert model.node.max() + 1 <= 1 + 2 * 3 * 10


def test_a_rare_language_keeps_its_contexts(spark, sf_dir):
    """The production setting, against byte-by-byte counts, with a language of 0.2 % of the bytes."""
    english = [(i, r["text"], "en", "x") for i, r in enumerate(spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang = 'en'").limit(60).collect())]
    much = sum(len(t.encode()) for _, t, _, _ in english)
    words = ("čeština žluťoučký kůň úpěl ďábelské ódy " * (much // 20000 + 1))[:much // 500]
    rows = [*english, (900, words, "cs", "x")]
    model = PPM.train(PPM.context_counts(spark.createDataFrame(rows, SCHEMA)))
    bits = naive(rows, share=4096)
    for text in ("žluťoučký kůň", "the old house", "ódy and"):
        got = sum(model.code_lengths(d, s).sum(0) for d, s, _ in PPM.chunked([(0, PPM.clean(text))]))
        assert got == pytest.approx([bits(text, "cs"), bits(text, "en")], rel=1e-5)
    cs = {c for c in naive_contexts(words) if words.lower().encode().count(c) * 4096 >= len(words.encode())}
    assert len(cs) > 20 and all(model.node[index_of(model, c)] > 0 for c in cs)


def naive_contexts(text):
    data = text.lower().encode()
    return {data[i:i + 3] for i in range(len(data) - 3)}


def index_of(model, context):
    a, b, c = model.symbol[list(context)]
    return (a * model.width + b) * model.width + c


def test_nothing_to_learn(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    model = PPM.train(PPM.context_counts(df.limit(0)))
    assert model is None
    assert {r["lang_pred"] for r in PPM.predict(df, model, F.col("doc_id")).collect()} == {"und"}


def test_held_out_accuracy(spark, sf_dir):
    from wardline.llm.queries import QUERIES

    got = QUERIES["op10_ppm_language"](spark, sf_dir)
    lang = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    r = got.join(lang, "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()
    assert r[0] > 0.95
