import zlib
from collections import Counter
from math import exp, log, log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardline.llm import lattice_lm as LM
from wardline.llm.queries import tokenizer_path

VOCAB = {b" ": .1, b" a": .2, b"a": .1, b"b": .1, b"ab": .15, b" ab": .05, b"ba": .1, b"aba": .07, b"\xc3": .02, b"\xa9": .02, b"\xc3\xa9": .09}
PIECES = list(VOCAB)
LOGP = np.log(np.array(list(VOCAB.values())) * 0.9)
SCHEMA = "doc_id long, text string, word string, n long"


def cuts(data):
    if not data:
        return [[]]
    return [[p, *rest] for p in PIECES if data.startswith(p) for rest in cuts(data[len(p):])]


def brute(word):
    """Probability and expected piece counts over all segmentations."""
    lp = dict(zip(PIECES, LOGP))
    ways = [(exp(sum(lp[p] for p in c)), Counter(c)) for c in cuts(b" " + word)]
    z = sum(w for w, _ in ways)
    return log(z), {p: sum(w * c[p] for w, c in ways) / z for p in PIECES}


WORDS = [b"a", b"ab", b"abab", b"babaab", "aéb".encode(), b"aaaaaaa", "éé".encode()]


def test_marginal_and_expected_counts():
    trie = LM.Trie.of(PIECES)
    assert LM.log_probabilities(trie, WORDS, LOGP) == pytest.approx([brute(w)[0] for w in WORDS])
    times = np.arange(1.0, len(WORDS) + 1)
    want = [sum(t * brute(w)[1][p] for t, w in zip(times, WORDS)) for p in PIECES]
    assert LM.Lattice(trie, WORDS).expected(LOGP, times) == pytest.approx(want)
    for w in WORDS:
        assert LM.long_word(trie, w, LOGP) == pytest.approx(brute(w)[0])
    assert sum(LM.long_word(trie, w, LOGP, t) for t, w in zip(times, WORDS)) == pytest.approx(want)


def test_long_words_and_parts(monkeypatch):
    trie = LM.Trie.of(PIECES)
    words = [b"ab" * n for n in (1, 31, 32, 33, 200, 3000)] + WORDS
    want = [LM.long_word(trie, w, LOGP) for w in words]
    for size in (1, 40, 1 << 20):
        monkeypatch.setattr(LM, "LATTICE_BYTES", size)
        assert LM.log_probabilities(trie, words, LOGP) == pytest.approx(want)
    assert LM.log_probabilities(trie, [], LOGP).tolist() == []


def test_vocabulary():
    v = LM.read_vocabulary(tokenizer_path("piece_bpe_32k.model"))
    assert all(bytes([b]) in v for b in range(256) if not 65 <= b <= 90)
    assert all(p and b" " not in p[1:] and p == p.lower() for p in v) and b" the" in v
    assert len(v) > 20000


def test_tokens():
    texts = ["A ab\tABA é", None, "", " ", "\x0b a\x1cb  É\r\nz ", "a\x00b Ａ", "\u2003x"]
    for low in range(len(texts) + 1):  # slices too
        words, doc, ids = LM.tokens(pa.array(texts, pa.string())[low:])
        got = [[words[int(i)].as_py() for i in ids[doc == d]] for d in range(len(texts) - low)]
        assert got == [LM.words_of(t) for t in texts[low:]]


def small_base(rows, train):
    c = Counter(w for _, t in train for w in (t or "").encode().lower().split())
    ends = len(train)
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    return n, {k: (len(ws := (t or "").encode().lower().split()) + 1, sum(w in c for w in ws) + (ends > 0),
                   sum(log10((c[w] + 1) / (n + v + 1)) for w in ws) + log10((ends + 1) / (n + v + 1))) for k, t in rows}


@pytest.mark.parametrize("frequent, chunk", [(1, 10), (1, 1 << 20), (1 << 17, 1 << 20), (1 << 17, 10)])
def test_scores(spark, monkeypatch, frequent, chunk):
    monkeypatch.setattr(LM, "FREQUENT", frequent)
    monkeypatch.setattr(LM, "CHUNK", chunk)
    rows = [(1, "A ab\tABA é"), (2, "ab  ab\nab\x0bbaba É"), (3, None), (4, ""), (5, "zz   new"), (6, "ab " * 300),
            (7, "x" * 500 + " ab"), (8, "a\x00b \x1c c")]
    df = spark.createDataFrame([(*r, "w", 1) for r in [*rows, rows[1], (None, "ab new")]], SCHEMA)
    model = LM.train(df, F.coalesce(F.col("doc_id") < 5, F.lit(False)), LM.read_vocabulary(tokenizer_path("piece_bpe_32k.model")), passes=2)
    got = LM.score(df, model, F.col("doc_id"), F.col("word").alias("base")).collect()
    n, want = small_base([*rows, (None, "ab new")], [r for r in [*rows, rows[1]] if r[0] and r[0] < 5])
    assert len(got) == 10 and sum(r["doc_id"] == 2 for r in got) == 2
    for r in got:
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (*want[r["doc_id"]][:2], n), r
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][2])
        text = dict([*rows, (None, "ab new")])[r["doc_id"]]
        lp = sum(LM.long_word(model.trie, w, model.logp) for w in LM.words_of(text)) + model.log_end
        assert r["score"] == pytest.approx(lp / log(10))
    assert np.exp(model.logp).sum() + exp(model.log_end) == pytest.approx(1)


def test_passes_raise_the_likelihood(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    vocab = LM.read_vocabulary(tokenizer_path("piece_bpe_32k.model"))
    sums = [LM.score(docs, LM.train(docs, F.lit(True), vocab, passes=p, smooth=1e-6), F.col("doc_id")).agg(F.sum("score")).first()[0] for p in (0, 1, 3)]
    assert sums[0] < sums[1] < sums[2] < 0


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    vocab = dict(VOCAB)
    model = LM.train(df, F.lit(True), vocab)
    assert LM.score(df, model, F.col("doc_id")).count() == 0
    some = spark.createDataFrame([(1, "ab a", "w", 1)], SCHEMA)
    r = LM.score(some, model.knowing(some), F.col("doc_id")).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0) and r["score"] < 0


def test_fold_is_crc32(spark):
    from wardline.llm.common import fold

    got = spark.range(50).select("id", fold(F.col("id"), 7).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 7 for r in got)
