import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from wardline.llm import chosen_path as CP
from wardline.llm import shingles as SH
from wardline.llm.common import lean

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, row string, set int"


def shingle_set(text, k=5):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def naive(docs, t=0.8):
    """Links and classes from all pairs."""
    sets = [shingle_set(d[1]) for d in docs]
    n = len(docs)
    links = [[j for j in range(n) if j != i and sets[i] and sets[j]
              and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-9] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i], *(label[j] for j in links[i])]) for i in range(n)]
        if new == label:
            break
        label = new
    ids = defaultdict(list)
    for i, x in enumerate(label):
        ids[x].append(docs[i][0])
    low = {x: min((v for v in vs if v is not None), default=None) for x, vs in ids.items()}
    return Counter((docs[i][0], low[label[i]], len(links[i])) for i in range(n)), len(ids)


def corpus(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 5)))
    text = lambda k: [word() for _ in range(k)]
    docs = []

    def add(words):
        docs.append((len(docs), rng.choice([" ", ", ", "\n"]).join(words), "x", 1))
    common = text(60)
    for _ in range(n):
        base = text(rng.choice([1, 3, 4, 5, 6, 30, 120, 400]))
        add(base)
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = word()
            add(copy)
        if rng.random() < 0.3:
            add(common + text(rng.choice([5, 30, 60])))
    docs += [(900, None, "x", 1), (901, "", "x", 1), (902, " . ! ", "x", 1), (None, docs[0][1], "x", 1), (0, docs[0][1], "x", 1), (None, "alone here", "x", 1)]
    return docs


def found(spark, docs, **options):
    df = CP.checkpoint(spark.createDataFrame(docs, SCHEMA).repartition(4))
    return CP.near_duplicates(df, **options).collect()


@pytest.mark.parametrize("seed, block", [(1, 1024), (2, 3)])
def test_against_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(CP, "BLOCK_SETS", block)
    monkeypatch.setattr(CP, "CHUNK", 500 if block == 3 else 1 << 20)
    docs = corpus(seed)
    rows = found(spark, docs, recall=0.9999)
    want, classes = naive(docs)
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in rows) == want
    assert sum(r["first"] for r in rows) == classes


def test_recall_at_the_limit(spark):
    """Pairs of similarity just over the limit meet with at least about the asked recall."""
    rng = random.Random(3)
    docs = []
    for i in range(300):
        base = [f"w{i}x{j}" for j in range(103)]
        copy = base[:92] + [f"{rng.random()}"] + base[93:]
        docs += [(2 * i, " ".join(base), "x", 1), (2 * i + 1, " ".join([*copy, *(f"n{i}y{j}" for j in range(12))]), "x", 1)]
    j = [len(a & b) / len(a | b) for a, b in ((shingle_set(docs[2 * i][1]), shingle_set(docs[2 * i + 1][1])) for i in range(300))]
    assert 0.8 <= min(j) and max(j) < 0.84
    rows = found(spark, docs, recall=0.99)
    assert sum(r["n_links"] == 1 for r in rows) >= 0.97 * 600


@pytest.mark.parametrize("depth", [3, 4, 6])
def test_plan_reaches_the_recall(depth):
    """Drawn pairs of exactly the similarity: shared coordinates, unequal bits, and buckets level by level."""
    rng = np.random.default_rng(depth)
    n, c = 200_000, CP.COORDINATES
    for recall in (0.99, 0.9999):
        most, runs = CP.plan(depth, recall, 0.8, 24)
        same = rng.binomial(c, 0.8, n)
        found = np.zeros(n, bool)
        for _ in range(runs):
            left = np.flatnonzero(~found)
            shared = np.ones(len(left), np.int64)
            for _ in range(depth):
                shared = rng.binomial(shared * same[left], 1 / (0.8 * c))
            found[left[shared > 0]] = True
        lost = 1 - (found & (rng.binomial(c - same, 0.5) <= most)).mean()
        assert lost <= (1 - recall) + 4 * ((1 - recall) / n)**0.5
        assert CP.missed(depth, runs, 0.8, most) <= 1 - recall


def test_paths_of_a_set_grow_slowly():
    def of(n):
        depth = CP.depth_for(n)
        return CP.plan(depth, 0.9999, 0.8, 24)[1] * 1.25**depth
    assert of(256_410) == of(51_282)
    assert of(15_000_000) <= 1.6 * of(51_282)
    assert of(15_000_000_000) <= 2.5 * of(51_282)


def test_pairs_at_the_limit_are_found_by_default(spark):
    docs = []
    for i in range(600):
        base = [f"w{i}x{j}" for j in range(104)]
        docs += [(2 * i, " ".join(base), "x", 1), (2 * i + 1, " ".join(base[:84]), "x", 1)]  # 100 shingles and 80 of them
    assert sum(r["n_links"] == 1 for r in found(spark, docs)) == 1200


def test_only_texts_of_members_go_to_the_check(spark):
    texts = spark.range(20_000).select(F.col("id").alias("set"), F.concat(F.lit("text "), "id").alias("text"))
    members = texts.filter("set % 200 = 7").select("set", F.lit(1).alias("copies"))
    kept = {r["set"]: r["text"] for r in CP.wanted(texts, members).collect()}
    assert all(kept[i] == f"text {i}" for i in range(7, 20_000, 200))
    assert len(kept) < 110
    assert CP.wanted(texts, members.filter("false")).isEmpty()


def test_one_of_each(spark):
    docs = corpus(4, 15)
    df = CP.checkpoint(spark.createDataFrame(docs, SCHEMA).repartition(3))
    kept = CP.one_of_each(df).collect()
    want, classes = naive(docs)
    assert len(kept) == classes and kept[0].asDict().keys() == {"doc_id", "text", "row", "set"}
    lows = {c for _, c, _ in want}
    assert all(r["doc_id"] in lows for r in kept if r["doc_id"] is not None)


def test_empty_table(spark):
    assert found(spark, []) == [] and found(spark, [(1, None, "", 1)])[0]["n_links"] == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "B", "ç", "d1", "É"]), max_size=12), min_size=1, max_size=5))
def test_shingles_agree(texts):
    raw = [" - ".join(t) for t in texts]
    for low in range(len(raw)):
        sh, many = SH.shingles(*SH.word_codes(pa.array(raw, pa.string())[low:]))
        got = [len(set(x.tolist())) for x in np.split(sh, np.cumsum(many)[:-1])]
        assert got == [len(shingle_set(t)) for t in raw[low:]]


def test_hashes_differ():
    words = [b"a" * n for n in range(1, 40)] + [b"a" * n + b"b" for n in range(40)] + [bytes([i]) for i in range(1, 97)] + [b"", b"\0", b"\0\0"]
    words = sorted(set(words))
    one = SH.hashed(pa.array(words, pa.binary()))
    assert len(set(one.tolist())) == len(words)
    for low in (1, 7):
        assert (SH.hashed(pa.array(words, pa.binary())[low:]) == one[low:]).all()
    assert SH.hashed(pa.array([], pa.binary())).tolist() == []


def test_shared_counts():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 900, rng.integers(0, 400)).astype(np.uint64)) for _ in range(70)]
    got = CP.shared_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(70) for j in range(70) if i != j)


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_groups_of_a_stream(size):
    rng = np.random.default_rng(size)
    keys = np.sort(rng.integers(0, 25, 60))
    table = pa.RecordBatch.from_arrays([pa.array(keys // 5), pa.array(keys % 5), pa.array(np.arange(60))], ["a", "b", "v"])
    batches = [table.slice(i, size) for i in range(0, 60, size)] + [table.slice(60)]
    got = [g.column(2).to_pylist() for g in CP.groups_of(iter(batches), 2)]
    want = [np.flatnonzero(keys == k).tolist() for k in np.unique(keys) if (keys == k).sum() > 1]
    assert got == want


def test_loose_clusters():
    rng = np.random.default_rng(1)
    base = rng.integers(-2**63, 2**63 - 1, (5, 2))
    bits = np.concatenate([base, base ^ np.array([[1, 0]]), base ^ np.array([[3, 8]])])
    label = CP.loose_clusters(bits, 3)
    assert (label[:5] == np.arange(5)).all() and (label[5:10] == np.arange(5)).all() and (label[10:] == np.arange(5)).all()


def test_components(spark):
    rng = random.Random(0)
    for n, m in ((200, 150), (50, 49)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if n == 200 else [(i + 1, i) for i in range(49)]
        links = sorted({(max(p), min(p)) for p in links if p[0] != p[1]})
        label = list(range(n))
        for _ in range(n):
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        got = {r["node"]: r["root"] for r in CP.components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == {i: x for i, x in enumerate(label) if x != i}


def test_runs_and_paths():
    assert CP.runs_needed(3, 0.99) >= 9 and CP.runs_needed(4, 0.99) > CP.runs_needed(3, 0.99)
    rng = np.random.default_rng(0)
    sigs = rng.integers(0, 2**32, (50, CP.COORDINATES)).astype(np.uint32)
    who, bucket = CP.paths(np.concatenate([sigs, sigs]), 0.8, 3, 9)
    for i in range(50):
        assert set(bucket[who == i].tolist()) == set(bucket[who == i + 50].tolist())
    first = CP.paths(sigs, 0.8, 3, 9)
    assert len(set(first[1].tolist())) == len(first[1])  # sets with nothing in common never meet


def test_lean_changes_no_batches():
    def doubled(batches):
        for b in batches:
            if b < 0:
                raise ValueError(b)
            yield 2 * b

    assert list(lean(doubled)(iter([1, 2, 3]))) == [2, 4, 6] and list(lean(doubled)(iter([]))) == []
    with pytest.raises(ValueError):
        list(lean(doubled)(iter([1, -1])))
    early = lean(doubled)(iter([1, 2]))
    assert next(early) == 2
    early.close()  # as a limit does
    assert lean(doubled).__name__ == "doubled"  # plans show the name
