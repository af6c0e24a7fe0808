import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from hypothesis import given, settings, strategies as st

from wardline.llm import source_audit as SA
from wardline.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain(docs, least=30, top=50):
    """docs: (text, lang, source)."""
    docs = [((t or "").translate(LOWER), lang or "", s or "") for t, lang, s in docs]
    n, within, of_lang = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        found = TERM.findall(text)
        n[lang, source].update(found)
        of_lang[lang].update(found)
        within[lang].update(set(found))
    out = set()
    for lang, source in {(a, b) for _, a, b in docs}:
        terms = [t for t, d in within[lang].items() if d >= least]
        sources = {b for _, a, b in docs if a == lang}
        v = len(terms)

        def p(counts, t, total):
            return 1 + 10**9 * (counts[t] + 5) // (total + 5 * v)

        total = {s: sum(n[lang, s][t] for t in terms) for s in sources}
        pairs = [(-sum(abs(p(n[lang, source], t, total[source]) - p(n[lang, s], t, total[s])) for t in terms), s.encode()) for s in sources - {source}]
        whole = sum(of_lang[lang][t] for t in terms)
        words = [(p(of_lang[lang], t, whole) - p(n[lang, source], t, total[source]), t.encode()) for t in terms if n[lang, source][t]]
        for part, rows in (("pair", sorted(pairs)), ("term", sorted(w for w in words if w[0] < 0)[:top])):
            out |= {(lang, source, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(rows)}
    return out


def run(spark, docs, **options):
    df = spark.createDataFrame([(t, lang, s, 1, "x") for t, lang, s in docs], "text string, lang string, source string, n long, term string")
    return {tuple(r) for r in SA.audit(df.repartition(3), **options).collect()}


def made(seed, n=200):
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + i % 26)}{'é' * (i // 26)}" for i in range(60)]
    return [(" ".join(rng.choice(words, 12, p=np.arange(1, 61) / 1830)) + (" own" + source) * int(rng.integers(0, 2)), lang, source)
            for lang, source in zip(rng.choice(["en", "de", None], n), rng.choice(["a", "b", "c", "é", ""], n))]


def test_against_plain_counts(spark):
    docs = made(1)
    assert run(spark, docs, least_docs=5, top=7) == plain(docs, 5, 7)


def test_sources_in_blocks(spark, monkeypatch):
    docs = made(2)
    monkeypatch.setattr(SA.distances, "__defaults__", (2, 40))
    monkeypatch.setattr(SA, "BROADCAST_GROUPS", 0)
    assert run(spark, docs, least_docs=3) == plain(docs, 3)


def test_odd_rows(spark):
    docs = [("Ä b1b-B_b", "x", None), ("b b", "x", None), (None, "x", "s"), (None, None, None), ("rare words", "y", "s"), ("", "y", "t"),
            ("long " * 9000 + "b", "x", "s"), ("q" * 30000, "x", "t")]
    got = run(spark, docs, least_docs=2)
    assert got == plain(docs, 2)
    assert ("y", "s", "pair", "t", 0, 1) in got
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert SA.audit(empty).count() == 0


def test_long_texts_are_cut_between_terms(spark, monkeypatch):
    monkeypatch.setattr(SA, "CHUNK", 50)
    docs = [("one two three " * 40, "x", "a"), ("one " + "z" * 300 + " two", "x", "b"), ("two", "x", "b"), ("y" * 200, "x", "a")]
    assert run(spark, docs, least_docs=2) == plain(docs, 2)
    assert run(spark, docs, least_docs=1) == plain(docs, 1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=40), st.integers(1, 4), st.integers(0, 99))
def test_skyband(points, k, seed):
    early = np.random.default_rng(seed).permutation(len(points))
    high, low = (np.array([p[i] for p in points], np.int64) for i in (0, 1))
    dominated = [sum(high[j] >= high[i] and low[j] <= low[i] and early[j] <= early[i] for j in range(len(points)) if j != i) for i in range(len(points))]
    assert SA.skyband(high, low, early, k).tolist() == [i for i, d in enumerate(dominated) if d < k]


def test_skyband_is_small():
    rng = np.random.default_rng(0)
    many = SA.skyband(rng.integers(0, 10**6, 50_000), rng.integers(0, 10**6, 50_000), rng.permutation(50_000), 50)
    assert len(many) < 5000


def test_differences():
    rows = pd.DataFrame({"number": [4, 4, 9], "term": ["a", "b", "b"], "p": [10, 20, 30]})
    sources = pd.DataFrame({"number": [4, 9, 11], "lacking": [1, 2, 5], "block": [0, 0, 0]})
    got = SA.block_differences(rows, sources).to_numpy().tolist()
    assert got == [[4, 9, 8 + 10, 2], [4, 11, 5 + 15, 2], [9, 11, 3 + 25, 2]]


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source").collect()
    assert {tuple(r) for r in QUERIES["op12_dominance_skyband"](spark, sf_dir).collect()} == plain(rows)
    assert "op12_dominance_skyband" in ORACLES
