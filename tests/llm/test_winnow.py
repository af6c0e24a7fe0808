import random
import re

import pytest
from pyspark.sql import functions as F

from wardline.llm import winnow as WN
from wardline.session import checkpoint

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, words string, item int", "item_id long, text string, h long"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def naive(docs, items, window=10):
    out = []
    for name, text, *_ in docs:
        w, hit, ids = words(text), set(), set()
        for item, body, *_ in items:
            b = words(body)
            n = min(window, len(b))
            if not n:
                continue
            grams = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)}
            at = [i for i in range(len(w) - n + 1) if tuple(w[i:i + n]) in grams]
            hit |= {i + j for i in at for j in range(n)}
            if at and item is not None:
                ids.add(str(item))
        out.append((name, len(w), len(hit), tuple(sorted(ids))))
    return sorted(out, key=repr)


def ours(spark, docs, items, **more):
    got = WN.contamination(checkpoint(spark.createDataFrame(docs, DOCS).repartition(3)), spark.createDataFrame(items, ITEMS), **more).collect()
    assert all(r["n_hit"] == len({i for a in r["ranges"] for i in range(a["s"], a["e"])}) for r in got)
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocab = ["a", "b", "c", "the", "É", "x1"]

    def text(n):
        return rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([10, 11, 14, 25])), 1) for i in range(15)]
    items += [(20, "a B c. the", 0), (21, "x1", None), (22, "c c c c c", 1), (23, "b É b É b", 1), (24, "", 1), (25, None, 1),
              (None, text(12), 1), (3, items[3][1], 1), (30, "the " * 40, 1), (200, "q q q q q q q", 2)]
    docs = [(i, text(rng.choice([0, 3, 9, 10, 30, 200])), "w", 1) for i in range(60)]
    for i in range(25):  # planted spans, some cut short
        b = items[i % 15][1]
        docs.append((100 + i, f"{text(15)} {b if i % 3 else b[:len(b) // 2]} {text(9)} {b}", None, 2))
    docs += [(500, "the " * 300, "w", 0), (501, None, "w", 0), (502, "", "w", 0), (None, items[0][1], "w", 0), (100, docs[60][1], "w", 0),
             (100, docs[60][1], "w", 0), (503, "É é " * 8, "w", 0), (504, "Q Q-q q q Q q! \0 q", "w", 0)]
    return docs, items


@pytest.mark.parametrize("limit", [0, 10**6])
def test_against_brute_force(spark, corpus, limit):
    assert ours(spark, *corpus, broadcast_rows=limit) == naive(*corpus)


def test_other_sizes(spark, corpus):
    docs, items = corpus
    assert ours(spark, docs, items, window=6, k=3) == naive(docs, items, 6)


def test_empty_tables(spark, corpus):
    docs, items = corpus
    assert ours(spark, [], items) == []
    assert ours(spark, docs, []) == naive(docs, [])


def test_very_long_text(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = [(1, "z " * 50_000 + item + " y" * 50_000, "w", 1)]
    assert ours(spark, docs, [(1, item, 0)]) == [(1, 100_012, 12, ("1",))]


def test_plan_has_no_python(spark, sf_dir):
    from wardline.llm.queries import QUERIES

    plan = QUERIES["op9_winnowing"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
