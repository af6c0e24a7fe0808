import numpy as np
from pyspark.sql import functions as F

from wardline.llm import topk as TK


def brute(rows, k):
    out = set()
    for i, (qid, q) in enumerate(rows):
        if qid is None or qid % 2 or q is None:
            continue
        scored = sorted((-int(np.dot(q, c)), cid) for j, (cid, c) in enumerate(rows)
                        if j != i and cid is not None and c is not None and len(c) == len(q))[:k]
        out |= {(qid, r + 1, cid, -s) for r, (s, cid) in enumerate(scored)}
    return out


def result(df):
    return {tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()}


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    raw = [(i, rng.integers(-4, 5, 6).tolist()) for i in range(300)]
    raw += [(300 + i, [2, 2, 2, 2, 2, 2]) for i in range(40)] + [(400, [0] * 6), (402, [1, 2]), (403, [2, 1])]
    df = spark.createDataFrame([(i, [x / 256 for x in v], "x") for i, v in raw],
                               "vec_id long, embedding array<float>, query string")
    got = TK.top_k(df, F.col("vec_id") % 2 == 0, k=5, block_rows=64, query_rows=50)
    assert result(got) == brute(raw, 5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, None]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, None),
            (None, [9.0, 9.0]), (5, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = TK.top_k(df, F.col("vec_id") % 2 == 0, k=5).collect()
    assert sorted(tuple(r) for r in got) == sorted(2 * [(0, 1, 0, 65536), (0, 2, 5, 32768)])
    assert TK.top_k(df.limit(0), F.col("vec_id") % 2 == 0).count() == 0


def test_stops_early():
    rng = np.random.default_rng(1)
    rows = rng.integers(-50, 50, (4000, 3)).astype(float)
    rows[7] = [500, 500, 500]
    touched = []

    class Watched(np.ndarray):
        def __getitem__(self, i):
            if isinstance(i, np.ndarray) and i.ndim == 1:
                touched.append(len(i))
            return super().__getitem__(i)

    best, _ = TK.threshold_search(rows.view(Watched), np.arange(4000), TK.sorted_lists(rows),
                                  np.array([1.0, 1.0, 1.0]), 1, np.zeros(0, int))
    assert best.tolist() == [7] and sum(touched) < 1000
