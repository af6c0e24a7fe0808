"""Bit-vector scoring against a walk of each tree, and the leaf-box join."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardline.operators import iforest as IF
from wardline.operators.bitvector import BitVectorScorer


def random_tree(rng, tree, n_features, leaves):
    """A tree grown at random leaves; thresholds repeat on purpose."""
    nodes, open_leaves = [[tree, 0, -1, 0.0, -1, -1, rng.normal()]], [0]
    while len(open_leaves) < leaves:
        at = open_leaves.pop(rng.integers(len(open_leaves)))
        pair = [len(nodes), len(nodes) + 1]
        nodes[at][2:6] = [int(rng.integers(n_features)), float(rng.integers(-3, 4)), *pair]
        nodes += [[tree, n, -1, 0.0, -1, -1, rng.normal()] for n in pair]
        open_leaves += pair
    return nodes


def walk(nodes, x):
    at = {(t, n): (f, c, a, b, v) for t, n, f, c, a, b, v in nodes}
    trees = sorted({n[0] for n in nodes})
    out = np.zeros((len(x), len(trees)))
    for i, row in enumerate(x):
        for j, t in enumerate(trees):
            n = 0
            while at[t, n][0] >= 0:
                f, c, a, b, _ = at[t, n]
                n = b if row[f] > c else a
            out[i, j] = at[t, n][4]
    return out


@pytest.mark.parametrize("leaves,table_bytes", [([1, 2, 5, 64], 1 << 20), ([65, 1, 200, 128, 129, 30], 1 << 20), ([70, 300, 3, 64], 1)])
def test_leaves_equal_a_walk(leaves, table_bytes):
    rng = np.random.default_rng(len(leaves))
    nodes = [n for t, k in enumerate(leaves) for n in random_tree(rng, t, 4, k)]
    x = rng.integers(-4, 5, (1300, 4)).astype(float)
    x[::7, 1] += 0.5
    x[5, 2], x[6, 0], x[7, 0] = np.nan, np.inf, -np.inf
    table = pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "v"]).sample(frac=1, random_state=1)
    scorer = BitVectorScorer(table, "v", table_bytes)
    got = np.zeros((len(x), len(leaves)))
    for rows, values in scorer.leaf_values(x):
        got[rows] = values
    assert np.array_equal(got, walk(nodes, x))


def test_forest_scores_equal_boxes(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(f"e{i}", *map(float, v)) for i, v in enumerate(rng.normal(size=(400, 3)).round(1))],
                                 "event_id string, a double, b double, c double")
    forest = IF.fit_forest(rows, ["a", "b", "c"], trees=12, sample=64)
    joined = IF.with_isolation_score(rows, forest).select("event_id", F.col("isolation_score").alias("s")).join(
        IF.scores_by_boxes(rows, forest, "event_id"), "event_id")
    assert joined.count() == 400
    assert joined.agg(F.max(F.abs(F.col("s") - F.col("isolation_score")))).first()[0] < 1e-12


def test_grid_forest_counts_every_row(spark):
    rows = spark.createDataFrame([(f"e{i}", float(i % 50), None if i % 9 == 0 else float(i * i % 31)) for i in range(500)],
                                 "event_id string, a double, b double").repartition(3)
    forest = IF.fit_grid_forest(rows, ["a", "b"], trees=4, depth=2)
    assert forest.sample == 500
    got = {r["event_id"]: r["isolation_score"] for r in IF.with_isolation_score(rows, forest).collect()}
    for r in IF.scores_by_boxes(rows, forest, "event_id").collect():
        assert got[r["event_id"]] == pytest.approx(r["isolation_score"], abs=1e-12)
    empty = IF.fit_grid_forest(rows.limit(0), ["a", "b"], trees=1, depth=1)
    assert IF.with_isolation_score(rows.limit(0), empty).count() == 0
