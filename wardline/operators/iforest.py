"""Isolation forest: trees grown on small samples, scored in Arrow batches.

After Liu, Ting and Zhou, "Isolation Forest" (ICDM 2008).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from wardline.functions.scalars import path_constant_value
from wardline.operators.bitvector import BitVectorScorer
from wardline.operators.evaluate import score_threshold
from wardline.operators.sampling import SEED, hash_unit
from wardline.session import checkpoint

TREES = 200
SAMPLE = 256
CONTAMINATION = 0.02

NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()),
    T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()),      # -1 on a leaf
    T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()),
    T.StructField("right", T.IntegerType()),
    T.StructField("path", T.DoubleType()),          # path length of a leaf
])


@dataclass
class IsolationForest:
    """Node table (at most trees x 2 x sample rows) and score offset."""

    nodes: DataFrame
    features: list[str]
    sample: int
    offset: float
    _scorer: BitVectorScorer | None = None

    def scorer(self) -> BitVectorScorer:
        """The trees as bit vectors; the nodes are read once."""
        if self._scorer is None:
            self._scorer = BitVectorScorer(self.nodes.toPandas(), "path")
        return self._scorer

    def on(self, features: list[str]) -> "IsolationForest":
        """The same forest over other columns."""
        return IsolationForest(self.nodes, features, self.sample, self.offset, self.scorer())

    def save(self, path: str) -> None:
        spark = self.nodes.sparkSession
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame(
            [(self.features, self.sample, self.offset)],
            "features array<string>, sample int, offset double",
        ).write.mode("overwrite").json(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "IsolationForest":
        meta = spark.read.schema("features array<string>, sample int, offset double").json(
            f"{path}/meta").first()
        nodes = spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes")
        return IsolationForest(nodes, list(meta["features"]), meta["sample"], meta["offset"])


def tree_samples(df: DataFrame, features: list[str], row_id: str, n_rows: int,
                 trees: int, sample: int, seed: int) -> DataFrame:
    """At most ``sample`` rows for each tree, chosen by hash.

    A row is first kept with a probability that leaves about four times the
    rows needed; small tables lend each row to several trees instead.  Its hash
    is not the one a split goes by: training rows have no low hashes there.
    """
    wanted = trees * sample * 4
    keep = min(1.0, wanted / max(n_rows, 1))
    uses = min(trees, math.ceil(wanted / max(n_rows * keep, 1.0)))
    rows = df.select(row_id, F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    if keep < 1.0:
        rows = rows.filter(hash_unit(row_id, F.lit("forest"), seed=seed) < keep)
    turn = F.explode(F.sequence(F.lit(0), F.lit(uses - 1))).alias("turn")
    rows = rows.select(row_id, "x", turn)
    tree = (F.col("turn") if uses == trees
            else F.pmod(F.xxhash64(row_id, "turn", F.lit(seed)), F.lit(trees)).cast("int"))
    placed = rows.withColumn("tree", tree).dropDuplicates(["tree", row_id])
    order = W.partitionBy("tree").orderBy(F.xxhash64(row_id, "tree", F.lit(seed)), row_id)
    return placed.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= sample).select(
        "tree", F.col(row_id).alias("row_id"), "x")


def _grower(sample: int, seed: int):
    limit = math.ceil(math.log2(max(sample, 2)))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        rng = np.random.default_rng([seed, tree])
        x = np.array(pdf.sort_values("row_id")["x"].tolist(), dtype=float)
        out: list[list] = []
        pending = [(np.arange(len(x)), 0, None, None)]
        while pending:
            idx, depth, parent, side = pending.pop()
            node = len(out)
            if parent is not None:
                out[parent][side] = node
            low, high = x[idx].min(axis=0), x[idx].max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth >= limit or len(idx) <= 1 or len(usable) == 0:
                out.append([tree, node, -1, 0.0, -1, -1, depth + path_constant_value(len(idx))])
                continue
            f = int(rng.choice(usable))
            cut = float(rng.uniform(low[f], high[f]))
            goes_left = x[idx, f] <= cut
            if goes_left.all():
                cut = float(low[f])
                goes_left = x[idx, f] <= cut
            out.append([tree, node, f, cut, -1, -1, 0.0])
            pending.append((idx[~goes_left], depth + 1, node, 5))
            pending.append((idx[goes_left], depth + 1, node, 4))
        return pd.DataFrame(out, columns=[f.name for f in NODE_SCHEMA.fields])

    return grow


def fit_forest(df: DataFrame, features: list[str], row_id: str = "event_id", trees: int = TREES,
               sample: int = SAMPLE, contamination: float = CONTAMINATION,
               seed: int = SEED) -> IsolationForest:
    """Grow the trees in parallel; each task sees at most ``sample`` rows per tree."""
    n_rows = df.count()
    psi = max(1, min(sample, n_rows))
    samples = tree_samples(df, features, row_id, n_rows, trees, psi, seed)
    nodes = checkpoint(samples.groupBy("tree").applyInPandas(_grower(psi, seed), NODE_SCHEMA))
    forest = IsolationForest(nodes, features, psi, 0.0)
    scores = with_isolation_score(df, forest)
    forest.offset = float(score_threshold(scores, "isolation_score", contamination).first()[0])
    return forest


def with_isolation_score(df: DataFrame, forest: IsolationForest) -> DataFrame:
    """Add ``isolation_score`` in 0..1 and ``decision`` (higher = more anomalous)."""
    shared = df.sparkSession.sparkContext.broadcast(forest.scorer())  # at most trees x 2 x sample nodes
    scale = path_constant_value(forest.sample) or 1.0

    @F.pandas_udf(T.DoubleType())
    def isolation(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            out = np.empty(len(x))
            for rows, path in shared.value.leaf_values(x):
                out[rows] = np.exp2(-path.mean(axis=1) / scale)
            yield pd.Series(out)

    # Marked non-deterministic so that a filter on the score does not run it twice.
    isolation = isolation.asNondeterministic()
    vector = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in forest.features]
    return df.withColumn("isolation_score", isolation(*vector)).withColumn(
        "decision", F.col("isolation_score") - F.lit(forest.offset))


# --- the same scores as a join ----------------------------------------------------

def leaf_boxes(forest: IsolationForest) -> DataFrame:
    """(tree, path, low, high): the box of every leaf; a row is in it if low < x <= high in every feature."""
    boxes = []
    for tree, nodes in forest.nodes.toPandas().sort_values("node").groupby("tree"):
        rows = nodes.set_index("node")
        todo = [(0, [-math.inf] * len(forest.features), [math.inf] * len(forest.features))]
        while todo:
            node, low, high = todo.pop()
            at = rows.loc[node]
            f, cut = int(at["feature"]), float(at["threshold"])
            if f < 0:
                boxes.append((int(tree), float(at["path"]), low, high))
                continue
            todo.append((int(at["left"]), low, [min(h, cut) if i == f else h for i, h in enumerate(high)]))
            todo.append((int(at["right"]), [max(v, cut) if i == f else v for i, v in enumerate(low)], high))
    spark = forest.nodes.sparkSession
    return spark.createDataFrame(boxes, "tree int, path double, low array<double>, high array<double>")


def scores_by_boxes(df: DataFrame, forest: IsolationForest, row_id: str) -> DataFrame:
    """(row_id, isolation_score) by joining rows to the leaf boxes they lie in.

    The plain relational form; one comparison per row and leaf, for checks.
    """
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in forest.features])
    inside = F.forall(F.arrays_zip("x", "low", "high"), lambda z: (z["x"] > z["low"]) & (z["x"] <= z["high"]))
    paths = df.select(row_id, x.alias("x")).join(F.broadcast(leaf_boxes(forest)), inside).groupBy(row_id).agg(F.avg("path").alias("path"))
    return paths.select(row_id, F.pow(F.lit(2.0), -F.col("path") / F.lit(path_constant_value(forest.sample) or 1.0)).alias("isolation_score"))


def grid_cut(tree: int, node: int, n_features: int) -> tuple[int, float]:
    """Feature and place in its range of a test of a fixed forest; nodes are numbered like a heap from 1."""
    return (3 * tree + 2 * node + tree * node) % n_features, ((7 * tree + 5 * node) % 19 + 0.5) / 19


def fit_grid_forest(df: DataFrame, features: list[str], trees: int = 10, depth: int = 3) -> IsolationForest:
    """A forest without chance: full trees whose tests cut the range of a feature at fixed places.

    Leaf paths count all rows that fall into a leaf, so nothing is sampled.
    """
    ends = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in features for n, f in (("lo", F.min), ("hi", F.max))]).first()
    inner, table = 2 ** depth, []
    for t in range(trees):
        for node in range(1, 2 * inner):
            if node < inner:
                f, share = grid_cut(t, node, len(features))
                low, high = ends[f"lo_{features[f]}"] or 0.0, ends[f"hi_{features[f]}"] or 0.0
                table.append((t, node - 1, f, low + share * (high - low), 2 * node - 1, 2 * node, 0.0))
            else:
                table.append((t, node - 1, -1, 0.0, -1, -1, 0.0))
    spark = df.sparkSession
    nodes = pd.DataFrame(table, columns=NODE_SCHEMA.names)
    # The value of a leaf is its number: rows are counted by tree and leaf, at most trees x 2**depth counts.
    shared = spark.sparkContext.broadcast(BitVectorScorer(nodes.assign(leaf=nodes["node"].astype(float)), "leaf"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for _, leaves in shared.value.leaf_values(rows.to_numpy(float)):
                held, n = np.unique(leaves.astype(np.int64) * trees + np.arange(trees), return_counts=True)
                yield pd.DataFrame({"tree": held % trees, "node": held // trees, "n": n})

    vector = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]
    counts = df.select(*vector).mapInPandas(count, "tree int, node int, n long").groupBy("tree", "node").agg(F.sum("n").alias("n")).collect()
    size = {(r["tree"], r["node"]): r["n"] for r in counts}
    leaf = nodes["feature"] < 0
    nodes.loc[leaf, "path"] = [depth + path_constant_value(size.get((t, n), 0)) for t, n in zip(nodes["tree"][leaf], nodes["node"][leaf])]
    total = sum(n for (t, _), n in size.items() if t == 0)
    return IsolationForest(spark.createDataFrame(nodes, NODE_SCHEMA), features, max(1, total), 0.0)
