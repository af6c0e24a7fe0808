"""Multi-class boosted trees grown from histograms that Spark adds up.

Every round fits one tree per class to the gradients of the softmax loss, all
of them level by level at once: one pass over the rows adds up gradients and
hessians by (class, open node, feature, bin), the driver picks the splits.  Its
share is bounded by the model: classes x nodes of a level x features x bins.
Of the two children of a split only the one with fewer rows is added up; the
other is what is left of the parent.  Features of few bins are added up
together, by the values they take at once, and told apart afterwards.

Sums are integers (parts of 2**20), so they do not depend on how rows are
spread or on the order tasks end in: a repeated task, or another number of
executors, gives the same trees.  Rows and features are sampled by hash.  Rows
keep their bins (one byte a feature) and margins, many rows to a block, in a
reliable checkpoint that is renewed every few rounds; in between, tasks add the
newer trees' values.  A round's rows and their gradients are worked out once and
lie on the executors' disks until its trees are grown; lost ones are made anew.

After Friedman, "Greedy function approximation" (2001), and Chen and Guestrin,
"XGBoost" (KDD 2016), whose second-order gain is used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wardline.operators.bitvector import BitVectorScorer, leaf_spans
from wardline.operators.sampling import SEED
from wardline.session import checkpoint_rdd
from wardline.sources.schema import CLASSES

UNIT = 1 << 20  # one, as the sums count it
BLOCK = 1 << 14  # rows of a block
TOGETHER = 1 << 10  # values that features added up together may take at once
EVERY = 16  # one row in so many is counted, to tell which child has fewer
NODES = "tree int, node int, feature int, threshold double, left int, right int, value double"


@dataclass
class BoostedClasses:
    """Trees in the order of rounds and, within a round, of classes."""

    nodes: pd.DataFrame
    features: list[str]
    classes: list[str]
    _scorer: BitVectorScorer | None = None

    def scorer(self) -> BitVectorScorer:
        if self._scorer is None:
            self._scorer = BitVectorScorer(self.nodes, "value")
        return self._scorer

    def on(self, features: list[str]) -> "BoostedClasses":
        """The same trees over other columns."""
        return BoostedClasses(self.nodes, features, self.classes, self.scorer())

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, NODES).write.mode("overwrite").parquet(f"{path}/boosted_nodes")
        spark.createDataFrame([(self.features, self.classes)], "features array<string>, classes array<string>").write.mode(
            "overwrite").json(f"{path}/boosted")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "BoostedClasses | None":
        """The saved model, or None where there is none of this kind."""
        try:
            meta = spark.read.schema("features array<string>, classes array<string>").json(f"{path}/boosted").first()
        except AnalysisException:
            return None
        nodes = spark.read.schema(NODES).parquet(f"{path}/boosted_nodes").toPandas().sort_values(["tree", "node"], ignore_index=True)
        return BoostedClasses(nodes, list(meta["features"]), list(meta["classes"]))


@dataclass
class Tree:
    """A tree over bins while it grows: feature -1 is a leaf, ``slot`` counts the open ones."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    open: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        pair = len(self.feature), len(self.feature) + 1
        self.feature[node], self.cut[node], (self.left[node], self.right[node]) = feature, cut, pair
        for _ in pair:
            for column, empty in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
                column.append(empty)
        return pair

    def reached(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        feature, cut = np.array(self.feature), np.array(self.cut)
        children = np.array([self.left, self.right]).T
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(self.feature) > 1:
            f = feature[at]
            go = f >= 0
            if not go.any():
                break
            side = (x[rows, np.maximum(f, 0)] > cut[at]).astype(np.int64)
            at = np.where(go, children[at, side], at)
        return at


def mixed(*parts) -> np.ndarray:
    """A 64-bit hash of integers."""
    out = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for part in parts:
            out = (out ^ np.asarray(part).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out = out ^ (out >> np.uint64(31))
    return out


def sampled_rows(hashes: np.ndarray, turn: int, share: float) -> np.ndarray:
    return (mixed(hashes, turn) >> np.uint64(11)).astype(np.float64) / 2.0**53 < share


def sampled_features(n: int, turn: int, k: int, share: float, seed: int) -> np.ndarray:
    """Numbers of the features a tree may use."""
    order = np.argsort(mixed(np.arange(n), turn, k, seed), kind="stable")
    return np.sort(order[:max(1, int(np.ceil(share * n)))])


def gradients(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the softmax loss, as integers: [row, class]."""
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    h = np.maximum(2 * p * (1 - p), 1e-6)
    p[np.arange(len(y)), y] -= 1
    return np.rint(p * UNIT), np.rint(h * UNIT)


def best_split(g: np.ndarray, h: np.ndarray, n_cuts: np.ndarray, usable: np.ndarray, l2: float, min_child: float):
    """(gain, feature, cut, left G, left H) of the best split of a node from its [feature, bin] sums, or None.

    Of equal gains the smaller feature and cut win.
    """
    total_g, total_h = g[0].sum(), h[0].sum()
    left_g, left_h = g.cumsum(1)[:, :-1] / UNIT, h.cumsum(1)[:, :-1] / UNIT
    right_g, right_h = total_g / UNIT - left_g, total_h / UNIT - left_h
    gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - (total_g / UNIT)**2 / (total_h / UNIT + l2)
    allowed = np.zeros(gain.shape, bool)
    allowed[usable] = True
    allowed &= (np.arange(gain.shape[1]) < n_cuts[:, None]) & (left_h >= min_child) & (right_h >= min_child)
    gain = np.where(allowed, gain, -np.inf)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    if not gain[f, b] > 1e-9:
        return None
    return float(gain[f, b]), int(f), int(b), int(g[f, :b + 1].sum()), int(h[f, :b + 1].sum())


def bin_cuts(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Where each feature is cut: its values if they are few, else quantiles."""
    number = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features}
    clean = df.select(*[F.when(F.isnan(x), 0.0).otherwise(x).alias(c) for c, x in number.items()])
    few = clean.agg(*[F.approx_count_distinct(c).alias(c) for c in features]).first()
    small = [c for c in features if few[c] <= bins // 2]
    sets = clean.agg(*[F.collect_set(c).alias(c) for c in small]).first() if small else {}
    rest = [c for c in features if c not in small]
    found = clean.approxQuantile(rest, [i / bins for i in range(1, bins)], 1 / (4 * bins)) if rest else []
    values = {**{c: sets[c] for c in small}, **dict(zip(rest, found))}
    return [np.unique(np.array(values[c], float))[:bins - 1] for c in features]


def binned(df: DataFrame, features: list[str], label, row_id: str, cuts: list[np.ndarray], classes: list[str], seed: int) -> RDD:
    """Blocks (h, y, x, m): hashes, classes, bins by feature and zero margins of the rows with a known class."""
    k = len(classes)

    def block(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, y, x = (np.concatenate(p, axis=-1) for p in zip(*parts))
        return whole(h, y, x, names=["h", "y", "x"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(begin, BLOCK)
                values = [np.nan_to_num(rows.column(i + 2).to_numpy(zero_copy_only=False).astype(float), nan=0.0, posinf=np.inf, neginf=-np.inf)
                          for i in range(len(cuts))]
                x = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, values)]).astype(np.uint8)
                if held + rows.num_rows > BLOCK:
                    yield block(parts)
                    parts, held = [], 0
                parts.append((rows.column(0).to_numpy(), rows.column(1).to_numpy().astype(np.int32), x))
                held += rows.num_rows
        if held:
            yield block(parts)

    y = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("int") - 1
    rows = df.select(F.xxhash64(row_id, F.lit(seed)).alias("h"), y.alias("y"),
                     *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(features)])
    made = rows.filter("y >= 0").mapInArrow(cut, "h binary, y binary, x binary").rdd
    return made.map(lambda r: whole(*[np.frombuffer(r[c], np.uint8) for c in ("h", "y", "x")], np.zeros((len(r["h"]) // 8, k)), names=["h", "y", "x", "m"]))


def fixed(rows: np.ndarray) -> pa.Array:
    """Rows as binary values of one size."""
    size = rows.shape[1] * rows.itemsize
    places = (np.arange(len(rows) + 1) * size).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(rows))])


def whole(*arrays: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """One row that holds each array as a value."""
    return pa.RecordBatch.from_arrays([fixed(np.ascontiguousarray(a).reshape(1, -1)) for a in arrays], names)


def matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    """The numbers of a binary column in rows of ``width``; a value holds one row or several."""
    if not len(column) or not width:
        return np.zeros((0, width), kind)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize * width
    return np.frombuffer(column.buffers()[2], kind, count=int(ends[-1] - ends[0]) // size * width, offset=int(ends[0])).reshape(-1, width)


class BinLeaves:
    """The leaf of each row of bins: every test is made on a whole column of bytes, no row walks a tree."""

    def __init__(self, tree: Tree):
        feature, left, right = np.array(tree.feature), np.array(tree.left), np.array(tree.right)
        self.leaves, spans = leaf_spans(feature, left, right)
        self.value = np.array(tree.value)[self.leaves]
        size = {node: end - first for node, first, end in spans}
        self.tests = {node: (tree.feature[node], tree.cut[node], tree.left[node], tree.right[node], n) for node, n in size.items()}
        self.kind = np.uint8 if len(self.leaves) <= 256 else np.uint16 if len(self.leaves) <= 1 << 16 else np.uint32

    def numbers(self, columns: np.ndarray) -> np.ndarray:
        """Numbers of the leaves, from left to right, of [feature, row] bins."""
        out = np.zeros(columns.shape[1], self.kind)
        todo: list[tuple[int, np.ndarray | None]] = [(0, None)] if self.tests else []  # a test, the rows that come to it
        while todo:
            node, here = todo.pop()
            feature, cut, left, right, n = self.tests[node]
            go = columns[feature] > cut
            if here is not None:
                go &= here
            out += go.view(np.uint8) * self.kind(n)
            if right in self.tests:
                todo.append((right, go))
            if left in self.tests:
                todo.append((left, ~go if here is None else here ^ go))
        return out


def bin_scorer(trees: list[Tree]) -> list[BinLeaves] | None:
    return [BinLeaves(t) for t in trees] or None


def margins_of(batch: pa.RecordBatch, x: np.ndarray, k: int, newer: list[BinLeaves] | None, use: np.ndarray | None = None) -> np.ndarray:
    """Margins of the rows, or of those in ``use``, with the newer trees added one after the other."""
    m, columns = matrix(batch.column(3), np.float64, k), x.T
    m, columns = (m.copy(), columns) if use is None else (m[use], columns.take(use, axis=1))
    for i, tree in enumerate(newer or []):
        m[:, i % k] += tree.value[tree.numbers(columns)]
    return m


def round_rows(state: RDD, newer: list[BinLeaves] | None, turn: int, share: float, k: int, n_features: int) -> RDD:
    """Blocks (x, g, h) of the round's rows: bins by feature, gradients and hessians by class."""
    def draw(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks:
            use = np.flatnonzero(sampled_rows(matrix(batch.column(0), np.int64, 1)[:, 0], turn, share))
            if not len(use):
                continue
            x = matrix(batch.column(2), np.uint8, 1).reshape(n_features, -1)
            m = margins_of(batch, x.T, k, newer, use)
            g, h = gradients(np.asfortranarray(m), matrix(batch.column(1), np.int32, 1)[use, 0])
            yield whole(x.take(use, axis=1), g.T.astype(np.int32), h.T.astype(np.int32), names=["x", "g", "h"])

    return state.mapPartitions(draw)


def bundles(n_values: list[int]) -> list[list[int]]:
    """Features that are added up together: at once they take TOGETHER values at most."""
    out: list[list[int]] = []
    sizes: list[int] = []
    for f in sorted(range(len(n_values)), key=lambda f: (-n_values[f], f)):
        at = next((i for i, size in enumerate(sizes) if size * n_values[f] <= TOGETHER), None)
        if at is None:
            out.append([f])
            sizes.append(n_values[f])
        else:
            out[at].append(f)
            sizes[at] *= n_values[f]
    return out


def level_sums(rows: RDD, growing: list[Tree], asked: list[list[int]], usable: list[np.ndarray], n_values: list[int], bins: int) -> np.ndarray:
    """[class, asked node, feature, bin, (gradient, hessian, some of the rows)] over the round's rows."""
    k, n_features = len(growing), len(n_values)
    shape = (k, max(len(a) for a in asked), n_features, bins, 3)
    groups = bundles(n_values)
    sizes = [int(np.prod([n_values[f] for f in group])) for group in groups]
    used = [[i for i, group in enumerate(groups) if set(group) & set(usable[c].tolist())] for c in range(k)]
    leaves = [BinLeaves(t) for t in growing]
    slots = []
    for c, tree in enumerate(leaves):
        at = {node: s for s, node in enumerate(asked[c])}
        slots.append(np.array([at.get(node, -1) for node in tree.leaves]))

    def add(blocks: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        sums = [{i: np.zeros((3, len(asked[c]) * sizes[i])) for i in used[c]} for c in range(k)]
        for batch in blocks:
            x = matrix(batch.column(0), np.uint8, 1).reshape(n_features, -1)
            g, h = (matrix(batch.column(i), np.int32, 1).reshape(k, -1) for i in (1, 2))
            together = []
            for group in groups:
                key = x[group[0]].astype(np.uint16)
                for f in group[1:]:
                    key *= np.uint16(n_values[f])
                    key += x[f]
                together.append(key)
            for c in range(k):
                if not asked[c]:
                    continue
                place = slots[c][leaves[c].numbers(x)]
                held, some = np.flatnonzero(place >= 0), np.flatnonzero(place[::EVERY] >= 0) * EVERY
                some_place = place.take(some)
                every = len(held) == len(place)
                place, gc, hc = (place, g[c].astype(float), h[c].astype(float)) if every else (
                    place.take(held), g[c].take(held).astype(float), h[c].take(held).astype(float))
                for i, out in sums[c].items():
                    where = place * sizes[i]
                    where += together[i] if every else together[i].take(held)
                    n = out.shape[1]
                    out[0] += np.bincount(where, gc, n)  # sums of integers: exact as floats
                    out[1] += np.bincount(where, hc, n)
                    out[2] += np.bincount(some_place * sizes[i] + together[i].take(some), minlength=n)
        out = np.zeros(shape, np.int64)
        for c in range(k):
            for i, found in sums[c].items():
                by_value = found.reshape(3, len(asked[c]), *[n_values[f] for f in groups[i]])
                for j, f in enumerate(groups[i]):
                    one = by_value.sum(axis=tuple(a + 2 for a in range(len(groups[i])) if a != j))
                    out[c, :len(asked[c]), f, :n_values[f]] = one.transpose(1, 2, 0)
        yield out

    return rows.mapPartitions(add).treeReduce(np.add) if rows.getNumPartitions() else np.zeros(shape, np.int64)


def with_margins(state: RDD, newer: list[BinLeaves] | None, k: int, n_features: int) -> RDD:
    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = margins_of(batch, matrix(batch.column(2), np.uint8, 1).reshape(n_features, -1).T, k, newer)
        return pa.RecordBatch.from_arrays([*batch.columns[:3], fixed(m.reshape(1, -1))], ["h", "y", "x", "m"])

    return state.map(add)


def grow(growing: list[Tree], sums: np.ndarray, n_cuts: np.ndarray, usable: list[np.ndarray], step: float, l2: float,
         min_child: float, last: bool) -> list[list[tuple[int, bool]]]:
    """Split the open nodes of each class's tree, or close them as leaves.

    Of each split, in the order of the new open nodes: which sums it is of, and if its left child seems to have fewer rows.
    """
    def weight(g: int, h: int) -> float:
        return -step * (g / UNIT) / (h / UNIT + l2)

    made: list[list[tuple[int, bool]]] = []
    for c, tree in enumerate(growing):
        still, of = [], []
        for s, node in enumerate(tree.open):
            g, h = sums[c, s, :, :, 0], sums[c, s, :, :, 1]
            first = int(usable[c][0])
            total_g, total_h = int(g[first].sum()), int(h[first].sum())
            order = [first, *[f for f in range(len(g)) if f != first]]
            found = best_split(g[order], h[order], n_cuts[order], np.isin(order, usable[c]), l2, min_child) if total_h else None
            if found is None:
                tree.value[node] = weight(total_g, total_h)
                continue
            _, f, cut, left_g, left_h = found
            pair = tree.split(node, order[f], cut)
            for child, a, b in zip(pair, (left_g, total_g - left_g), (left_h, total_h - left_h)):
                tree.value[child] = weight(a, b)
            still += pair
            n = sums[c, s, order[f], :, 2]
            of.append((s, bool(2 * n[:cut + 1].sum() <= n.sum())))
        tree.open = [] if last else still
        made.append([] if last else of)
    return made


def all_sums(found: np.ndarray, before: np.ndarray, made: list[list[tuple[int, bool]]]) -> np.ndarray:
    """Sums of all open nodes: those of the asked children, and what is left of their parents for the others."""
    out = np.zeros((len(made), 2 * found.shape[1], *found.shape[2:]), np.int64)
    for c, of in enumerate(made):
        for j, (s, left) in enumerate(of):
            asked, other = (2 * j, 2 * j + 1) if left else (2 * j + 1, 2 * j)
            out[c, asked], out[c, other] = found[c, j], before[c, s] - found[c, j]
    return out


def fit_boosted(df: DataFrame, features: list[str], label: str = "label", row_id: str = "event_id", rounds: int = 300,
                depth: int = 6, step: float = 0.1, rows: float = 0.8, columns: float = 0.8, bins: int = 64, l2: float = 1.0,
                min_child: float = 1.0, keep: int = 10, classes: list[str] = CLASSES, seed: int = SEED,
                cuts: list[np.ndarray] | None = None) -> BoostedClasses:
    """Rows of unknown classes are left out; missing numbers count as 0.

    ``keep`` is the number of rounds between two checkpoints of the margins.
    """
    if not 2 <= bins <= 256:
        raise ValueError("bins must be between 2 and 256")
    cuts = bin_cuts(df, features, bins) if cuts is None else cuts
    n_cuts, k, n = np.array([len(c) for c in cuts]), len(classes), len(features)
    n_values = [len(c) + 1 for c in cuts]
    state = checkpoint_rdd(df.sparkSession, binned(df, features, label, row_id, cuts, classes, seed))
    trees: list[Tree] = []
    newer: list[Tree] = []
    for turn in range(rounds):
        growing = [Tree() for _ in classes]
        usable = [sampled_features(n, turn, c, columns, seed) for c in range(k)]
        drawn = round_rows(state, bin_scorer(newer), turn, rows, k, n).persist(StorageLevel.DISK_ONLY)
        sums, made = np.zeros(0), []
        for level in range(depth):
            if not any(t.open for t in growing):
                break
            asked = [[t.open[2 * j + (not left)] for j, (_, left) in enumerate(of)] for t, of in zip(growing, made)] if level else [t.open for t in growing]
            found = level_sums(drawn, growing, asked, usable, n_values, bins)
            sums = all_sums(found, sums, made) if level else found
            made = grow(growing, sums, n_cuts, usable, step, l2, min_child, level == depth - 1)
        drawn.unpersist()
        trees += growing
        newer += growing
        if len(newer) >= keep * k and turn + 1 < rounds:
            state, newer = checkpoint_rdd(df.sparkSession, with_margins(state, bin_scorer(newer), k, n)), []
    table = [(i, node, t.feature[node], float(cuts[t.feature[node]][t.cut[node]]) if t.feature[node] >= 0 else 0.0,
              t.left[node], t.right[node], t.value[node]) for i, t in enumerate(trees) for node in range(len(t.feature))]
    return BoostedClasses(pd.DataFrame(table, columns=["tree", "node", "feature", "threshold", "left", "right", "value"]), list(features), list(classes))


def with_probabilities(df: DataFrame, model: BoostedClasses, out: str = "probabilities") -> DataFrame:
    """Add the probabilities of the model's classes, in their order."""
    k = len(model.classes)
    shared = df.sparkSession.sparkContext.broadcast(model.scorer())  # at most rounds x classes x 2**(depth + 1) nodes

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def probabilities(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            p = np.empty((len(x), k))
            for part, values in shared.value.leaf_values(x):
                m = values.reshape(len(values), -1, k).sum(axis=1)
                e = np.exp(m - m.max(axis=1, keepdims=True))
                p[part] = e / e.sum(axis=1, keepdims=True)
            yield pd.Series(list(p))

    vector = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in model.features]
    vector = [F.when(F.isnan(x), 0.0).otherwise(x) for x in vector]
    return df.withColumn(out, probabilities.asNondeterministic()(*vector))
