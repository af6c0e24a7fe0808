"""Minority oversampling between nearest neighbours of the same class.

Neighbours are exact.  A tree of cuts, made from a sample of each class, deals
its points to cells; each block of a cell answers for its own members, then a
point visits another cell only if the box around that cell's points lies closer
than its farthest neighbour so far.  No pairs are materialised: tasks read rows
sorted by block, hold the members of one block and answer its visitors as they
come, so memory does not depend on how many points meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from wardline.operators.sampling import SEED, hash_unit, pick_exact
from wardline.session import checkpoint

K = 3
BLOCK_ROWS = 1024
MAX_CELLS = 8192
CELL_SAMPLE = 4          # sampled points of a class for each of its cells
VISITS = 16              # a block is copied for each VISITS x block_rows visitors
CHUNK = 1000
ROWS_PER_TASK = 1_000_000
POINTS_PER_TASK = 20_000

_NEAR = pa.struct([("dist", pa.float64()), ("id", pa.string()), ("x", pa.list_(pa.float64()))])


def _matrix(cells) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in cells])


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel(), pa.float64()))


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, by direct differences so that copies are exactly 0."""
    out = np.zeros((len(a), len(b)))
    for f in range(a.shape[1]):
        d = a[:, f, None] - b[None, :, f]
        d *= d
        out += d
    return np.sqrt(out, out=out)


def _nearest(q_ids, q, m_ids, m, k, bound=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, distance) of the k nearest members of each query other than itself, within its bound."""
    dist = _distances(q, m)
    codes = np.unique(np.concatenate([q_ids, m_ids]), return_inverse=True)[1]
    dist[codes[:len(q), None] == codes[None, len(q):]] = np.inf
    if bound is not None:
        dist[dist >= np.asarray(bound)[:, None]] = np.inf
    take = min(k, len(m))
    part = np.argpartition(dist, take - 1, axis=1)[:, :take]
    near = np.take_along_axis(dist, part, axis=1)
    row, at = np.nonzero(np.isfinite(near))
    return row, part[row, at], near[row, at]


class Cuts:
    """A tree of cuts over a sample; its leaves are cells, numbered from ``first``."""

    def __init__(self, x: np.ndarray, cells: int, first: int):
        nodes: list[list] = []
        self.n, share = 0, max(1, len(x) // cells)
        todo = [(np.arange(len(x)), None, 0)]
        while todo:
            rows, parent, side = todo.pop()
            if parent is not None:
                nodes[parent][side] = len(nodes)
            # The feature that spreads most, cut at the median or, if that is the largest value, below it.
            values = np.nan_to_num(x[rows], posinf=0.0, neginf=0.0)
            f = int(values.std(axis=0).argmax())
            levels = np.unique(values[:, f])
            if len(rows) < 2 * share or len(levels) < 2 or self.n + len(todo) + 1 >= cells:
                nodes.append([-1, 0.0, first + self.n, -1])
                self.n += 1
                continue
            cut = float(min(np.median(values[:, f]), levels[-2]))
            cut = max(cut, float(levels[0]))
            left = values[:, f] <= cut
            todo += [(rows[~left], len(nodes), 3), (rows[left], len(nodes), 2)]
            nodes.append([f, cut, -1, -1])
        self.feature = np.array([n[0] for n in nodes])
        self.cut = np.array([n[1] for n in nodes])
        self.child = np.array([n[2:] for n in nodes])

    def cell(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows):
            inner = self.feature[at[rows]] >= 0
            rows = rows[inner]
            node = at[rows]
            # What is no number goes right.
            at[rows] = self.child[node, (~(x[rows, self.feature[node]] <= self.cut[node])).astype(int)]
        return self.child[at, 0]


class Boxes:
    """The boxes around the points of a class's cells."""

    def __init__(self, cells: list[int], low: list, high: list, subs: list[int]):
        def numbers(rows, empty):
            return np.array([[empty if v is None else v for v in r] for r in rows], float)

        self.cells, self.subs = np.array(cells), np.array(subs)
        self.low, self.high = numbers(low, np.inf), numbers(high, -np.inf)

    def reached(self, x: np.ndarray, bound: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell) of the cells, other than an uncut own one, that may hold something closer than a point's bound."""
        def gaps(lo, hi, low, high):
            out = np.zeros((len(lo), len(low)))
            for f in range(lo.shape[1]):
                d = np.maximum(low[None, :, f] - hi[:, f, None], lo[:, f, None] - high[None, :, f])
                np.maximum(d, 0.0, out=d)
                out += d * d
            return np.sqrt(out)

        asks = np.flatnonzero(bound > 0)  # nothing is closer than copies of the point
        if not len(asks):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        x, limit = x[asks], bound[asks]
        whole = gaps(np.fmin.reduce(x, axis=0)[None], np.fmax.reduce(x, axis=0)[None], self.low, self.high)[0]
        near = np.flatnonzero((whole - 1e-9 * (1.0 + whole) < limit.max()) & ((self.cells != own) | (self.subs > 1)))
        points, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(near), BLOCK_ROWS):
            some = near[i:i + BLOCK_ROWS]
            d = gaps(x, x, self.low[some], self.high[some])
            row, at = np.nonzero(d - 1e-9 * (1.0 + d) < limit[:, None])  # slack covers rounding
            points.append(asks[row])
            cells.append(self.cells[some[at]])
        return np.concatenate(points), np.concatenate(cells)


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Pieces of equal keys, the first ``n_keys`` columns, of rows that come sorted by them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(n_keys)], axis=1)
        starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
        for a, b in zip(starts[:-1], starts[1:]):
            yield tuple(keys[a].tolist()), batch.slice(int(a), int(b - a))


def _grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """All rows of equal keys."""
    held, pieces = None, []
    for key, piece in _runs(batches, n_keys):
        if key != held and pieces:
            yield held, pa.Table.from_batches(pieces).combine_chunks()
            pieces = []
        held = key
        pieces.append(piece)
    if pieces:
        yield held, pa.Table.from_batches(pieces).combine_chunks()


def _found(ids, x, member, dist) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(dist, pa.float64()), pa.array(ids[member], pa.string()), _lists(x[member])], fields=list(_NEAR))


def nearest_in_class(points: DataFrame, k: int = K, seed: int = SEED,
                     block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(label, id, x) -> (label, id, x, near): exact neighbours within the label."""
    spark = points.sparkSession
    sizes = {r["label"]: r["n"] for r in points.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted, n_cells = F.lit(1), {c: min(MAX_CELLS, max(1, math.ceil(n / block_rows))) for c, n in sizes.items()}
    for label, n in n_cells.items():
        wanted = F.when(F.col("label") == label, n * CELL_SAMPLE).otherwise(wanted)
    order = W.partitionBy("label").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    chosen = (points.withColumn("_r", F.row_number().over(order))
              .filter((F.col("_r") <= MAX_CELLS * CELL_SAMPLE) & (F.col("_r") <= wanted)))
    # At most MAX_CELLS x CELL_SAMPLE vectors per class.
    sample: dict[str, list] = {}
    for label, x in zip(*[c.to_pylist() for c in chosen.select("label", "x").toArrow().columns]):
        sample.setdefault(label, []).append(x)
    cuts: dict[str, Cuts] = {}
    for label in sorted(sample):
        cuts[label] = Cuts(_matrix(sample[label]), n_cells[label], sum(c.n for c in cuts.values()))
    width = len(next(iter(sample.values()))[0]) if sample else 0

    @F.pandas_udf("int")
    def cell_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for labels, xs in batches:
            cell = np.zeros(len(xs), int)
            for label in labels.unique():
                at = np.flatnonzero((labels == label).to_numpy())
                cell[at] = cuts[label].cell(_matrix(xs.iloc[at]))
            yield pd.Series(cell)

    placed = checkpoint(points.select("label", "id", "x", cell_of.asNondeterministic()("label", "x").alias("cell")))

    def ends(f):
        values = [F.get("x", F.lit(i)) for i in range(width)]
        return F.array(*[f(F.when(~F.isnan(v), v)) for v in values])

    # One row per cell.
    cells = checkpoint(placed.groupBy("label", "cell").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("subs"), ends(F.min).alias("low"), ends(F.max).alias("high")))
    by_label: dict[str, list] = {}
    for r in cells.collect():
        by_label.setdefault(r["label"], []).append((r["cell"], r["low"], r["high"], r["subs"]))
    boxes = {}
    for label, rows in by_label.items():
        cell, low, high, subs = zip(*rows)
        boxes[label] = Boxes(cell, low, high, subs)
    shared = spark.sparkContext.broadcast(boxes)
    tasks = max(2 * spark.sparkContext.defaultParallelism, sum(sizes.values()) // POINTS_PER_TASK)
    blocks = placed.join(F.broadcast(cells.select("cell", "subs")), "cell").withColumn(
        "sub", F.pmod(F.xxhash64("id", F.lit(seed + 1)), "subs").cast("int"))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cell, sub), rows in _grouped(batches, 2):
            label = rows["label"][0].as_py()
            ids, x = rows["id"].to_numpy().astype(object), _vectors(rows["x"].combine_chunks())
            row, member, dist = _nearest(ids, x, ids, x, k)
            held = np.bincount(row, minlength=len(ids))
            bound = np.zeros(len(ids))
            np.maximum.at(bound, row, dist)
            bound[held < k] = np.inf
            point, to = shared.value[label].reached(x, bound, cell)
            by_point = np.argsort(point, kind="stable")
            visits = np.bincount(point, minlength=len(ids))
            yield pa.RecordBatch.from_arrays([
                rows["cell"].combine_chunks(), rows["sub"].combine_chunks(), rows["label"].combine_chunks(), rows["id"].combine_chunks(), _lists(x),
                pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(held)]).astype(np.int32), _found(ids, x, member, dist)), pa.array(bound),
                pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(visits)]).astype(np.int32), pa.array(to[by_point], pa.int32())),
            ], ["cell", "sub", "label", "id", "x", "near", "bound", "to_cells"])

    near_type = "struct<dist:double,id:string,x:array<double>>"
    local = checkpoint(blocks.select("cell", "sub", "label", "id", "x").repartition(tasks, "cell", "sub").sortWithinPartitions("cell", "sub").mapInArrow(
        within, f"cell int, sub int, label string, id string, x array<double>, near array<{near_type}>, bound double, to_cells array<int>"))

    visits = (
        local.select("cell", "sub", "label", "id", "x", "bound", F.explode("to_cells").alias("to"))
        .join(F.broadcast(cells.select(F.col("cell").alias("to"), "subs")), "to")
        .withColumn("to_sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
        .filter((F.col("cell") != F.col("to")) | (F.col("sub") != F.col("to_sub")))
        .select(F.col("to").alias("cell"), F.col("to_sub").alias("sub"), "label", "id", "x", "bound"))
    # A popular block is asked by many points: copies of it answer for a bounded number each.
    demand = visits.groupBy("cell", "sub").agg(F.ceil(F.count(F.lit(1)) / F.lit(VISITS * block_rows)).cast("int").alias("packs"))
    visitors = visits.join(demand, ["cell", "sub"]).withColumn("pack", F.pmod(F.xxhash64("id", F.lit(seed + 2)), "packs").cast("int"))
    members = local.select("cell", "sub", "label", "id", "x", F.lit(None).cast("double").alias("bound")).join(demand, ["cell", "sub"]).withColumn(
        "pack", F.explode(F.sequence(F.lit(0), F.col("packs") - 1)))
    columns = ["cell", "sub", "pack", "asks", "label", "id", "x", "bound"]
    meeting = members.withColumn("asks", F.lit(0)).select(*columns).unionByName(visitors.withColumn("asks", F.lit(1)).select(*columns))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, m_ids, m = None, [], []
        for (cell, sub, pack, asks), rows in _runs(batches, 4):
            if (cell, sub, pack) != held:
                held, m_ids, m = (cell, sub, pack), [], []
            ids, x = rows["id"].to_numpy(zero_copy_only=False).astype(object), _vectors(rows["x"])
            if not asks:
                m_ids.append(ids)
                m.append(x)
                continue
            if len(m) > 1:
                m_ids, m = [np.concatenate(m_ids)], [np.concatenate(m)]
            labels, bound = rows["label"], rows["bound"].to_numpy(zero_copy_only=False)
            for i in range(0, len(ids), block_rows):
                part = slice(i, i + block_rows)
                row, member, dist = _nearest(ids[part], x[part], m_ids[0], m[0], k, bound[part])
                if len(row):
                    yield pa.RecordBatch.from_arrays([
                        labels.slice(i, block_rows).take(pa.array(row)), pa.array(ids[part][row], pa.string()), _found(m_ids[0], m[0], member, dist)], ["label", "id", "n"])

    met = meeting.repartition(tasks, "cell", "sub", "pack").sortWithinPartitions("cell", "sub", "pack", "asks").mapInArrow(
        across, f"label string, id string, n {near_type}")
    found = local.select("label", "id", F.explode("near").alias("n")).unionByName(met)
    best = found.groupBy("label", "id").agg(
        F.slice(F.array_sort(F.collect_list("n")), 1, k).alias("near"))
    return local.select("label", "id", "x").join(best, ["label", "id"], "left")


def oversample(train: DataFrame, features: list[str], label: str = "label", row_id: str = "event_id",
               k: int = K, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All classes grown to the majority size; ``synthetic`` marks new rows."""
    vector = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    rows = train.select(F.col(label).alias("label"), F.col(row_id).cast("string").alias("id"), vector.alias("x"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    most, least = max(counts.values()), min(counts.values())
    k = max(1, min(k, least - 1))
    real = rows.select("label", "id", "x", F.lit(False).alias("synthetic"))
    small = {c: n for c, n in counts.items() if n < most}
    if not small:
        return _unpacked(real, features, label, row_id)
    near = checkpoint(nearest_in_class(rows.filter(F.col("label").isin(*small)), k, seed, block_rows))
    # Every row bears the same number of new rows; hash order takes the rest.
    plan = train.sparkSession.createDataFrame(
        [(c, (most - n) // n, (most - n) % n) for c, n in small.items()],
        "label string, each long, take long")
    marked = pick_exact(near, "label", "id", plan.select("label", "take"), seed).join(
        F.broadcast(plan.drop("take")), "label")
    copies = F.col("each") + F.col("picked").cast("int")
    # A few rows grow into many: spread them, in runs of CHUNK copies, before that.
    spark = train.sparkSession
    total = sum(most - n for n in small.values())
    parts = max(2 * spark.sparkContext.defaultParallelism, total // ROWS_PER_TASK)
    last = F.least(copies, (F.col("run") + 1) * CHUNK)
    drawn = (
        marked.filter(copies > 0)
        .withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((copies - 1) / F.lit(CHUNK)))))
        .repartition(parts, "id", "run")
        .withColumn("j", F.explode(F.sequence(F.col("run") * CHUNK + 1, last)))
        .withColumn("_o", F.when(F.size("near") > 0, F.get(
            "near", F.pmod(F.xxhash64("id", "j", F.lit(seed)), F.size("near")).cast("int"))["x"]))
        .withColumn("_o", F.coalesce("_o", "x"))
        .withColumn("_g", hash_unit("id", "j", seed=seed + 3))
    )
    made = drawn.select(
        "label", F.concat_ws("~", "id", "j").alias("id"),
        # Number by number: compiled, where a function over arrays is interpreted.
        F.array(*[F.get("x", F.lit(i)) + (F.get("_o", F.lit(i)) - F.get("x", F.lit(i))) * F.col("_g") for i in range(len(features))]).alias("x"),
        F.lit(True).alias("synthetic"))
    return _unpacked(real.unionByName(made), features, label, row_id)


def _unpacked(df: DataFrame, features: list[str], label: str, row_id: str) -> DataFrame:
    return df.select(F.col("id").alias(row_id), F.col("label").alias(label), "synthetic",
                     *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(features)])
