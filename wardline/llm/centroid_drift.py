"""Exact centroid clustering with geometrically tightened bounds.

Lloyd's rounds over integer vectors.  Every vector carries its cluster, its
exact distance to that centroid and a lower bound on its distance to every
other one.  When the centroids move, the members of a cluster lie in a ball
around its old centroid.  For another centroid that moves from p to q, a member
x can come nearer by at most

    |x-p| - |x-q| = 2 (x-m).(q-p) / (|x-p| + |x-q|),   m = (p+q)/2,

and as |x-p| + |x-q| lies between 2|x-m| and 2|x-m| + |q-p|, by the drift |q-p|
times the cosine of the angle at m between the ball and the direction of the
drift: planar geometry of the ball's centre, its radius, and the two places
(Rysavy and Hamerly, "Geometric methods to accelerate k-means algorithms").
A centroid that moves sideways or away costs little or nothing, and may even
raise the bound, where the full drift would always be taken off.  Vectors whose
lower bound is above their distance stay; the others are scanned against all
centroids in exact integers.

The driver holds the centroids, per-cluster counts, component sums and radii:
clusters x components numbers.  Each round is one pass over the vectors without
a shuffle, and partial sums per task are added up by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardline.session import checkpoint

DIM, CLUSTERS, ROUNDS, LEVELS = 64, 16, 3, 64
#: Larger components would give squared distances beyond a long.
LARGEST = 1 << 27
#: Bounds are floats: relative room for what rounding may do to them.
ROOM = 1e-7


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM,
           levels: int = LEVELS) -> DataFrame:
    """(vec_id, vec) of the vectors that take part, as integers floor(levels * x)."""
    v = F.col(vector_col)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * levels < LARGEST))
    return vectors.filter(v.isNotNull() & (F.size(v) == dim) & good).select(
        F.col(id_col).alias("vec_id"),
        F.transform(v, lambda x: F.floor(F.lit(float(levels)) * x.cast("double")).cast("int")).alias("vec"))


def first_centroids(vectors: DataFrame, k: int, salt: str = "1:") -> np.ndarray:
    """The k vectors of smallest hash; equal ids follow their components, null ids come last."""
    rows = (vectors.select(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("h"), "vec")
            .orderBy(F.asc_nulls_last("h"), "vec").limit(k).collect())
    return np.array([r["vec"] for r in rows], np.int64)


def squared(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    largest = max(np.abs(rows).max(initial=0), np.abs(centroids).max(initial=0))
    if rows.shape[1] * (2.0 * largest) ** 2 < 2.0**52:  # every sum below is an exact float
        a, c = rows.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((rows - c) ** 2).sum(1) for c in centroids], axis=1)


def squared_to_own(rows: np.ndarray, centroids: np.ndarray, own: np.ndarray) -> np.ndarray:
    away = rows - centroids[own]
    return np.einsum("ij,ij->i", away, away)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """[a, j]: how much nearer at most centroid j has come to any member of cluster a.

    ``radius[a]`` bounds the distances of the members of a to old[a].
    """
    old, new = old.astype(np.float64), new.astype(np.float64)
    step = new - old
    drift = np.sqrt((step**2).sum(1))
    middle = old + step / 2
    apart = old[:, None, :] - middle[None]  # [a, j]: from the middle of j's way to the ball's centre
    far = np.sqrt((apart**2).sum(2))
    out = np.broadcast_to(drift, far.shape).copy()
    outside = (far > radius[:, None] * (1 + ROOM)) & (drift > 0)
    a, j = np.nonzero(outside)
    cosine = np.clip((apart[a, j] * step[j]).sum(1) / (far[a, j] * drift[j]), -1, 1)
    # The ball is seen from the middle under this angle to each side.
    angle = np.maximum(0.0, np.arccos(cosine) - np.arcsin(np.minimum(1.0, radius[a] / far[a, j])))
    best = np.cos(angle)
    nearest = far[a, j] - radius[a]
    # Coming nearer: the sum of distances is 2|x-m| at least; going away: 2|x-m| + drift at most.
    out[a, j] = drift[j] * np.where(best > 0, best, best / (1 + drift[j] / (2 * nearest)))
    return out + ROOM * (1 + drift + far + radius[:, None])


@dataclass
class Model:
    """Centroids, and what bounds how they moved since the vectors were last seen."""

    centroids: np.ndarray
    #: Per cluster: what is taken off its members' lower bounds, half the distance to the nearest other centroid.
    loosen: np.ndarray | None = None
    half: np.ndarray | None = None

    @classmethod
    def moved(cls, old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> "Model":
        loss = loosening(old, new, radius)
        np.fill_diagonal(loss, -np.inf)
        between = np.sqrt(squared(new, new).astype(np.float64))
        np.fill_diagonal(between, np.inf)
        return cls(new, loss.max(1) if len(new) > 1 else np.zeros(len(new)), between.min(1) / 2)


def assign(rows: np.ndarray, model: Model, own: np.ndarray, lower: np.ndarray, scans: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cluster, squared distance, lower bound on all others, and number of scans of each row."""
    own, lower, scans = own.copy(), lower.copy(), scans.copy()
    if model.loosen is None:
        todo, distance = np.arange(len(rows)), np.zeros(len(rows), np.int64)
    else:
        distance = squared_to_own(rows, model.centroids, own)
        near = np.sqrt(distance.astype(np.float64))
        # Another centroid is also as far from the row as it is from its own, less the row's distance.
        lower = np.maximum(lower - model.loosen[own], (2 * model.half[own] - near) * (1 - ROOM) - ROOM)
        todo = np.flatnonzero(~(near * (1 + ROOM) + ROOM < lower))
    if len(todo):
        found = squared(rows[todo], model.centroids)
        best = found.argmin(1)  # of equal ones the smallest number
        at = np.arange(len(todo))
        own[todo], distance[todo] = best, found[at, best]
        if found.shape[1] > 1:
            found[at, best] = np.iinfo(np.int64).max
            lower[todo] = np.sqrt(found.min(1).astype(np.float64)) * (1 - ROOM)
        else:
            lower[todo] = np.inf
        scans[todo] += 1
    return own, distance, lower, scans


STATE = "vec array<int>, cluster int, distance long, lower double, scans int"


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def one_pass(state: DataFrame, model: Model, dim: int) -> DataFrame:
    """The vectors' state under the moved centroids."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, lower, scans = (batch.column(i).to_numpy() for i in (2, 4, 5))
                own, distance, lower, scans = assign(matrix(batch.column(1), dim), model, own, lower, scans)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(own.astype(np.int32)), pa.array(distance), pa.array(lower),
                     pa.array(scans.astype(np.int32))], names)

    names = ["vec_id", "vec", "cluster", "distance", "lower", "scans"]
    kind = state.schema["vec_id"].dataType.simpleString()
    return checkpoint(state.mapInArrow(step, f"vec_id {kind}, {STATE}"))


def sums(state: DataFrame, k: int, dim: int) -> tuple[list[int], list[list[int]], np.ndarray]:
    """Per cluster: members, exact component sums, and the largest distance."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rows, distance = batch.column(1).to_numpy(), matrix(batch.column(0), dim), batch.column(2).to_numpy()
            order = np.argsort(own, kind="stable")
            held, first = np.unique(own[order], return_index=True)
            if len(held):
                total = np.add.reduceat(rows[order], first, axis=0)
                parts = [pa.array(held), pa.array(np.bincount(own)[held]), pa.array(np.maximum.reduceat(distance[order], first)),
                         pa.ListArray.from_arrays(pa.array((np.arange(len(held) + 1) * dim).astype(np.int32)), pa.array(total.ravel()))]
                yield pa.RecordBatch.from_arrays(parts, ["cluster", "n", "far", "total"])

    parts = state.select("vec", "cluster", "distance").mapInArrow(partial, "cluster int, n long, far long, total array<long>")
    rows = parts.select("cluster", "n", "far", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(
        F.sum("n").alias("n"), F.max("far").alias("far"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    n, total, far = [0] * k, [[0] * dim for _ in range(k)], np.zeros(k)
    for r in rows:  # clusters x components
        n[r["cluster"]], total[r["cluster"]][r["i"]], far[r["cluster"]] = r["n"], int(r["x"]), r["far"]
    return n, total, np.sqrt(far) * (1 + ROOM) + ROOM


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, levels: int = LEVELS,
             salt: str = "1:", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, scans) of every vector that takes part, and the final centroids.

    Vectors that are null, of another length, or hold null or non-finite
    components or ones so large that a squared distance is beyond a long take
    no part.  With fewer than k vectors there are as many clusters; repeated
    rows are vectors of their own; an empty table gives no rows.  ``scans``
    counts the passes in which the bounds did not decide.
    """
    kept = usable(vectors, id_col, vector_col, dim, levels)
    centroids = first_centroids(kept, k, salt)
    state = kept.select("vec_id", "vec", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"),
                        F.lit(0.0).alias("lower"), F.lit(0).alias("scans"))
    if not len(centroids):
        return state.select("vec_id", "cluster", "distance", "scans"), np.zeros((0, dim), np.int64)
    state = one_pass(state, Model(centroids), dim)
    for _ in range(rounds):
        n, total, radius = sums(state, len(centroids), dim)
        new = np.array([[x // n[c] for x in total[c]] if n[c] else centroids[c] for c in range(len(centroids))], np.int64)
        state = one_pass(state, Model.moved(centroids, new, radius), dim)
        centroids = new
    return state.select("vec_id", "cluster", "distance", "scans"), centroids


def report(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The clusters with their inertia and the hash of their centroid's components."""
    spark = found.sparkSession
    own = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(c, int(own.get(c, 0)), int(sum(own.values())), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest())
            for c, x in enumerate(centroids.tolist())]
    stats = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(stats), "cluster")  # one row per cluster
