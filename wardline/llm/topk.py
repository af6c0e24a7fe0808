"""Exact top-k inner-product search by the threshold algorithm.

Candidates lie in blocks of bounded size.  In a block every dimension has a
list of the rows sorted by its component.  A query goes down the lists of its
non-zero dimensions together, from the end that helps its score, scores each
row it meets for the first time, and stops when the sum of the components it
has reached cannot beat its k-th score (Fagin, Lotem and Naor).  The blocks'
answers are merged by score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wardline.llm.common import numbered
from wardline.session import checkpoint

BLOCK_ROWS, QUERY_ROWS = 8192, 1024


def quantized(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding",
              levels: int = 256) -> DataFrame:
    """(row, id, vec, query): floor(levels * x) of each component as double.

    Rows without id and vectors that are null or hold null or non-finite
    components take no part.
    """
    v, inf = F.col(vector_col), F.lit(float("inf"))
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return numbered(
        vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & usable),
        F.col(id_col).cast("long").alias("id"),
        F.transform(v, lambda x: F.floor(F.lit(float(levels)) * x.cast("double"))).alias("vec"),
        F.coalesce(is_query, F.lit(False)).alias("query"))


def stack(vectors: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, np.int64) for v in vectors], np.int64)


def sorted_lists(rows: np.ndarray) -> np.ndarray:
    """Per dimension the row numbers by rising component, one list a column."""
    return np.argsort(rows, axis=0, kind="stable")


def threshold_search(rows: np.ndarray, ids: np.ndarray, lists: np.ndarray, query: np.ndarray, k: int,
                     skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows (score falling, id rising) that are not in ``skip``.

    rows and query hold integers, as int64 or, where sums stay exact, float64.
    """
    n = len(rows)
    met, best, scores = np.zeros(n, bool), np.zeros(0, np.int64), np.zeros(0, rows.dtype)
    met[skip] = True
    dims = np.flatnonzero(query)
    up = query[dims] < 0
    depth, step = 0, max(8, n // 64)
    while depth < n:
        low, depth, step = depth, min(n, depth + step), step * 2
        fresh = np.zeros(n, bool)
        if len(dims):
            fresh[lists[low:depth, dims[up]]] = True
            fresh[lists[n - depth:n - low, dims[~up]]] = True
        else:  # every score is zero: ids alone decide
            fresh[:] = True
            depth = n
        fresh = np.flatnonzero(fresh & ~met)
        met[fresh] = True
        best, scores = np.concatenate([best, fresh]), np.concatenate([scores, rows[fresh] @ query])
        keep = np.lexsort((ids[best], -scores))[:k]
        best, scores = best[keep], scores[keep]
        if depth < n and len(best) == k:
            last = np.where(up, lists[depth - 1, dims], lists[n - depth, dims])
            if scores[-1] > (query[dims] * rows[last, dims]).sum():
                break
    return best, scores


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id",
          vector_col: str = "embedding", levels: int = 256, block_rows: int = BLOCK_ROWS,
          query_rows: int = QUERY_ROWS) -> DataFrame:
    """Each query row's k best other rows by integer inner product.

    Returns query_id, rank, vec_id, score; ties go to the smaller id.  Rows
    are told apart by place, so a repeated row is a candidate for its copies.
    Only vectors of one length are compared.  Queries and candidates meet in
    pairs of blocks; neither side is broadcast or held whole.
    """
    data = checkpoint(quantized(vectors, is_query, id_col, vector_col, levels))
    counts = data.agg(F.count("*").alias("n"), F.count_if("query").alias("q")).first()
    blocks, groups = max(1, -(-counts["n"] // block_rows)), max(1, -(-counts["q"] // query_rows))
    dim = F.size("vec").alias("dim")

    def spread(df: DataFrame, own: str, parts: int, other: str, copies: int) -> DataFrame:
        return df.select("row", "id", "vec", dim, F.pmod(F.xxhash64("row"), F.lit(parts)).alias(own),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias(other))

    keys = ["dim", "block", "group"]
    left = spread(data, "block", blocks, "group", groups).groupBy(*keys)
    right = spread(data.filter("query"), "group", groups, "block", blocks).groupBy(*keys)

    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or queries.empty:
            return pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")
        a, q = stack(rows["vec"]), stack(queries["vec"])
        lists = sorted_lists(a)
        if float(np.abs(a).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, a.shape[1]) < 2.0**53:
            a, q = a.astype(np.float64), q.astype(np.float64)  # still exact, and faster
        ids, places = rows["id"].to_numpy(), rows["row"].to_numpy()
        out = []
        for i, (place, name) in enumerate(zip(queries["row"], queries["id"])):
            best, scores = threshold_search(a, ids, lists, q[i], k, np.flatnonzero(places == place))
            out.append((np.full(len(best), place), np.full(len(best), name), ids[best], scores.astype(np.int64)))
        return pd.DataFrame(dict(zip(("query", "query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))

    found = left.cogroup(right).applyInPandas(search, "query long, query_id long, vec_id long, score long")
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))

