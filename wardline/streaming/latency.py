"""Latency percentiles carried over micro-batches by mergeable sketches.

Every micro-batch stores one quantile sketch of its timings for each name, in a
partition that a repeated batch replaces.  Reading merges the sketches, whose
size does not grow with the number of events, so p50/p95/p99 of the whole life of
a stream need no timing to be kept.  A percentile's rank is off by at most
``rank_error`` with 99 % confidence.  Timings that are null or not finite do
not count; a name without timings has no row, a null name is a name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from wardline.sources.stores import read_table

SIZE = 400
PROBABILITIES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
SKETCHES = T.StructType([T.StructField("name", T.StringType()), T.StructField("n", T.LongType()),
                         T.StructField("sketch", T.BinaryType())])


def rank_error(size: int = SIZE) -> float:
    """Normalized rank error of one percentile of a sketch of this size."""
    return 2.296 / size ** 0.9723


def sketches(rows: DataFrame, name: Column, value: Column, size: int = SIZE) -> DataFrame:
    """(name, n, sketch); partial sketches are built before the shuffle."""
    v = value.cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return (rows.filter(finite).groupBy(name.cast("string").alias("name"))
            .agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(v, F.lit(size)).alias("sketch")))


def store(rows: DataFrame, path: str, batch_id: int, name: Column, value: Column, size: int = SIZE) -> None:
    """Keep the sketches of one micro-batch under ``path``."""
    sketches(rows, name, value, size).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def percentiles(spark: SparkSession, path: str, probabilities: dict[str, float] = PROBABILITIES) -> DataFrame:
    """One row per name: n and the percentiles over all stored batches."""
    merged = (read_table(spark, path, SKETCHES).groupBy("name")
              .agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch")))
    return merged.select("name", "n", *[
        F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(c) for c, p in probabilities.items()])


def start_latency(events: DataFrame, path: str, state_path: str, name: Column, value: Column,
                  available_now: bool = False) -> StreamingQuery:
    """Sketch a column of a stream, one partition per micro-batch."""
    def each(batch: DataFrame, batch_id: int) -> None:
        store(batch, path, batch_id, name, value)

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", state_path)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
