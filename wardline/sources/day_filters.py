"""Bloom filters that tell which days of the alert table may hold an id.

Every stored batch leaves, for each of its days, a blocked Bloom filter of its
event ids and alert ids beside the table.  A key belongs to one block of 128
bits and sets 12 of them; only blocks with a bit set are rows.  An insert joins
its keys with these rows by block and then reads the days that answer, so first
wins over all days while other days are not opened.  A filter may name a day
that holds none of the keys, which costs a read and changes no result; it never
leaves out a day that does.  A batch with far more than 4 million alerts of one
day (two keys per block) makes its filter answer too often.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BLOCKS = 1 << 22
MARKS = 6     # bits a key sets in each half of its block
SCHEMA = "block int, low bigint, high bigint, day date, batch string"


def filters_path(table: str) -> str:
    return f"{table.rstrip('/')}_filters"


def _marks(code: Column) -> Column:
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, F.shiftright(code, 6 * i).bitwiseAND(63).cast("int")) for i in range(MARKS)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def key_blocks(rows: DataFrame, *keep: str) -> DataFrame:
    """Block and bits of each event id and each alert id; nulls have none."""
    keys = F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")))
                     for k in ("event_id", "id")])
    return (
        rows.select(*keep, F.explode(keys).alias("k")).filter("k IS NOT NULL")
        .select(*keep, F.pmod(F.xxhash64("k.kind", "k.key"), F.lit(BLOCKS)).cast("int").alias("block"),
                _marks(F.xxhash64("k.key", "k.kind", F.lit("low"))).alias("low"),
                _marks(F.xxhash64("k.key", "k.kind", F.lit("high"))).alias("high")))


def write_filters(rows: DataFrame, table: str) -> None:
    """Filters of the (day, batch) parts that ``rows`` are about to fill.

    Written before the rows themselves: a job that dies in between leaves bits
    too many, never too few.
    """
    (key_blocks(rows, "day", "batch").groupBy("day", "batch", "block")
     .agg(F.bit_or("low").alias("low"), F.bit_or("high").alias("high"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day", "batch").parquet(filters_path(table)))


def read_filters(spark: SparkSession, table: str) -> DataFrame:
    try:
        return spark.read.schema(SCHEMA).parquet(filters_path(table))
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA)


def days_that_may_hold(rows: DataFrame, filters: DataFrame) -> list[date]:
    """Days whose filters answer for a key of ``rows``; at most one entry a calendar day."""
    asked = key_blocks(rows).distinct().select("block", F.col("low").alias("_low"), F.col("high").alias("_high"))
    both = (F.col("low").bitwiseAND(F.col("_low")) == F.col("_low")) & (
        F.col("high").bitwiseAND(F.col("_high")) == F.col("_high"))
    found = filters.join(asked, "block").filter(both).select("day").distinct()
    return sorted(r["day"] for r in found.collect())
