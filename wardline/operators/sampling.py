"""Reproducible row choice by hash: exact counts per group, stratified split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wardline.session import checkpoint


SEED = 42
CELL_BITS = 20


def hash_unit(*cols, seed: int = SEED) -> Column:
    """Uniform number in [0, 1) that depends on the values and the seed only."""
    h = F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11)
    return h.cast("double") / F.lit(float(2 ** 53))


def pick_exact(df: DataFrame, group: str, row_id: str, targets: DataFrame,
               seed: int = SEED) -> DataFrame:
    """Mark exactly ``take`` rows of each group in ``picked``, lowest hashes first.

    Counting hash cells finds the one cell per group where the target is
    crossed; only the rows of that cell are ranked.  The resulting cut is one
    row per group, so marking the rows needs no shuffle.  ``targets`` has one
    row per group (group, take); groups are class names.
    """
    h = F.xxhash64(row_id, F.lit(seed))
    keys = df.select(group, F.col(row_id).alias("_id"), h.alias("_h")).withColumn(
        "_cell", F.shiftrightunsigned("_h", 64 - CELL_BITS))
    up_to = W.partitionBy(group).orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)
    cells = keys.groupBy(group, "_cell").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_upto", F.sum("_n").over(up_to))
    edge = (
        cells.join(F.broadcast(targets.select(group, "take")), group)
        .filter(F.col("_upto") >= F.col("take"))
        .groupBy(group).agg(F.min(F.struct("_upto", "_cell", "_n", "take")).alias("e"))
        .select(group, F.col("e._cell").alias("_cell"),
                (F.col("e.take") - (F.col("e._upto") - F.col("e._n"))).alias("_left"))
    )
    order = W.partitionBy(group).orderBy("_h", "_id")
    ranked = keys.join(F.broadcast(edge), [group, "_cell"]).withColumn("_r", F.row_number().over(order))
    cuts = checkpoint(ranked.filter(F.col("_r") <= F.col("_left")).groupBy(group).agg(
        F.max(F.struct("_cell", "_h", "_id")).alias("_cut")))
    row = F.struct(F.shiftrightunsigned(h, 64 - CELL_BITS).alias("_cell"), h.alias("_h"),
                   F.col(row_id).alias("_id"))
    # A target of zero leaves no cut and picks nothing.
    return df.join(F.broadcast(cuts), group, "left").withColumn(
        "picked", F.coalesce(row <= F.col("_cut"), F.lit(False))).drop("_cut")


def stratified_split(df: DataFrame, label: str = "label", row_id: str = "event_id",
                     test_share: float = 0.2, seed: int = SEED) -> DataFrame:
    """``is_test`` marks the share of every class, exact to the row."""
    targets = df.groupBy(label).agg(
        F.round(F.count(F.lit(1)) * F.lit(test_share)).cast("long").alias("take"))
    return pick_exact(df, label, row_id, targets, seed).withColumnRenamed("picked", "is_test")


