"""Splitting the timelines of very active users.

A window over one user runs in one task.  Users with more rows than a limit
are therefore cut into time segments of bounded size; each segment receives
copies of the last rows before its start (its halo), so that every look-back of
at most ``depth`` rows sees exactly what it would see on the whole timeline.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F


@dataclass(frozen=True)
class SkewPolicy:
    hot_rows: int = 2_000_000        # a user above this is split
    segment_rows: int = 500_000      # target rows of one segment
    slot_s: int = 60                 # finest cut in time
    max_broadcast_keys: int = 200_000


DEFAULT = SkewPolicy()


@dataclass
class Part:
    """Rows of the log together with the keys that bound one window task."""

    rows: DataFrame
    keys: list[str]
    hot: bool = False


def hot_keys(df: DataFrame, key: str, limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows; counted map-side first."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)


def bounded_hint(df: DataFrame, n_rows: int, policy: SkewPolicy) -> DataFrame:
    """Broadcast only a side that was counted and found small."""
    return F.broadcast(df) if n_rows <= policy.max_broadcast_keys else df


def split_timelines(log: DataFrame, policy: SkewPolicy = DEFAULT, depth: int = 30) -> list[Part]:
    """Parts of the log whose windows are bounded; ``_halo`` rows are context only."""
    hot = hot_keys(log, "user_id", policy.hot_rows).select("user_id")
    n_hot = hot.limit(policy.max_broadcast_keys + 1).count()
    plain = log.withColumn("_halo", F.lit(False))
    if n_hot == 0:
        return [Part(plain, ["user_id"])]
    side = bounded_hint(hot, n_hot, policy)
    cold_rows = plain.join(side, "user_id", "left_anti")
    hot_rows = log.join(side, "user_id", "left_semi")
    return [Part(cold_rows, ["user_id"]),
            Part(_segmented(hot_rows, policy, depth), ["user_id", "_seg"], hot=True)]


def _segmented(log: DataFrame, policy: SkewPolicy, depth: int) -> DataFrame:
    slot = F.floor(F.unix_micros("timestamp") / F.lit(policy.slot_s * 1_000_000)).alias("_slot")
    rows = log.withColumn("_slot", slot)
    per_user = W.partitionBy("user_id")
    # One row per user and non-empty slot: bounded by the time span, not by rows.
    slots = rows.groupBy("user_id", "_slot").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before",
        F.coalesce(F.sum("_n").over(
            per_user.orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    ).withColumn("_seg", F.floor(F.col("_before") / F.lit(policy.segment_rows)))
    segments = slots.groupBy("user_id", "_seg").agg(
        F.min("_before").alias("_start"), F.sum("_n").alias("_size"))
    # Segments that start within ``depth`` rows after a row need that row as halo.
    # Each segment holds at least one row, so at most ``depth`` of them do.
    segments = segments.withColumn("_next", F.collect_list(F.struct("_seg", "_start")).over(
        per_user.orderBy("_seg").rowsBetween(1, depth)))
    tagged = rows.join(slots.select("user_id", "_slot", "_seg"), ["user_id", "_slot"]).drop("_slot")

    latest = W.partitionBy("user_id", "_seg").orderBy(F.desc("timestamp"), F.desc("event_id"))
    tails = tagged.withColumn("_pos", F.row_number().over(latest)).filter(F.col("_pos") <= depth)
    position = F.col("_start") + F.col("_size") - F.col("_pos")
    halo = (
        tails.join(segments, ["user_id", "_seg"])
        .withColumn("_to", F.explode(F.filter(
            "_next", lambda s: s["_start"] <= position + depth)))
        .withColumn("_seg", F.col("_to._seg"))
        .drop("_pos", "_start", "_size", "_next", "_to")
        .withColumn("_halo", F.lit(True))
    )
    return tagged.withColumn("_halo", F.lit(False)).unionByName(halo)
