"""Look-back features of each event: breadth, rapid failures, travel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from wardline.functions.scalars import clip, haversine_km
from wardline.operators.hotkeys import DEFAULT, Part, SkewPolicy, split_timelines

LOOKBACK_ROWS = 30
FAILURE_WINDOW_S = 120
MAX_SPEED_KMH = 800.0
SPEED_CAP_KMH = 20000.0
MIN_HOURS = 1e-6

CONTEXT_COLUMNS = [
    "session_resource_count", "rapid_failure_count", "travel_speed_kmh",
    "is_impossible_travel", "city_changed",
]


def add_context(part: Part, depth: int = LOOKBACK_ROWS,
                failure_window_s: int = FAILURE_WINDOW_S) -> DataFrame:
    """Context columns of one part.

    Events at the same instant must not see one another.  The frame of the
    first row of a tie group holds exactly the rows before the group, so its
    context is computed once and shared with the rest of the group.  All
    windows use one clustering and one sort order.
    """
    by_time = W.partitionBy(*part.keys).orderBy("timestamp", "event_id")
    tie_rank = W.partitionBy(*part.keys).orderBy("timestamp")
    tie_group = W.partitionBy(*part.keys, "timestamp")
    entry = F.struct(
        F.col("_us").alias("us"), F.col("resource_accessed").alias("resource"),
        F.when(~F.col("success"), F.col("source_ip")).alias("failed_ip"))
    rows = (
        part.rows.withColumn("_us", F.unix_micros("timestamp"))
        .withColumns({
            "_prior": F.collect_list(entry).over(by_time.rowsBetween(-depth, -1)),
            "_prev": F.lag(F.struct("geo_city", "geo_lat", "geo_lon", "_us")).over(by_time),
            "_rn": F.row_number().over(by_time),
            "_rk": F.rank().over(tie_rank),
        })
    )
    since = F.col("_us") - F.lit(failure_window_s * 1_000_000)
    seen = F.struct(
        F.size(F.array_distinct(F.transform("_prior", lambda e: e["resource"]))).alias("breadth"),
        F.transform(
            F.filter("_prior", lambda e: e["failed_ip"].isNotNull() & (e["us"] >= since)),
            lambda e: e["failed_ip"]).alias("failed_ips"),
    )
    rows = rows.withColumn("_seen", F.when(F.col("_rn") == F.col("_rk"), seen)).withColumn(
        "_seen", F.first("_seen", ignorenulls=True).over(tie_group))

    prev, speed = F.col("_prev"), F.col("_speed")
    hours = F.greatest((F.col("_us") - prev["_us"]) / F.lit(3.6e9), F.lit(MIN_HOURS))
    distance = haversine_km(prev["geo_lat"], prev["geo_lon"], "geo_lat", "geo_lon")
    return (
        rows.filter(~F.col("_halo"))
        .withColumn("_speed", F.coalesce(distance / hours, F.lit(0.0)))
        .withColumns({
            "session_resource_count": F.col("_seen.breadth") + 1,
            "rapid_failure_count": F.size(F.filter(
                "_seen.failed_ips", lambda ip: ip == F.col("source_ip"))),
            "travel_speed_kmh": clip(speed, 0.0, SPEED_CAP_KMH),
            "is_impossible_travel": (speed > MAX_SPEED_KMH).cast("int"),
            "city_changed": F.coalesce(prev["geo_city"] != F.col("geo_city"), F.lit(False)).cast("int"),
        })
        .drop("_us", "_prior", "_prev", "_rn", "_rk", "_seen", "_speed", "_halo", "_seg")
    )


def timelines(log: DataFrame, alerts: DataFrame, minutes: int = 60, depth: int = LOOKBACK_ROWS,
              policy: SkewPolicy = DEFAULT) -> DataFrame:
    """The session context of each alert: the events before it, one row each.

    The look-back is the one of the features, ``depth`` events strictly before
    the alert, cut to the last ``minutes``.  Events learn of their alerts before
    the windows, so that no shuffle carries look-backs.
    """
    marks = alerts.filter("event_id IS NOT NULL").groupBy("event_id").agg(F.collect_list(F.struct("id")).alias("_alerts"))
    marked = log.select("event_id", "user_id", "timestamp", "action", "resource_accessed", "success").join(marks, "event_id", "left")
    entry = F.struct("event_id", "action", "resource_accessed", "success",
                     F.unix_micros("timestamp").alias("us"))
    out = None
    for part in split_timelines(marked, policy, depth):
        by_time = W.partitionBy(*part.keys).orderBy("timestamp", "event_id")
        rows = part.rows.withColumns({
            "_prior": F.collect_list(entry).over(by_time.rowsBetween(-depth, -1)),
            "_first": F.row_number().over(by_time)
            == F.rank().over(W.partitionBy(*part.keys).orderBy("timestamp")),
        }).withColumn("_prior", F.first(F.when(F.col("_first"), F.col("_prior")), ignorenulls=True).over(
            W.partitionBy(*part.keys, "timestamp"))).filter(~F.col("_halo"))
        at = F.unix_micros("timestamp")
        found = rows.filter("_alerts IS NOT NULL").select(F.explode("_alerts").alias("a"), at.alias("_at"), "_prior").select(
            F.col("a.id").alias("alert_id"), "_at", F.explode("_prior").alias("e")
        ).filter(F.col("e.us") >= F.col("_at") - F.lit(minutes * 60_000_000)).select(
            "alert_id", "e.event_id", "e.action", "e.resource_accessed", "e.success",
            ((F.col("_at") - F.col("e.us")) / F.lit(1e6)).alias("seconds_before"))
        out = found if out is None else out.unionByName(found)
    return out


def no_context(log: DataFrame) -> DataFrame:
    """Stateless scoring: one event on its own."""
    return log.withColumns({
        "session_resource_count": F.lit(1), "rapid_failure_count": F.lit(0),
        "travel_speed_kmh": F.lit(0.0), "is_impossible_travel": F.lit(0),
        "city_changed": F.lit(0),
    })


def context_features(log: DataFrame, policy: SkewPolicy = DEFAULT) -> DataFrame:
    parts = [add_context(p) for p in split_timelines(log, policy, LOOKBACK_ROWS)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def uncapped_failures(log: DataFrame, failure_window_s: int = FAILURE_WINDOW_S) -> DataFrame:
    """Failures of the same user and address in the window, without a row cap.

    Rows of one instant are merged before the shuffle.  Time is cut into buckets
    as long as the window and each total is copied to the next bucket, so a
    frame needs one bucket only, however long or busy a user's history is.
    """
    us = F.unix_micros("timestamp")
    span = failure_window_s * 1_000_000
    totals = log.groupBy("user_id", "source_ip", us.alias("_us")).agg(
        F.count_if(~F.col("success")).alias("_f"))
    own = F.floor(F.col("_us") / F.lit(span))
    placed = totals.withColumn("_bucket", F.explode(F.array(own, own + 1)))
    frame = W.partitionBy("user_id", "source_ip", "_bucket").orderBy("_us").rangeBetween(-span, -1)
    counts = placed.withColumn("failures_in_window", F.coalesce(F.sum("_f").over(frame), F.lit(0))).filter(
        F.col("_bucket") == own).select("user_id", "source_ip", "_us", "failures_in_window")
    return log.withColumn("_us", us).join(counts, ["user_id", "source_ip", "_us"]).drop("_us")
