"""Alert, feedback and document tables on shared storage."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wardline.operators import alerts as A
from wardline.session import checkpoint
from wardline.sources import day_filters as DF
from wardline.sources.schema import FEEDBACK, FEEDBACK_ACTIONS

ALERTS = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("id", "event_id")],
    T.StructField("timestamp", T.TimestampType()),
    *[T.StructField(n, T.StringType()) for n in ("user_id", "device_id", "source_ip", "geo_city")],
    *[T.StructField(n, T.DoubleType()) for n in ("geo_lat", "geo_lon")],
    *[T.StructField(n, T.StringType()) for n in ("resource_accessed", "action", "auth_method")],
    T.StructField("session_duration_s", T.IntegerType()),
    T.StructField("bytes_transferred", T.LongType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("risk_score", T.IntegerType()),
    T.StructField("attack_type", T.StringType()),
    *[T.StructField(n, T.DoubleType()) for n in ("confidence", "anomaly_score")],
    *[T.StructField(n, T.StringType()) for n in ("reason", "baseline_type")],
    T.StructField("cold_start", T.BooleanType()),
    *[T.StructField(n, T.StringType()) for n in ("status", "true_label", "role")],
    T.StructField("created_at", T.TimestampType()),
])


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, or an empty one when nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def coerced(alerts: DataFrame) -> DataFrame:
    """Columns in table order and type; 0/1 flags become booleans."""
    return alerts.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ALERTS.fields])


def _partitioned(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*ALERTS.fields, T.StructField("day", T.DateType()),
                           T.StructField("batch", T.StringType())])
    return read_table(spark, path, schema)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return _partitioned(spark, path).select(*ALERTS.names)


def candidates(rows: DataFrame, path: str, batch: str) -> DataFrame:
    """Stored alerts of the days whose filters answer for an id of ``rows``."""
    spark = rows.sparkSession
    days = DF.days_that_may_hold(rows, DF.read_filters(spark, path).filter(F.col("batch") != batch))
    return _partitioned(spark, path).filter((F.col("batch") != batch) & F.col("day").isin(days))


def append_alerts(alerts: DataFrame, path: str, batch: str | None = None,
                  pruned: bool = False) -> int:
    """Insert alerts that are not stored yet; returns how many.

    Rows go to partitions (day, batch); repeating a batch under its name
    replaces what it wrote, so a retry changes nothing.  ``pruned`` reads only
    the stored days that Bloom filters name (``day_filters``), which keeps a
    stream from reading the whole table; what is inserted is the same.  A table
    written without filters needs ``rebuild_filters`` once before.
    """
    spark = alerts.sparkSession
    batch = batch or uuid.uuid4().hex
    rows = checkpoint(coerced(alerts).withColumn("day", F.to_date("timestamp")))
    stored = candidates(rows, path, batch) if pruned else _partitioned(spark, path).filter(F.col("batch") != batch)
    new = checkpoint(A.unseen(rows, stored).withColumn("batch", F.lit(batch)))
    DF.write_filters(new, path)
    (new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day", "batch").parquet(path))
    return new.count()


def rebuild_filters(spark: SparkSession, path: str) -> None:
    """Filters of all stored alerts, from the table alone."""
    DF.write_filters(_partitioned(spark, path), path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, FEEDBACK)


def append_feedback(spark: SparkSession, path: str, alerts: DataFrame, alert_id: str,
                    action: str, note: str | None = None) -> str:
    """Log one verdict or note; returns the alert's new status."""
    if action not in FEEDBACK_ACTIONS:
        raise ValueError(f"action must be one of {FEEDBACK_ACTIONS}")
    if alerts.filter(F.col("id") == alert_id).isEmpty():
        raise KeyError(alert_id)
    # Ids grow with time, so they also order entries of one instant.
    entry = spark.range(1).select(
        F.unix_micros(F.current_timestamp()).alias("id"), F.lit(alert_id).alias("alert_id"),
        F.lit(action).alias("action"), F.lit(note).cast("string").alias("note"),
        F.current_timestamp().alias("created_at"))
    entry.write.mode("append").parquet(path)
    mine = read_feedback(spark, path).filter(F.col("alert_id") == alert_id)
    row = A.latest_state(mine).first()
    return (row["verdict"] if row else None) or "open"


def write_document(row: DataFrame, path: str) -> None:
    """One JSON object per row."""
    row.select(F.to_json(F.struct(*row.columns)).alias("value")).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str, schema: str, default: dict) -> DataFrame:
    """The stored document, or one row of defaults when there is none."""
    fallback = spark.range(1).select(*[F.lit(v).alias(k) for k, v in default.items()])
    try:
        text = spark.read.text(path)
    except AnalysisException:
        return fallback
    return text.select(F.from_json("value", schema).alias("d")).select("d.*")


def fresh_dir(root: str, name: str) -> str:
    return f"{root}/{name}-{uuid.uuid4().hex}"
