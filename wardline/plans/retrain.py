"""Retraining from analyst feedback, and the model registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.operators import alerts as A
from wardline.plans.models import Models, train
from wardline.sources.schema import MODEL_VERSION, NORMAL
from wardline.sources.stores import read_table


def relabelled(log: DataFrame, alerts: DataFrame, feedback: DataFrame) -> DataFrame:
    """A confirmed alert keeps its predicted class, a dismissed one is normal."""
    verdicts = (
        A.latest_state(feedback).filter(F.col("verdict").isNotNull())
        .join(alerts.select(F.col("id").alias("alert_id"), "event_id", "attack_type"), "alert_id")
        .select("event_id", F.when(F.col("verdict") == "confirmed", F.col("attack_type"))
                .otherwise(NORMAL).alias("_label")))
    return log.join(verdicts, "event_id", "left").withColumn(
        "label", F.coalesce("_label", "label")).drop("_label")


def due(feedback: DataFrame, batch: int = A.RETRAIN_EVERY) -> DataFrame:
    """Counts of the feedback queue and whether a full batch has just been reached."""
    return A.feedback_kpis(feedback, batch).withColumn(
        "due", (F.col("total_feedback_labels") > 0) & (F.col("pending_retrain_batch") == 0))


def versions(spark: SparkSession, path: str) -> DataFrame:
    """Registered versions, newest first; the newest one is active."""
    table = read_table(spark, path, MODEL_VERSION)
    newest = table.agg(F.max("version")).scalar()
    return table.withColumn("status", F.when(
        F.col("version") == newest, "active").otherwise("archived")).orderBy(F.desc("version"))


def register(spark: SparkSession, path: str, model_path: str, samples: int, smote_ratio: str,
             roc_auc: float, f1_score: float) -> int:
    last = read_table(spark, path, MODEL_VERSION).agg(F.max("version")).first()[0] or 0
    spark.range(1).select(
        F.lit(last + 1).cast("long").alias("version"), F.current_timestamp().alias("trained_at"),
        F.lit(samples).cast("long").alias("samples"), F.lit(smote_ratio).alias("smote_ratio"),
        F.lit(float(roc_auc)).alias("roc_auc"), F.lit(float(f1_score)).alias("f1_score"),
        F.lit(model_path).alias("path"),
    ).write.mode("append").parquet(path)
    return last + 1


def retrain(log: DataFrame, alerts: DataFrame, feedback: DataFrame, root: str, **options) -> Models:
    """Relabel, refit both layers, save and register the new version."""
    spark = log.sparkSession
    table = relabelled(log, alerts, feedback)
    models, binary, classes = train(table, **options)
    registry = f"{root}/versions"
    last = read_table(spark, registry, MODEL_VERSION).agg(F.max("version")).first()[0] or 0
    path = f"{root}/models/{last + 1}"
    models.save(path)
    # Both reports have one row per model or class.
    macro = classes.agg(F.avg("f1")).first()[0]
    register(spark, registry, path, table.count(), "1:1", binary.first()["roc_auc"], macro)
    return models
