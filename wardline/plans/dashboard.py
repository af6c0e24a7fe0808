"""One-row and per-class views that combine several tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardline.operators import alerts as A
from wardline.operators.baselines import cold_start_users


def metrics_row(binary: DataFrame, alerts: DataFrame, drift: DataFrame, stats: DataFrame) -> DataFrame:
    """Model quality, alert counts, drift state and cold-start users in one row."""
    quality = binary.select(F.struct("roc_auc", "pr_auc", "fpr")).scalar()
    drifted = drift.select(F.struct("global_drift_detected", "users_drifted")).scalar()
    return A.kpis(alerts).withColumns({
        "_q": quality, "_d": drifted, "cold_start_users": cold_start_users(stats).scalar(),
    }).select(
        F.col("_q.roc_auc").alias("anomaly_roc_auc"), F.col("_q.pr_auc").alias("anomaly_pr_auc"),
        F.col("_q.fpr").alias("anomaly_fpr"),
        F.col("total").alias("total_alerts"), F.col("open").alias("open_alerts"),
        F.col("confirmed").alias("confirmed_alerts"), F.col("dismissed").alias("dismissed_alerts"),
        F.col("_d.global_drift_detected").alias("drift_detected"),
        F.col("_d.users_drifted").alias("drift_users_affected"), "cold_start_users")
