"""SQL functions for use from spark.sql; they inline into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

SQL_FUNCTIONS = {
    "haversine_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE":
        "12742.0D * asin(sqrt(least(1.0D, greatest(0.0D, pow(sin(radians(lat2 - lat1) / 2), 2) "
        "+ cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))))",
    "risk_score(anomaly DOUBLE, attack STRING, confidence DOUBLE) RETURNS INT":
        "CASE WHEN attack = 'normal' THEN least(30, cast(anomaly * 40 AS INT)) "
        "WHEN attack = 'unknown_anomaly' THEN cast(least(70.0D, greatest(40.0D, "
        "(anomaly * 0.6D + confidence * 0.2D) * 100)) AS INT) "
        "ELSE cast(least(100.0D, greatest(50.0D, (anomaly * 0.4D + confidence * 0.6D) * 100)) AS INT) END",
    "risk_band(risk INT) RETURNS STRING":
        "CASE WHEN risk >= 90 THEN 'CRITICAL' WHEN risk >= 70 THEN 'HIGH' "
        "WHEN risk >= 40 THEN 'ELEVATED' ELSE 'MINIMAL' END",
}


def register(spark: SparkSession) -> None:
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
