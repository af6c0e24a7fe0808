"""Rule checks that need no learned baseline, and their policy table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Rule thresholds, severities and detail texts.
TRAVEL_KMH = 800.0
FAILURES = 10
POLICY_ROWS = [
    # rule, enabled, threshold, unit, min_risk
    ("impossible_travel", True, 800.0, "km/h", 80),
    ("brute_force", True, 10.0, "failures / 2 min", 85),
    ("off_hours", True, 3.5, "std dev (σ)", 70),
    ("cold_start", True, 20.0, "logged events", 0),
]
POLICY_SCHEMA = "rule string, enabled boolean, threshold double, unit string, min_risk int"


def violations(speed="travel_speed_kmh", failures="rapid_failure_count") -> Column:
    """Array of (rule, severity, detail) for one event."""
    speed, failures = F.col(speed), F.col(failures)
    checks = [
        (speed > TRAVEL_KMH, "impossible_travel", "high",
         F.concat(F.lit("Travel speed "), F.format_number(speed, 0),
                  F.lit(" km/h exceeds physical maximum"))),
        (failures >= FAILURES, "brute_force", "high",
         F.concat(failures.cast("string"), F.lit(" failed logins in 2-minute window"))),
        ((F.col("action") == "escalate") & (F.col("is_public_ip") == 1),
         "suspicious_escalation", "medium",
         F.lit("Privilege escalation from a public IP address")),
    ]
    found = F.array(*[
        F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"),
                              detail.alias("detail")))
        for test, rule, severity, detail in checks])
    return F.filter(found, lambda v: v.isNotNull())


def rule_alerts(features: DataFrame) -> DataFrame:
    """One row per event and violated rule."""
    return features.select(
        "event_id", "user_id", "timestamp", F.inline(violations()))


def default_policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICY_ROWS, POLICY_SCHEMA)


def policy_alerts(features: DataFrame, policy: DataFrame) -> DataFrame:
    """Events that exceed the threshold of an enabled rule of the policy table."""
    readings = F.inline(F.array(
        F.struct(F.lit("impossible_travel").alias("rule"),
                 F.col("travel_speed_kmh").cast("double").alias("reading")),
        F.struct(F.lit("brute_force").alias("rule"),
                 F.col("rapid_failure_count").cast("double").alias("reading")),
        F.struct(F.lit("off_hours").alias("rule"),
                 F.col("hour_deviation").cast("double").alias("reading"))))
    # The policy has one row per rule.
    rules = F.broadcast(policy.filter("enabled").drop("enabled"))
    at_least = (F.col("rule") == "brute_force") & (F.col("reading") >= F.col("threshold"))
    return (
        features.select("event_id", "user_id", readings).join(rules, "rule")
        .filter(at_least | (F.col("reading") > F.col("threshold")))
    )
