"""Fixed schemas and domains of the access log, alerts and feedback."""

from __future__ import annotations

from pyspark.sql import types as T

ACCESS_LOG = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("geo_city", T.StringType()),
    T.StructField("geo_lat", T.DoubleType()),
    T.StructField("geo_lon", T.DoubleType()),
    T.StructField("resource_accessed", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("auth_method", T.StringType()),
    T.StructField("session_duration_s", T.IntegerType()),
    T.StructField("bytes_transferred", T.LongType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("label", T.StringType()),
    T.StructField("role", T.StringType()),
])

LIVE_EVENT = T.StructType([f for f in ACCESS_LOG.fields if f.name != "label"])

FEEDBACK = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("alert_id", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("note", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

MODEL_VERSION = T.StructType([
    T.StructField("version", T.LongType()),
    T.StructField("trained_at", T.TimestampType()),
    T.StructField("samples", T.LongType()),
    T.StructField("smote_ratio", T.StringType()),
    T.StructField("roc_auc", T.DoubleType()),
    T.StructField("f1_score", T.DoubleType()),
    T.StructField("path", T.StringType()),
])

# Domains, ordinals and column orders of the data model.
ACTION_CODES = {"login": 0, "read": 1, "write": 2, "escalate": 3}
AUTH_CODES = {"password": 0, "mfa": 1, "sso": 2, "certificate": 3, "api-key": 4}
CLASSES = [
    "brute_force", "credential_misuse", "device_spoofing",
    "impossible_travel", "lateral_movement", "normal",
]
NORMAL = "normal"
UNKNOWN = "unknown_anomaly"
FEEDBACK_ACTIONS = ("confirm", "dismiss", "note")
FEATURES = [
    "hour_of_day", "hour_deviation", "session_z", "bytes_z", "is_novel_device",
    "is_public_ip", "n_known_devices", "resource_breadth_ratio",
    "session_resource_count", "rapid_failure_count", "travel_speed_kmh",
    "is_impossible_travel", "city_changed", "cold_start", "session_duration_s",
    "bytes_transferred", "success", "action_enc", "auth_enc",
]
SIGNALS = [
    "hour_deviation", "session_z", "bytes_z", "is_novel_device", "is_public_ip",
    "resource_breadth_ratio", "rapid_failure_count", "travel_speed_kmh",
    "is_impossible_travel", "city_changed",
]
BASELINE_NUMBERS = [
    "mean_hour", "std_hour", "mean_session_s", "std_session_s", "mean_bytes",
    "std_bytes", "failure_rate", "n_distinct_resources", "n_devices", "event_count",
]
ALERT_COLUMNS = [
    "id", "event_id", "timestamp", "user_id", "device_id", "source_ip", "geo_city",
    "geo_lat", "geo_lon", "resource_accessed", "action", "auth_method",
    "session_duration_s", "bytes_transferred", "success", "risk_score",
    "attack_type", "confidence", "anomaly_score", "reason", "baseline_type",
    "cold_start", "status", "true_label", "role", "created_at",
]
SUMMARY_COLUMNS = [
    "id", "timestamp", "user_id", "geo_city", "resource_accessed", "action",
    "risk_score", "attack_type", "confidence", "reason", "baseline_type", "status",
]
