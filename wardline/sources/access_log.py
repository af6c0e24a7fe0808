"""Access-log sources and sinks, and the log derived from the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardline.sources.schema import ACCESS_LOG

# The city pool (name, latitude, longitude) and resource pool of
# the derived log.
CITIES = [
    ("New York", 40.71, -74.01), ("London", 51.51, -0.13), ("Tokyo", 35.68, 139.69),
    ("Sydney", -33.87, 151.21), ("Sao Paulo", -23.55, -46.63), ("Dubai", 25.2, 55.27),
    ("Singapore", 1.35, 103.82), ("Mumbai", 19.08, 72.88), ("Paris", 48.85, 2.35),
    ("Chicago", 41.88, -87.63), ("Toronto", 43.65, -79.38), ("Berlin", 52.52, 13.41),
    ("Oslo", 59.91, 10.75), ("Cape Town", -33.93, 18.42), ("Mexico City", 19.43, -99.13),
    ("Seoul", 37.57, 126.98), ("Bangkok", 13.75, 100.52), ("Jakarta", -6.21, 106.85),
]
RESOURCES = [
    "hr-portal", "finance-db", "source-code-repo", "admin-console", "employee-directory",
    "vpn-gateway", "analytics-dashboard", "payroll-system", "identity-service",
    "logging-service", "backup-storage", "ci-cd-pipeline", "secrets-manager",
    "api-gateway", "customer-data-lake", "security-audit-log", "dev-cluster",
    "prod-cluster", "inventory-db", "email-server",
]


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Parquet access log; the fixed schema saves an inference pass."""
    return spark.read.schema(ACCESS_LOG).parquet(path)


def write_log(log: DataFrame, parquet_path: str, csv_path: str | None = None) -> None:
    """Write the log clustered by user and time, optionally as CSV too."""
    ordered = log.repartitionByRange("user_id", "timestamp").sortWithinPartitions(
        "user_id", "timestamp")
    ordered.write.mode("overwrite").parquet(parquet_path)
    if csv_path:
        log.write.mode("overwrite").option("header", True).csv(csv_path)


def with_live_defaults(events: DataFrame) -> DataFrame:
    """Live events may lack an id and a role."""
    return events.withColumns({
        "event_id": F.coalesce("event_id", F.expr("uuid()")),
        "role": F.coalesce("role", F.lit("standard")),
    })


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def log_from_events(events: DataFrame) -> DataFrame:
    """Derive an access log with labelled attack bursts from the events table.

    A narrow transformation: each event turns into 1, 2, 12 or 15 log rows in
    its own task, so no shuffle is needed.
    """
    eid, uid, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    label = (
        F.when(eid % 500 == 0, "brute_force").when(eid % 500 == 250, "lateral_movement")
        .when(eid % 97 == 1, "impossible_travel").when(eid % 101 == 2, "credential_misuse")
        .when(eid % 103 == 3, "device_spoofing").otherwise("normal")
    )
    burst = (
        F.when(F.col("label") == "brute_force", 12).when(F.col("label") == "lateral_movement", 15)
        .when(F.col("label") == "impossible_travel", 2).otherwise(1)
    )
    rows = (
        events.select(
            "event_id", "user_id", "event_type", "value",
            F.col("ts").cast("timestamp").alias("ts"),
            F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
            label.alias("label"),
        )
        .withColumn("i", F.explode(F.sequence(F.lit(0), burst - 1)))
    )
    is_label = {n: F.col("label") == n for n in
                ("brute_force", "lateral_movement", "impossible_travel",
                 "credential_misuse", "device_spoofing", "normal")}
    i, k = F.col("i"), F.col("k")
    second_leg = is_label["impossible_travel"] & (i == 1)
    city = (F.when(second_leg, (uid + 9) % 18)
            .when(is_label["credential_misuse"], (uid + 5) % 18).otherwise(uid % 18))
    resource = (F.when(is_label["lateral_movement"], (uid + i) % 20)
                .when(is_label["brute_force"], 8).otherwise((uid * 3 + k % 4) % 20))
    offset = (F.when(is_label["brute_force"], i * 5).when(is_label["lateral_movement"], i * 60)
              .when(is_label["impossible_travel"], i * 1200).otherwise(0))
    outside = (is_label["credential_misuse"] | is_label["brute_force"]
               | is_label["device_spoofing"] | second_leg)
    city_dim = F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(a).alias("lat"), F.lit(o).alias("lon"))
        for n, a, o in CITIES])
    resource_dim = F.array(*[F.lit(r) for r in RESOURCES])
    place = F.get(city_dim, city.cast("int"))
    return rows.withColumn("place", place).select(
        _text("evt_", eid * 100 + i).alias("event_id"),
        F.timestamp_micros(F.unix_micros("ts") + offset.cast("long") * 1_000_000).alias("timestamp"),
        _text("user_", uid).alias("user_id"),
        F.when(is_label["credential_misuse"], _text("nov_", eid))
        .when(is_label["device_spoofing"], _text("dev_", uid + 1, "_0"))
        .otherwise(_text("dev_", uid, "_", eid % 2)).alias("device_id"),
        F.when(outside, _text("203.0.", uid % 200, ".", k % 250))
        .otherwise(_text("10.", uid % 200, ".", k % 250, ".", eid % 250)).alias("source_ip"),
        F.col("place.name").alias("geo_city"),
        F.col("place.lat").alias("geo_lat"),
        F.col("place.lon").alias("geo_lon"),
        F.get(resource_dim, resource.cast("int")).alias("resource_accessed"),
        F.when(is_label["lateral_movement"], "read")
        .when(is_label["brute_force"] | is_label["credential_misuse"]
              | is_label["impossible_travel"], "login")
        .when(kind.isin("signup", "error"), "login").when(kind == "purchase", "write")
        .when((kind == "click") & (k % 25 == 0), "escalate").otherwise("read").alias("action"),
        F.get(F.array(*[F.lit(a) for a in ("password", "mfa", "sso", "certificate", "api-key")]),
              k % 5).alias("auth_method"),
        F.when(is_label["brute_force"], i % 5 + 1)
        .otherwise(F.floor(F.col("value") * 60).cast("int") + 10).alias("session_duration_s"),
        F.when(is_label["brute_force"], F.lit(0).cast("long"))
        .otherwise(F.floor(F.col("value") * 1000)).alias("bytes_transferred"),
        (~(is_label["brute_force"] | (is_label["normal"] & (kind == "error") & (k % 7 == 0))))
        .alias("success"),
        "label",
        F.get(F.array(*[F.lit(r) for r in ("standard", "admin", "developer", "analyst")]),
              (uid % 4).cast("int")).alias("role"),
    )


def load_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
