"""Per-user behavioural baselines and population fallbacks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from wardline.operators.ordered import exact_percentiles, unpivot
from wardline.session import checkpoint
from wardline.sources.schema import BASELINE_NUMBERS, NORMAL

MIN_PERSONAL_EVENTS = 20
MIN_ROLE_USERS = 5
MAX_SET = 1000          # longest set kept inside a baseline row


@dataclass
class Baselines:
    """``stats``: one row per user.  ``devices``: all (user_id, value) pairs.

    A set longer than ``MAX_SET`` is null in ``stats``; membership is then
    looked up in the pairs, so no set is ever cut short.
    """

    stats: DataFrame
    devices: DataFrame
    population: DataFrame


def normal_rows(log: DataFrame) -> DataFrame:
    return log.filter(F.col("label") == NORMAL)


def known_values(log: DataFrame, column: str) -> DataFrame:
    """Distinct (user, value) pairs of the normal rows with their row counts."""
    return (normal_rows(log).groupBy("user_id", F.col(column).alias("value"))
            .agg(F.count(F.lit(1)).alias("n_events")))


def _bounded_sets(pairs: DataFrame, max_set: int) -> DataFrame:
    """Sorted sets of at most ``max_set`` values, null when there are more."""
    first = W.partitionBy("user_id", "kind").orderBy("value")
    limited = (pairs.withColumn("_r", F.row_number().over(first))
               .filter(F.col("_r") <= max_set + 1))

    def one(kind):
        values = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("value"))))
        return F.when(F.size(values) <= max_set, values)

    return limited.groupBy("user_id").agg(
        one("device").alias("known_devices"), one("ip").alias("known_ips"))


def user_baselines(log: DataFrame, max_set: int = MAX_SET) -> DataFrame:
    """One row per user with at least one normal row."""
    normal = normal_rows(log)
    hour = F.hour("timestamp").cast("double")

    def spread(col):
        return F.coalesce(F.stddev_samp(col), F.lit(1.0))

    numbers = normal.groupBy("user_id").agg(
        F.avg(hour).alias("mean_hour"), spread(hour).alias("std_hour"),
        F.avg("session_duration_s").alias("mean_session_s"),
        spread("session_duration_s").alias("std_session_s"),
        F.avg("bytes_transferred").alias("mean_bytes"),
        spread("bytes_transferred").alias("std_bytes"),
        F.avg(F.when(F.col("success"), 0.0).otherwise(1.0)).alias("failure_rate"),
        F.count(F.lit(1)).alias("event_count"),
        F.max_by("role", F.struct("timestamp", "event_id")).alias("role"),
    )
    return joined_baselines(numbers, value_pairs(normal), max_set)


def value_pairs(normal: DataFrame, *keep: str) -> DataFrame:
    """(user_id, kind, value, n) of the sets a baseline holds, by the further columns."""
    kinds = F.inline(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(col).alias("value"))
        for kind, col in (("city", "geo_city"), ("device", "device_id"),
                          ("ip", "source_ip"), ("resource", "resource_accessed"))]))
    # Merged map-side to distinct values before anything is grouped by user.
    return (normal.select("user_id", *keep, kinds).groupBy("user_id", *keep, "kind", "value")
            .agg(F.count(F.lit(1)).alias("n")))


def joined_baselines(numbers: DataFrame, pairs: DataFrame, max_set: int = MAX_SET) -> DataFrame:
    counts = pairs.groupBy("user_id").agg(
        F.count_if(F.col("kind") == "resource").alias("n_distinct_resources"),
        F.count_if(F.col("kind") == "device").alias("n_devices"),
        F.min_by(F.when(F.col("kind") == "city", F.col("value")),
                 F.when(F.col("kind") == "city", F.struct(-F.col("n"), "value"))).alias("home_city"),
    )
    sets = _bounded_sets(pairs.filter(F.col("kind").isin("device", "ip")), max_set)
    return numbers.join(counts, "user_id").join(sets, "user_id").select(
        "user_id", *BASELINE_NUMBERS, "home_city", "role", "known_devices", "known_ips")


def population_baseline(stats: DataFrame) -> DataFrame:
    """Medians over users of every number, as one row."""
    medians = exact_percentiles(unpivot(stats, BASELINE_NUMBERS), "name", "value", [0.5])
    return medians.agg(*[
        F.max(F.when(F.col("name") == c, F.col("percentile"))).alias(c) for c in BASELINE_NUMBERS])


def role_baseline(stats: DataFrame, min_users: int = MIN_ROLE_USERS) -> DataFrame:
    """Medians per role; roles with too few users get the global medians."""
    long = unpivot(stats, BASELINE_NUMBERS, keep=["role"])
    keyed = long.select(F.concat_ws("|", "name", "role").alias("name"), "value").unionByName(
        long.select(F.concat_ws("|", "name", F.lit("*")).alias("name"), "value"))
    medians = exact_percentiles(keyed, "name", "value", [0.5]).select(
        F.split_part("name", F.lit("|"), F.lit(1)).alias("number"),
        F.split_part("name", F.lit("|"), F.lit(2)).alias("role"), "percentile")
    wide = medians.groupBy("role").agg(*[
        F.max(F.when(F.col("number") == c, F.col("percentile"))).alias(c) for c in BASELINE_NUMBERS])
    overall = wide.filter(F.col("role") == "*").select(
        F.struct(*BASELINE_NUMBERS).alias("all"))
    users = stats.groupBy("role").agg(F.count(F.lit(1)).alias("n_users"))
    return (
        users.join(wide.filter(F.col("role") != "*"), "role")
        .withColumn("all", overall.scalar())
        .select("role", "n_users", *[
            F.when(F.col("n_users") >= min_users, F.col(c)).otherwise(F.col(f"all.{c}")).alias(c)
            for c in BASELINE_NUMBERS])
    )


def fit_baselines(log: DataFrame, max_set: int = MAX_SET) -> Baselines:
    """Compute once and keep: the stats feed several later steps."""
    stats = checkpoint(user_baselines(log, max_set))
    return Baselines(stats, known_values(log, "device_id"), checkpoint(population_baseline(stats)))


def save_baselines(base: Baselines, path: str) -> None:
    base.stats.write.mode("overwrite").parquet(f"{path}/stats")
    base.devices.write.mode("overwrite").parquet(f"{path}/devices")
    base.population.write.mode("overwrite").parquet(f"{path}/population")


def load_baselines(spark: SparkSession, path: str) -> Baselines:
    return Baselines(*[spark.read.parquet(f"{path}/{p}") for p in ("stats", "devices", "population")])


def baseline_type(event_count, min_events: int = MIN_PERSONAL_EVENTS):
    """'personal' for a known user with enough history, else 'population'."""
    return F.when(event_count >= min_events, "personal").otherwise("population")


def cold_start_users(stats: DataFrame, min_events: int = MIN_PERSONAL_EVENTS) -> DataFrame:
    return stats.agg(F.count_if(F.col("event_count") < min_events).alias("cold_start_users"))
