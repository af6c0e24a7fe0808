"""Distribution drift between a recent and a baseline window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from wardline.functions.scalars import circular_hours, haversine_km, kolmogorov_sf
from wardline.operators.ordered import running_totals, unpivot

MIN_SAMPLE = 10
P_DRIFT = 0.01
WINDOW_DAYS = 30
EXACT_LIMIT = 10000
P_DRIFTING = 0.05
P_MONITOR = 0.15
REPORT_FEATURES = [
    "off_hours_login", "session_duration_s", "bytes_transferred", "distinct_hosts_count",
    "geo_distance_from_home", "failed_login_rate", "auth_method_entropy", "resource_rarity_score",
]


def split_windows(log: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """Rows of the two windows with ``side`` 'recent' or 'baseline'."""
    anchor = log.agg(F.max(F.unix_micros("timestamp"))).scalar()
    span = days * 86_400_000_000
    us, end = F.unix_micros("timestamp"), F.col("_end")
    return (
        log.withColumn("_end", anchor)
        .filter(us >= end - 2 * span)
        .withColumn("side", F.when(us >= end - span, "recent").otherwise("baseline"))
        .drop("_end")
    )


def path_pvalue(n: int, m: int, stat: float) -> float:
    """P(D ≥ stat) by following lattice paths that stay inside the band.

    A random interleaving of the samples is a path; ``inside`` holds, per count
    of first-sample draws, the chance of being there without having left the
    band.  One step advances all positions of a diagonal together.
    """
    edge = round(stat * n * m)
    if edge <= 0:
        return 1.0
    i = np.arange(n + 1)
    inside = np.zeros(n + 1)
    inside[0] = 1.0
    for drawn in range(n + m):
        left = n + m - drawn
        j = drawn - i
        moved = inside * np.clip(m - j, 0, None) / left
        moved[1:] += inside[:-1] * (n - i[:-1]) / left
        j = drawn + 1 - i
        moved[(j < 0) | (j > m) | (np.abs(i * m - j * n) >= edge)] = 0.0
        inside = moved
    return float(min(1.0, max(0.0, 1.0 - inside[n])))


@F.pandas_udf(T.DoubleType())
def exact_ks_pvalue(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Exact p-value; null sizes give null.  Equal cases are computed once."""
    known: dict[tuple, float] = {}
    for n, m, d in batches:
        out = []
        for case in zip(n, m, d):
            if pd.isna(case[0]) or pd.isna(case[1]):
                out.append(None)
                continue
            if case not in known:
                known[case] = path_pvalue(int(case[0]), int(case[1]), float(case[2]))
            out.append(known[case])
        yield pd.Series(out, dtype="float64")


def with_pvalue(ks: DataFrame, method: str = "auto", min_sample: int = MIN_SAMPLE,
                p_drift: float = P_DRIFT) -> DataFrame:
    """Add ``p_value`` and ``drifted`` to (n_recent, n_baseline, ks_stat) rows.

    'asymptotic' is a native expression; 'auto' counts paths exactly up to
    ``EXACT_LIMIT`` rows a side.  Short samples never count as drifted.
    """
    approx = kolmogorov_sf("ks_stat", "n_recent", "n_baseline")
    enough = F.least("n_recent", "n_baseline") >= min_sample
    if method == "auto":
        small = enough & (F.greatest("n_recent", "n_baseline") <= EXACT_LIMIT)
        # Null sizes keep the function from working on rows it is not meant for.
        exact = exact_ks_pvalue.asNondeterministic()(F.when(small, F.col("n_recent")), F.when(small, F.col("n_baseline")), "ks_stat")
        ks = ks.withColumn("_exact", exact)
        approx = F.when(small, F.col("_exact")).otherwise(approx)
    elif method != "asymptotic":
        raise ValueError(f"unknown method {method!r}")
    return (ks.withColumn("p_value", F.when(enough, approx).otherwise(1.0))
            .withColumn("drifted", enough & (F.col("p_value") < p_drift)).drop("_exact"))


def ks_by_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """KS statistic for many keys whose values come from a small domain (hours)."""
    recent = F.col("side") == "recent"
    counts = df.groupBy(key, value).agg(
        F.count_if(recent).alias("r"), F.count_if(~recent).alias("b"))
    return ks_of_counts(counts, key, value)


def ks_of_counts(counts: DataFrame, key: str, value: str) -> DataFrame:
    """KS statistic from (key, value, r, b), the rows of each value in the two windows."""
    up_to = W.partitionBy(key).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(key)
    gap = F.abs(F.try_divide(F.sum("r").over(up_to), F.sum("r").over(whole))
                - F.try_divide(F.sum("b").over(up_to), F.sum("b").over(whole)))
    return counts.withColumn("gap", gap).groupBy(key).agg(
        F.sum("r").alias("n_recent"), F.sum("b").alias("n_baseline"),
        F.coalesce(F.max("gap"), F.lit(0.0)).alias("ks_stat"))


def ks_by_feature(long: DataFrame, group: str = "name", value: str = "value") -> DataFrame:
    """KS statistic for a few features with any number of distinct values."""
    recent = (F.col("side") == "recent").cast("long")
    totals = running_totals(long.filter(F.col(value).isNotNull()), group, value,
                            {"r": recent, "b": F.lit(1) - recent})
    gap = F.abs(F.try_divide("cum_r", "all_r") - F.try_divide("cum_b", "all_b"))
    return totals.withColumn("gap", gap).groupBy(group).agg(
        F.max("all_r").alias("n_recent"), F.max("all_b").alias("n_baseline"),
        F.coalesce(F.max("gap"), F.lit(0.0)).alias("ks_stat"))


def user_drift(log: DataFrame, days: int = WINDOW_DAYS, method: str = "auto") -> DataFrame:
    """Login-hour drift of every user of the log."""
    hours = split_windows(log, days).select("user_id", "side", F.hour("timestamp").alias("hour"))
    tested = with_pvalue(ks_by_key(hours, "user_id", "hour"), method)
    users = log.select("user_id").distinct()
    return users.join(tested, "user_id", "left").fillna(
        {"n_recent": 0, "n_baseline": 0, "ks_stat": 0.0, "p_value": 1.0, "drifted": False})


def population_drift(log: DataFrame, columns: tuple[str, ...] = ("session_duration_s", "bytes_transferred"),
                     days: int = WINDOW_DAYS, method: str = "auto") -> DataFrame:
    present = [c for c in columns if c in log.columns]
    long = unpivot(split_windows(log, days), present, keep=["side"], name="feature")
    return with_pvalue(ks_by_feature(long, "feature"), method)


def drift_summary(users: DataFrame, population: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """One row: users checked and drifted, and whether anything drifted."""
    any_feature = population.agg(F.coalesce(F.bool_or("drifted"), F.lit(False))).scalar()
    return users.agg(
        F.count(F.lit(1)).alias("users_checked"), F.count_if("drifted").alias("users_drifted"),
    ).withColumn("_f", any_feature).select(
        F.lit(days).alias("window_days"), "users_checked", "users_drifted",
        ((F.col("users_drifted") > 0) | F.col("_f")).alias("global_drift_detected"))


def first_drifted(users: DataFrame, n: int = 10) -> DataFrame:
    return users.filter("drifted").orderBy("p_value", "user_id").limit(n)


def drift_status(log: DataFrame, days: int = WINDOW_DAYS, method: str = "auto") -> DataFrame:
    """The nested status document of one drift check."""
    users, features = user_drift(log, days, method), population_drift(log, days=days, method=method)
    worst = first_drifted(users).agg(F.collect_list(F.struct(
        "user_id", F.lit("login_hour").alias("feature"), "ks_stat", "p_value"))).scalar()
    tested = features.agg(F.sort_array(F.collect_list(F.struct(
        "feature", "ks_stat", "p_value", "drifted")))).scalar()
    return drift_summary(users, features, days).withColumns({
        "drifted_users": worst, "population_drift": tested, "method": F.lit("ks_test"),
        "checked_at": F.current_timestamp()})


def daily_measures(log: DataFrame, stats: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """The eight report measures per user and day, with the window side."""
    rows = split_windows(log, days)
    day = F.to_date("timestamp").alias("day")
    # Rarity from resource shares in the baseline window: one row per resource.
    shares = rows.groupBy("resource_accessed").agg(
        F.count_if(F.col("side") == "baseline").alias("_n"))
    total = shares.agg(F.sum("_n")).scalar()
    rarity = shares.withColumn("_all", total).select(
        "resource_accessed",
        F.when(F.col("_n") > 0, -F.ln(F.col("_n") / F.col("_all"))).alias("_rarity"))
    # A user's home is the mean position of the home city in the normal rows.
    homes = (log.filter("label = 'normal'").groupBy("user_id", "geo_city")
             .agg(F.round(F.avg("geo_lat"), 6).alias("_hlat"),
                  F.round(F.avg("geo_lon"), 6).alias("_hlon")))
    own = stats.select("user_id", "mean_hour", F.col("home_city").alias("geo_city")).join(
        homes, ["user_id", "geo_city"]).drop("geo_city")
    login = F.col("action") == "login"
    enriched = rows.join(rarity, "resource_accessed").join(own, "user_id")
    daily = enriched.groupBy("user_id", day, "side").agg(
        F.avg(circular_hours(F.hour("timestamp"), "mean_hour")).alias("off_hours_login"),
        F.avg("session_duration_s").alias("session_duration_s"),
        F.avg("bytes_transferred").alias("bytes_transferred"),
        F.avg(haversine_km("geo_lat", "geo_lon", "_hlat", "_hlon")).alias("geo_distance_from_home"),
        F.try_divide(F.count_if(login & ~F.col("success")), F.count_if(login)).alias("failed_login_rate"),
        F.avg("_rarity").alias("resource_rarity_score"),
        F.countDistinct("resource_accessed").alias("distinct_hosts_count"),
    )
    share = F.col("n") / F.sum("n").over(W.partitionBy("user_id", "day", "side"))
    entropy = (
        rows.groupBy("user_id", day, "side", "auth_method").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("p", share).groupBy("user_id", "day", "side")
        .agg(F.sum(-F.col("p") * F.ln("p")).alias("auth_method_entropy")))
    return daily.join(entropy, ["user_id", "day", "side"])


def feature_report(log: DataFrame, stats: DataFrame, days: int = WINDOW_DAYS,
                   method: str = "asymptotic") -> DataFrame:
    """KS, p-value, means and status of each measure."""
    # Rounding merges values that differ only by summation order; +0.0 drops -0.0.
    long = unpivot(daily_measures(log, stats, days), REPORT_FEATURES, keep=["side"], name="feature"
                   ).withColumn("value", F.round("value", 6) + 0.0)
    tested = with_pvalue(ks_by_feature(long, "feature"), method)
    recent = F.col("side") == "recent"
    means = long.groupBy("feature").agg(
        F.avg(F.when(~recent, F.col("value"))).alias("baseline_mean"),
        F.avg(F.when(recent, F.col("value"))).alias("recent_mean"))
    # One row per feature.
    return tested.join(F.broadcast(means), "feature").select(
        "feature", "ks_stat", "p_value", "baseline_mean", "recent_mean",
        F.when(F.col("p_value") < P_DRIFTING, "DRIFTING")
        .when(F.col("p_value") < P_MONITOR, "MONITOR").otherwise("STABLE").alias("status"))
