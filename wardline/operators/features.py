"""The 19 model features: look-back context joined to personal baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardline.functions import scalars as S
from wardline.operators.baselines import MIN_PERSONAL_EVENTS, Baselines, baseline_type
from wardline.operators.context import add_context, no_context
from wardline.operators.hotkeys import DEFAULT, SkewPolicy, bounded_hint, split_timelines
from wardline.sources.schema import ACTION_CODES, AUTH_CODES, BASELINE_NUMBERS, FEATURES


def _with_baseline(rows: DataFrame, base: Baselines, wide_users: bool, hot: bool,
                   policy: SkewPolicy) -> DataFrame:
    """Left join of the user's row; unknown users take the population medians."""
    stats = base.stats.select(
        "user_id", F.struct(*BASELINE_NUMBERS, "known_devices").alias("_own"))
    if hot:
        # Few users, many rows each: keep the rows where they are if that is safe.
        users = rows.select("user_id").distinct()
        stats = stats.join(users, "user_id", "left_semi")
        stats = bounded_hint(stats, stats.count(), policy)
    joined = rows.join(stats, "user_id", "left")
    known = F.array_contains("_own.known_devices", F.col("device_id"))
    if wide_users:
        wide = base.stats.filter(F.col("known_devices").isNull()).select("user_id")
        pairs = base.devices.join(wide, "user_id", "left_semi").select(
            "user_id", F.col("value").alias("device_id"), F.lit(True).alias("_pair"))
        n_pairs = pairs.limit(policy.max_broadcast_keys + 1).count()
        joined = joined.join(bounded_hint(pairs, n_pairs, policy), ["user_id", "device_id"], "left")
        known = F.coalesce(known, F.col("_pair"))
    return joined.withColumn("_known", F.coalesce(known, F.lit(False))).drop("_pair")


def _has_wide_users(base: Baselines) -> bool:
    return not base.stats.filter(F.col("known_devices").isNull()).isEmpty()


def deviations(rows: DataFrame, base: Baselines, min_events: int = MIN_PERSONAL_EVENTS) -> DataFrame:
    """Features relative to the joined baseline; needs ``_own`` and ``_known``."""
    population = base.population.select(F.struct(*BASELINE_NUMBERS)).scalar()
    known_user = F.col("_own").isNotNull()
    rows = rows.withColumn("_pop", population).withColumn("_b", F.struct(*[
        F.when(known_user, F.col(f"_own.{c}").cast("double")).otherwise(F.col(f"_pop.{c}")).alias(c)
        for c in BASELINE_NUMBERS]))
    hour = F.hour("timestamp")
    return rows.withColumns({
        "hour_of_day": hour,
        "hour_deviation": S.hour_deviation(hour, "_b.mean_hour", "_b.std_hour"),
        "session_z": S.clipped_z("session_duration_s", "_b.mean_session_s", "_b.std_session_s"),
        "bytes_z": S.clipped_z("bytes_transferred", "_b.mean_bytes", "_b.std_bytes"),
        "is_novel_device": (~F.col("_known")).cast("int"),
        "is_public_ip": S.is_public_ip("source_ip"),
        "n_known_devices": F.col("_b.n_devices").cast("int"),
        "resource_breadth_ratio": F.col("session_resource_count")
        / F.greatest(F.col("_b.n_distinct_resources"), F.lit(1.0)),
        "cold_start": F.coalesce(F.col("_own.event_count") < min_events, F.lit(True)).cast("int"),
        "action_enc": S.ordinal("action", ACTION_CODES),
        "auth_enc": S.ordinal("auth_method", AUTH_CODES),
        "baseline_type": baseline_type(F.col("_own.event_count"), min_events),
    }).fillna(0, subset=["hour_deviation", "session_z", "bytes_z"]).drop("_own", "_pop", "_b", "_known")


def build_features(log: DataFrame, base: Baselines, stateful: bool = True,
                   legacy_novel_device: bool = False, policy: SkewPolicy = DEFAULT,
                   min_events: int = MIN_PERSONAL_EVENTS) -> DataFrame:
    """The log with all features, ``baseline_type`` and its own columns.

    ``stateful=False`` scores each event on its own.  ``legacy_novel_device``
    treats every device as unseen, as a baseline saved without its sets would.
    """
    # Baselines are clustered by user like the windows, so rows are shuffled once.
    wide = _has_wide_users(base)
    if not stateful:
        rows = deviations(_with_baseline(no_context(log), base, wide, False, policy), base, min_events)
    else:
        rows = None
        for part in split_timelines(log, policy):
            own = deviations(
                _with_baseline(add_context(part), base, wide, part.hot, policy), base, min_events)
            rows = own if rows is None else rows.unionByName(own)
    return rows.withColumn("is_novel_device", F.lit(1)) if legacy_novel_device else rows


def features_from_context(rows: DataFrame, base: Baselines,
                          min_events: int = MIN_PERSONAL_EVENTS) -> DataFrame:
    """Features of rows whose look-back columns come from elsewhere (stream state)."""
    return deviations(_with_baseline(rows, base, _has_wide_users(base), False, DEFAULT), base, min_events)


def feature_columns(df: DataFrame, wanted: list[str] = FEATURES) -> list[str]:
    """The wanted features that are present, in order."""
    return [c for c in wanted if c in df.columns]


def feature_matrix(df: DataFrame, keep: tuple[str, ...] = ("event_id",),
                   wanted: list[str] = FEATURES) -> DataFrame:
    """Numeric features in model order, nulls as 0."""
    cols = feature_columns(df, wanted)
    return df.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])


def attach_features(log: DataFrame, features: DataFrame) -> DataFrame:
    """Merge externally computed features back onto the log."""
    extra = [c for c in features.columns if c == "event_id" or c not in log.columns]
    return log.join(features.select(*extra), "event_id", "left")


def shared_devices(log: DataFrame) -> DataFrame:
    """Events on a device that normal rows tie to another user.

    Another owner exists exactly when the smallest or largest owner differs
    from the user, so one row per device is enough.
    """
    owners = (log.filter(F.col("label") == "normal").groupBy("device_id")
              .agg(F.min("user_id").alias("_lo"), F.max("user_id").alias("_hi")))
    other = (F.col("_lo") != F.col("user_id")) | (F.col("_hi") != F.col("user_id"))
    return log.join(owners, "device_id", "left").withColumn(
        "shared_device", F.coalesce(other, F.lit(False)).cast("int")).drop("_lo", "_hi")

