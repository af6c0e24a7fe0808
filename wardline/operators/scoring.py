"""Risk score, class confidence floor, reasons and alert rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wardline.functions import scalars as S
from wardline.sources.schema import ALERT_COLUMNS, NORMAL, SIGNALS, UNKNOWN

ALERT_RISK = 40
MIN_CONFIDENCE = 0.4
OFF_HOURS_DEVIATION = 3.0


def risk_score(anomaly, attack_type, confidence) -> Column:
    """0-100: normal at most 30, unknown 40-70, a named attack 50-100."""
    a, c, kind = F.col(anomaly), F.col(confidence), F.col(attack_type)
    unknown = (a * 0.6 + c * 0.2) * 100.0
    attack = (a * 0.4 + c * 0.6) * 100.0
    return (
        F.when(kind == NORMAL, F.least(F.lit(30), (a * 40.0).cast("int")))
        .when(kind == UNKNOWN, S.clip(unknown, 40.0, 70.0).cast("int"))
        .otherwise(S.clip(attack, 50.0, 100.0).cast("int"))
    )


def shift_normalised(decision) -> Column:
    """Decision value clipped to ±0.5 and moved to 0..1."""
    return S.clip(decision, -0.5, 0.5) + 0.5


def minmax_normalised(df: DataFrame, decision: str, out: str = "anomaly_score") -> DataFrame:
    """Scaled by the extremes of the whole batch, 0 when constant."""
    ends = df.agg(F.struct(F.min(decision).alias("lo"), F.max(decision).alias("hi"))).scalar()
    span = F.col("_ends.hi") - F.col("_ends.lo")
    return df.withColumn("_ends", ends).withColumn(
        out, F.when(span > 0, (F.col(decision) - F.col("_ends.lo")) / span).otherwise(0.0)
    ).drop("_ends")


def apply_confidence_floor(df: DataFrame, min_confidence: float | None = MIN_CONFIDENCE) -> DataFrame:
    if min_confidence is None:
        return df
    return df.withColumn("attack_type", F.when(
        F.col("confidence") < min_confidence, UNKNOWN).otherwise(F.col("attack_type")))


def is_alert() -> Column:
    return (F.col("risk_score") >= ALERT_RISK) | (F.col("attack_type") != NORMAL)


def top_deviations(n: int = 3, signals: list[str] | None = None) -> Column:
    """Signals of largest absolute value, list order on ties."""
    entries = F.array(*[
        F.struct((-F.abs(F.col(s).cast("double"))).alias("rank"), F.lit(i).alias("pos"),
                 F.lit(s).alias("feature"), F.col(s).cast("double").alias("value"))
        for i, s in enumerate(signals or SIGNALS)])
    return F.slice(F.transform(F.array_sort(entries), lambda e: F.struct(
        e["feature"].alias("feature"), e["value"].alias("value"))), 1, n)


def _join_text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def reason_text() -> Column:
    """Plain-English reason for one scored event."""
    col = F.col
    risk = col("risk_score").cast("string")
    user, device, ip = col("user_id"), col("device_id"), col("source_ip")
    novel, public = col("is_novel_device") == 1, col("is_public_ip") == 1
    fails, speed = col("rapid_failure_count"), col("travel_speed_kmh")
    top = F.get(top_deviations(1), F.lit(0))

    # The texts of each class.
    flagged = _join_text("Risk score ", risk, "/100 — flagged as ",
                         F.replace(col("attack_type"), F.lit("_"), F.lit(" ")), ".")
    travel = _join_text(
        flagged, " Login detected from ", col("geo_city"),
        " shortly after a login from a distant location (implied travel speed: ",
        F.when(speed > 0, _join_text(F.format_number(speed, 0), " km/h"))
        .otherwise("an impossible speed"),
        ", faster than any commercial aircraft). ",
        F.when(novel, _join_text("Device '", device, "' has not been seen for this user before."))
        .otherwise(""))
    brute = _join_text(
        flagged, " ", fails.cast("string"), " failed login attempt",
        F.when(fails == 1, "").otherwise("s"), " from ", ip,
        " within a 2-minute window — consistent with an automated password-guessing attack against ",
        user, ".")
    lateral = _join_text(
        flagged, " This session touched ", col("session_resource_count").cast("string"),
        " distinct resources including '", col("resource_accessed"), "' — ",
        S.fixed_decimals("resource_breadth_ratio", 1),
        "x more than this user's normal breadth. ",
        "Pattern consistent with credential compromise and internal reconnaissance.")
    parts = F.concat_ws(
        "; ",
        F.when(novel, _join_text("device '", device, "' not previously associated with ", user)),
        F.when(col("hour_deviation") >= OFF_HOURS_DEVIATION, _join_text(
            "login time is ", S.fixed_decimals("hour_deviation", 1),
            " standard deviations outside this user's normal schedule")),
        F.when(public, _join_text("access from public IP ", ip, " (unusual for this user)")))
    misuse = _join_text(
        flagged, " Successful login with: ",
        F.when(parts == "", "access pattern deviates from this user's baseline").otherwise(parts), ".")
    spoofing = _join_text(
        flagged, " Device fingerprint '", device, "' is not in ", user, "'s registered device set. ",
        F.when(public, _join_text("Access originated from public IP ", ip, ".")).otherwise(""))
    normal = _join_text("Risk score ", risk, "/100 — behaviour consistent with ", user,
                        "'s baseline. No anomalies detected.")
    unknown = _join_text(
        flagged, " Behaviour deviates from ", user,
        "'s baseline but does not match a known attack pattern. Most anomalous signal: '",
        top["feature"], "' (value: ", S.fixed_decimals(top["value"], 2),
        "). Recommend manual review.")
    cold_note = F.when(col("cold_start") == 1,
                       " [Note: using population baseline — insufficient personal history"
                       " for this user.]").otherwise("")

    kind = col("attack_type")
    body = (F.when(kind == "impossible_travel", travel).when(kind == "brute_force", brute)
            .when(kind == "lateral_movement", lateral).when(kind == "credential_misuse", misuse)
            .when(kind == "device_spoofing", spoofing).when(kind == NORMAL, normal)
            .otherwise(unknown))
    return F.trim(F.concat(body, cold_note))


def alert_id(event_id="event_id") -> Column:
    """Derived from the event, so a retried batch writes the same alert."""
    return F.sha2(F.col(event_id), 256)


def alert_rows(scored: DataFrame, created_at: Column | None = None) -> DataFrame:
    """The 26 alert columns of scored events that cross the alert condition."""
    label = F.col("label") if "label" in scored.columns else F.lit(None).cast("string")
    role = F.coalesce("role", F.lit("standard")) if "role" in scored.columns else F.lit("standard")
    return scored.filter(is_alert()).withColumns({
        "id": alert_id(), "reason": reason_text(), "status": F.lit("open"),
        "true_label": label, "role": role,
        "created_at": F.current_timestamp() if created_at is None else created_at,
    }).select(*ALERT_COLUMNS)


def richest_examples(scored: DataFrame) -> DataFrame:
    """One example per attack class: most failures, highest speed, else the first event."""
    signal = (F.when(F.col("label") == "brute_force", F.col("rapid_failure_count").cast("double"))
              .when(F.col("label") == "impossible_travel", F.col("travel_speed_kmh"))
              .otherwise(F.lit(0.0)))
    best = W.partitionBy("label").orderBy(
        F.desc("_signal"), "user_id", "timestamp", "event_id")
    return (scored.filter(F.col("label") != NORMAL).withColumn("_signal", signal)
            .withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r", "_signal"))
