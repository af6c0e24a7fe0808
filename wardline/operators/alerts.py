"""The alert queue: filters, search, pages, feedback and KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wardline.sources.schema import FEEDBACK_ACTIONS, SUMMARY_COLUMNS

RETRAIN_EVERY = 50


def queue_filter(attack_type: str | None = None, status: str | None = None,
                 min_risk: int = 0) -> Column:
    if not 0 <= min_risk <= 100:
        raise ValueError("min_risk must be within 0..100")
    test = F.lit(True)
    if attack_type:
        test = test & (F.col("attack_type") == attack_type)
    if status:
        test = test & (F.col("status") == status)
    if min_risk > 0:
        test = test & (F.col("risk_score") >= min_risk)
    return test


def queue(alerts: DataFrame, page: int = 1, limit: int = 20, **filters) -> DataFrame:
    """One page of the queue, highest risk and newest first."""
    if page < 1 or not 1 <= limit <= 100:
        raise ValueError("page starts at 1 and limit is within 1..100")
    return (
        alerts.filter(queue_filter(**filters))
        .orderBy(F.desc("risk_score"), F.desc("timestamp"), "id")
        .select(*[c for c in SUMMARY_COLUMNS if c in alerts.columns])
        .offset((page - 1) * limit).limit(limit)
    )


def queue_size(alerts: DataFrame, limit: int = 20, **filters) -> DataFrame:
    """Total rows and pages of a filtered queue."""
    return alerts.filter(queue_filter(**filters)).agg(F.count(F.lit(1)).alias("total")).withColumn(
        "pages", F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(limit))))


def search(alerts: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring over user, resource, city and reason."""
    needle = text.lower()
    hit = F.lit(False)
    for c in ("user_id", "resource_accessed", "geo_city", "reason"):
        hit = hit | F.lower(c).contains(needle)
    return alerts.filter(hit)


def critical(alerts: DataFrame, open_only: bool = True, risk: int = 80) -> DataFrame:
    test = F.col("risk_score") >= risk
    return alerts.filter(test & (F.col("status") == "open") if open_only else test)


def newest(alerts: DataFrame, n: int = 5) -> DataFrame:
    """Snapshot for a new subscriber."""
    return alerts.orderBy(F.desc("created_at"), "id").limit(n)


def unseen(alerts: DataFrame, stored: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """Rows to append: first per event and per id, complete, and not stored yet."""
    required = [c for c in alerts.columns if c not in ("true_label", "role")]
    order = order_by or ["created_at", "id"]
    rows = alerts.dropna(subset=required)
    # row_number() = 1 is limited map-side, so copies of one event stay cheap.
    for key in ("event_id", "id"):
        first = W.partitionBy(key).orderBy(*order)
        rows = rows.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    return (rows.join(stored.select("event_id"), "event_id", "left_anti")
            .join(stored.select("id"), "id", "left_anti"))


def valid_feedback(feedback: DataFrame, alerts: DataFrame) -> DataFrame:
    """Known actions on existing alerts."""
    return (feedback.filter(F.col("action").isin(*FEEDBACK_ACTIONS))
            .join(alerts.select(F.col("id").alias("alert_id")), "alert_id", "left_semi"))


def latest_state(feedback: DataFrame) -> DataFrame:
    """Status and latest note of each alert, folded over the feedback log."""
    when = F.struct("created_at", "id")
    verdict = F.col("action").isin("confirm", "dismiss")
    noted = F.col("note") != ""
    return feedback.groupBy("alert_id").agg(
        F.max_by(F.when(verdict, F.col("action")), F.when(verdict, when)).alias("_verdict"),
        F.max_by(F.when(noted, F.col("note")), F.when(noted, when)).alias("latest_note"),
        F.count(F.lit(1)).alias("n_feedback"),
    ).select(
        "alert_id",
        F.when(F.col("_verdict") == "confirm", "confirmed")
        .when(F.col("_verdict") == "dismiss", "dismissed").alias("verdict"),
        "latest_note", "n_feedback")


def with_status(alerts: DataFrame, feedback: DataFrame) -> DataFrame:
    """Alerts with current status and latest note; untouched ones are open."""
    state = latest_state(feedback).withColumnRenamed("alert_id", "id")
    return (alerts.drop("status").join(state, "id", "left")
            .withColumn("status", F.coalesce("verdict", F.lit("open")))
            .withColumn("n_feedback", F.coalesce("n_feedback", F.lit(0))).drop("verdict"))


def notes(alerts: DataFrame, feedback: DataFrame) -> DataFrame:
    """Feedback of each alert as rows; any number per alert."""
    return alerts.select(F.col("id").alias("alert_id"), "attack_type", "risk_score").join(
        feedback.select("alert_id", F.col("id").alias("feedback_id"), "action", "note", "created_at"),
        "alert_id")


def detail(alerts: DataFrame, feedback: DataFrame, alert_id: str) -> DataFrame:
    """One alert with its notes (newest first) and latest note.

    Nests the notes of this one alert; ``notes`` gives those of all as rows.
    """
    mine = feedback.filter(F.col("alert_id") == alert_id)
    entry = F.struct("created_at", "id", "action", "note")
    nested = mine.groupBy(F.col("alert_id").alias("id")).agg(
        F.sort_array(F.collect_list(entry), asc=False).alias("notes"))
    one = with_status(alerts.filter(F.col("id") == alert_id), mine)
    return one.join(nested, "id", "left")


def kpis(alerts: DataFrame) -> DataFrame:
    status = F.col("status")
    return alerts.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "open").alias("open"),
        F.count_if(status == "confirmed").alias("confirmed"),
        F.count_if(status == "dismissed").alias("dismissed"))


def feedback_kpis(feedback: DataFrame, batch: int = RETRAIN_EVERY) -> DataFrame:
    action = F.col("action")
    return feedback.agg(
        F.count(F.lit(1)).alias("total_feedback_labels"),
        F.count_if(action == "confirm").alias("confirmed_threats"),
        F.count_if(action == "dismiss").alias("dismissed_fps"),
        F.count_if(action == "note").alias("analyst_notes_logged"),
    ).withColumns({
        "pending_retrain_batch": F.col("total_feedback_labels") % batch,
        "retrain_trigger_threshold": F.lit(batch),
    })
