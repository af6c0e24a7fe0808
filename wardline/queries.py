"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.functions import scalars as S
from wardline.operators import alerts as A
from wardline.operators import adwin as AD
from wardline.operators import attribution as AT
from wardline.operators import baselines as B
from wardline.operators import classify as CL
from wardline.operators import context as C
from wardline.operators import daily as DA
from wardline.operators import drift as D
from wardline.operators import evaluate as E
from wardline.operators import features as FT
from wardline.operators import iforest as IF
from wardline.operators import rules as R
from wardline.operators import sampling as SA
from wardline.operators import scoring as SC
from wardline.operators import smote as SM
from wardline.oracles import i64, r6, sql, ts_text
from wardline.plans import dashboard as DB
from wardline.plans import models as PM
from wardline.plans import retrain as RT
from wardline.session import checkpoint, shared_dir, use_utc
from wardline.sources import stores as ST
from wardline.sources.access_log import load_log
from wardline.sources.schema import ACCESS_LOG, BASELINE_NUMBERS, CLASSES, FEATURES
from wardline.streaming import hot_path as HP
from wardline.streaming import late as LA
from wardline.streaming import latency as LT
from wardline.streaming import state as LS
from wardline.streaming import status as STA

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(use_utc(spark), sf_dir)

        QUERIES[fn.__name__] = run
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return run
    return register


def num(col, name=None):
    """Rounded double, as in the oracle."""
    return F.round(F.col(col).cast("double"), 6).alias(name or col)


def whole(col, name=None):
    return F.col(col).cast("long").alias(name or col)


def when_text(col, name=None):
    return S.iso_text(col).alias(name or col)


# --- inputs shared by the queries -------------------------------------------------

# Every user of the tables has 40 rows or more; a limit of 60 normal rows makes
# both personal and population baselines occur.
COLD_BELOW = 60


def train_baselines(log: DataFrame) -> B.Baselines:
    return B.fit_baselines(log)


def feature_rows(log: DataFrame) -> DataFrame:
    return FT.build_features(log, train_baselines(log), min_events=COLD_BELOW)


def standin_scores(rows: DataFrame) -> DataFrame:
    """Deterministic score and confidence from the event number, for exact checks."""
    n = F.substr("event_id", F.lit(5)).cast("long")
    return rows.withColumns({
        "n": n,
        "anomaly_score": (n % 97).cast("double") / 96.0,
        "confidence": (n % 60 + 40).cast("double") / 100.0,
    })


def standin_risk(rows: DataFrame) -> DataFrame:
    floored = F.when((F.col("confidence") < 0.45) & (F.col("label") != "normal"),
                     "unknown_anomaly").otherwise(F.col("label"))
    return standin_scores(rows).withColumn("attack_type", floored).withColumn(
        "risk_score", SC.risk_score("anomaly_score", "attack_type", "confidence"))


def shifted(col: str, seconds: int):
    return F.timestamp_micros(F.unix_micros(col) + seconds * 1_000_000)


def standin_alerts(log: DataFrame) -> DataFrame:
    """Alert rows over the stand-in score; ids follow the event for exact checks."""
    scored = standin_risk(feature_rows(log))
    return SC.alert_rows(scored, shifted("timestamp", 60)).withColumns({
        "id": F.concat(F.lit("al_"), "event_id"),
        "n": F.substr("event_id", F.lit(5)).cast("long")})


def standin_feedback(alerts: DataFrame) -> DataFrame:
    n = F.col("n")
    verdicts = alerts.filter(n % 3 == 0).select(
        (n * 2).alias("id"), F.col("id").alias("alert_id"),
        F.when(n % 2 == 0, "confirm").otherwise("dismiss").alias("action"),
        F.when(n % 5 == 0, F.concat(F.lit("reviewed "), "event_id")).alias("note"),
        shifted("timestamp", 3600).alias("created_at"))
    notes = alerts.filter(n % 4 == 0).select(
        (n * 2 + 1).alias("id"), F.col("id").alias("alert_id"), F.lit("note").alias("action"),
        F.when(n % 8 == 0, "").otherwise(F.concat(F.lit("note "), "user_id")).alias("note"),
        shifted("timestamp", 7200).alias("created_at"))
    return verdicts.unionByName(notes)


# --- log, baselines, features -----------------------------------------------------

_LOG = ["event_id", "user_id", "device_id", "source_ip", "geo_city", "resource_accessed",
        "action", "auth_method", "success", "label", "role"]


@query(sql(f"SELECT {', '.join(_LOG)}, {ts_text('timestamp')}, {r6('geo_lat')}, {r6('geo_lon')}, "
           f"{i64('session_duration_s')}, {i64('bytes_transferred')} FROM access_log", "access_log"))
def access_log_view(spark, sf_dir):
    return load_log(spark, sf_dir).select(
        *_LOG, when_text("timestamp"), num("geo_lat"), num("geo_lon"),
        whole("session_duration_s"), whole("bytes_transferred"))


@query(sql("SELECT label, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share "
           "FROM access_log GROUP BY label", "access_log"))
def label_distribution(spark, sf_dir):
    return E.label_distribution(load_log(spark, sf_dir)).select("label", "n", num("share"))


_BASE = [c for c in BASELINE_NUMBERS if not c.startswith("n_") and c != "event_count"]
_BASE_INT = ["n_distinct_resources", "n_devices", "event_count"]


@query(sql(f"SELECT user_id, {', '.join(r6(c) for c in _BASE)}, {', '.join(i64(c) for c in _BASE_INT)}, "
           "home_city, role, array_to_string(known_devices, ',') AS known_devices, "
           "array_to_string(known_ips, ',') AS known_ips FROM stats", "stats"))
def user_baselines(spark, sf_dir):
    return B.user_baselines(load_log(spark, sf_dir)).select(
        "user_id", *[num(c) for c in _BASE], *[whole(c) for c in _BASE_INT], "home_city", "role",
        F.array_join("known_devices", ",").alias("known_devices"),
        F.array_join("known_ips", ",").alias("known_ips"))


@query(sql("SELECT label FROM (VALUES " + ", ".join(f"('{c}')" for c in CLASSES) + ") AS e(label) WHERE label NOT IN "
           "(SELECT label FROM access_log WHERE CAST(substr(event_id, 5) AS BIGINT) % 100 <> 0)", "access_log"))
def missing_classes(spark, sf_dir):
    """Classes that events of several rows alone have."""
    first_rows = F.substr("event_id", F.lit(5)).cast("long") % 100 != 0
    return E.missing_classes(load_log(spark, sf_dir).filter(first_rows))


def log_days(log: DataFrame, least: int = 0) -> list:
    """The days of the log in order; one row per day."""
    return [r["day"] for r in log.select(F.to_date("timestamp").alias("day")).distinct().orderBy("day").collect()][-least:]


@query(ORACLES["user_baselines"])
def baselines_refreshed(spark, sf_dir):
    """All days but the last folded from partials, then the last one taken in by itself."""
    log, root = load_log(spark, sf_dir), ST.fresh_dir(shared_dir(spark), "baselines")
    *earlier, last = log_days(log)
    kept, day = DA.DailyBaselines(spark, root), F.to_date("timestamp")
    kept.add_days(log.filter(day < F.lit(last)))
    kept.fold(earlier[-1])
    kept.refresh(log.filter(day == F.lit(last)), last)
    return kept.load().select(
        "user_id", *[num(c) for c in _BASE], *[whole(c) for c in _BASE_INT], "home_city", "role",
        F.array_join("known_devices", ",").alias("known_devices"), F.array_join("known_ips", ",").alias("known_ips"))


@query(sql("SELECT user_id, device_id AS value, count(*) AS n_events FROM normal_log GROUP BY ALL", "normal_log"))
def known_devices(spark, sf_dir):
    return B.known_values(load_log(spark, sf_dir), "device_id")


@query(sql("SELECT user_id, source_ip AS value, count(*) AS n_events FROM normal_log GROUP BY ALL", "normal_log"))
def known_ips(spark, sf_dir):
    return B.known_values(load_log(spark, sf_dir), "source_ip")


_MEDIANS = ", ".join(f"round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS {c}" for c in BASELINE_NUMBERS)


@query(sql(f"SELECT {_MEDIANS} FROM stats", "stats"))
def population_baseline(spark, sf_dir):
    return B.fit_baselines(load_log(spark, sf_dir)).population.select(
        *[num(c) for c in BASELINE_NUMBERS])


@query(sql(f"SELECT r.role, r.n_users, "
           + ", ".join(f"CASE WHEN r.n_users >= 40 THEN r.{c} ELSE a.{c} END AS {c}" for c in BASELINE_NUMBERS)
           + f" FROM (SELECT role, count(*) AS n_users, {_MEDIANS} FROM stats GROUP BY role) r "
           f"CROSS JOIN (SELECT {_MEDIANS} FROM stats) a", "stats"))
def role_baseline(spark, sf_dir):
    # 40 users per role splits the roles of the small tables into both cases.
    return B.role_baseline(B.user_baselines(load_log(spark, sf_dir)), min_users=40).select(
        "role", "n_users", *[num(c) for c in BASELINE_NUMBERS])


@query(sql(f"SELECT event_id, {i64('session_resource_count')}, {i64('rapid_failure_count')}, "
           f"{r6('travel_speed_kmh')}, {i64('is_impossible_travel')}, {i64('city_changed')} FROM context", "context"))
def window_features(spark, sf_dir):
    return C.context_features(load_log(spark, sf_dir)).select(
        "event_id", whole("session_resource_count"), whole("rapid_failure_count"),
        num("travel_speed_kmh"), whole("is_impossible_travel"), whole("city_changed"))


@query(sql("""SELECT a.event_id, count(b.event_id) AS failures_in_window FROM access_log a
LEFT JOIN access_log b ON b.user_id = a.user_id AND b.source_ip = a.source_ip AND NOT b.success
  AND b.us < a.us AND b.us >= a.us - 120000000 GROUP BY a.event_id""", "access_log"))
def failures_in_window(spark, sf_dir):
    return C.uncapped_failures(load_log(spark, sf_dir)).select("event_id", whole("failures_in_window"))


_FLOATS = ["hour_deviation", "session_z", "bytes_z", "resource_breadth_ratio", "travel_speed_kmh"]
_INTS = [c for c in FEATURES if c not in _FLOATS]


@query(sql(f"SELECT event_id, baseline_type, {', '.join(r6(c) for c in _FLOATS)}, "
           f"{', '.join(i64(c) for c in _INTS)} FROM features", "features"))
def deviation_features(spark, sf_dir):
    return feature_rows(load_log(spark, sf_dir)).select(
        "event_id", "baseline_type", *[num(c) for c in _FLOATS], *[whole(c) for c in _INTS])


@query(sql("SELECT label, count(*) AS n, CAST(sum(is_novel_device) AS BIGINT) AS novel FROM features GROUP BY label",
           "features"))
def novel_devices(spark, sf_dir):
    log = load_log(spark, sf_dir)
    rows = FT.build_features(log, train_baselines(log), stateful=False)
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("is_novel_device").alias("novel"))


@query(sql("""SELECT l.event_id, CASE WHEN EXISTS (SELECT 1 FROM normal_log n
  WHERE n.device_id = l.device_id AND n.user_id <> l.user_id) THEN 1 ELSE 0 END AS shared_device FROM access_log l""",
           "access_log", "normal_log"))
def shared_devices(spark, sf_dir):
    return FT.shared_devices(load_log(spark, sf_dir)).select("event_id", "shared_device")


# --- rules ------------------------------------------------------------------------

def rule_rows(log: DataFrame) -> DataFrame:
    """What the rules read; no baseline is among it."""
    return C.context_features(log).withColumn("is_public_ip", S.is_public_ip("source_ip"))


@query(sql("SELECT event_id, user_id, rule, severity, detail FROM violations", "violations"))
def rule_alerts(spark, sf_dir):
    return R.rule_alerts(rule_rows(load_log(spark, sf_dir))).drop("timestamp")


@query(sql("SELECT user_id, rule, severity, count(*) AS n FROM violations GROUP BY ALL", "violations"))
def rule_summary(spark, sf_dir):
    return R.rule_alerts(rule_rows(load_log(spark, sf_dir))).groupBy("user_id", "rule", "severity").agg(
        F.count(F.lit(1)).alias("n"))


@query(sql(f"""SELECT event_id, user_id, rule, {r6('reading')}, threshold, unit, min_risk FROM (
SELECT event_id, user_id, 'impossible_travel' AS rule, travel_speed_kmh AS reading, CAST(800 AS DOUBLE) AS threshold,
  'km/h' AS unit, 80 AS min_risk FROM features WHERE travel_speed_kmh > 800
UNION ALL SELECT event_id, user_id, 'brute_force', CAST(rapid_failure_count AS DOUBLE), 10.0, 'failures / 2 min', 85
  FROM features WHERE rapid_failure_count >= 10
UNION ALL SELECT event_id, user_id, 'off_hours', hour_deviation, 3.5, 'std dev (σ)', 70 FROM features WHERE hour_deviation > 3.5)""",
           "features"))
def rule_policy_alerts(spark, sf_dir):
    return R.policy_alerts(feature_rows(load_log(spark, sf_dir)), R.default_policy(spark)).select(
        "event_id", "user_id", "rule", num("reading"), "threshold", "unit", "min_risk")


# --- scoring ----------------------------------------------------------------------

@query(sql(f"SELECT event_id, attack_type, {r6('anomaly_score')}, {r6('confidence')}, {i64('risk_score')}, "
           "CASE WHEN risk_score >= 40 OR attack_type <> 'normal' THEN 1 ELSE 0 END AS alert FROM risked", "risked"))
def risk_scores(spark, sf_dir):
    return standin_risk(load_log(spark, sf_dir)).select(
        "event_id", "attack_type", num("anomaly_score"), num("confidence"), whole("risk_score"),
        SC.is_alert().cast("int").alias("alert"))


@query(sql(f"""SELECT event_id, {r6("least(greatest(d, -0.5), 0.5) + 0.5", 'shifted')}, {r6("(d - lo) / (hi - lo)", 'scaled')}
FROM (SELECT event_id, anomaly_score * 1.6 - 0.8 AS d FROM standin)
CROSS JOIN (SELECT min(anomaly_score * 1.6 - 0.8) AS lo, max(anomaly_score * 1.6 - 0.8) AS hi FROM standin)""", "standin"))
def normalised_scores(spark, sf_dir):
    rows = standin_scores(load_log(spark, sf_dir)).withColumn("d", F.col("anomaly_score") * 1.6 - 0.8)
    return SC.minmax_normalised(rows, "d", "scaled").withColumn("shifted", SC.shift_normalised("d")).select(
        "event_id", num("shifted"), num("scaled"))


@query(sql("SELECT event_id, attack_type, risk_score, reason FROM reasons", "reasons"))
def reason_strings(spark, sf_dir):
    return standin_risk(feature_rows(load_log(spark, sf_dir))).select(
        "event_id", "attack_type", "risk_score", SC.reason_text().alias("reason"))


@query(sql(f"SELECT event_id, r AS rank, feature, {r6('value')} FROM signal_rank WHERE r <= 3", "signal_rank"))
def top_deviations(spark, sf_dir):
    rows = standin_risk(feature_rows(load_log(spark, sf_dir)))
    return rows.select("event_id", F.posexplode(SC.top_deviations(3)).alias("pos", "d")).select(
        "event_id", (F.col("pos") + 1).cast("long").alias("rank"), F.col("d.feature").alias("feature"),
        F.round("d.value", 6).alias("value"))


# --- alert queue and feedback -------------------------------------------------------

def status_rows(log: DataFrame) -> DataFrame:
    alerts = standin_alerts(log)
    return A.with_status(alerts, standin_feedback(alerts))


@query(sql(f"SELECT id, {ts_text('timestamp')}, user_id, geo_city, resource_accessed, action, risk_score, attack_type, "
           f"{r6('confidence')}, reason, baseline_type, status FROM status WHERE status = 'open' AND risk_score >= 60 "
           "ORDER BY risk_score DESC, us DESC, id LIMIT 15 OFFSET 15", "status"))
def alert_queue_page(spark, sf_dir):
    page = A.queue(status_rows(load_log(spark, sf_dir)), page=2, limit=15, status="open", min_risk=60)
    return page.withColumns({"timestamp": S.iso_text("timestamp"), "confidence": F.round("confidence", 6)})


@query(sql("SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 15.0)) AS BIGINT) AS pages "
           "FROM alerts WHERE attack_type = 'brute_force'", "alerts"))
def alert_queue_size(spark, sf_dir):
    return A.queue_size(standin_alerts(load_log(spark, sf_dir)), 15, attack_type="brute_force")


@query(sql("SELECT id, user_id, geo_city, resource_accessed, reason FROM alerts WHERE contains(lower(user_id), 'oslo') "
           "OR contains(lower(resource_accessed), 'oslo') OR contains(lower(geo_city), 'oslo') OR contains(lower(reason), 'oslo')",
           "alerts"))
def alert_search(spark, sf_dir):
    return A.search(standin_alerts(load_log(spark, sf_dir)), "Oslo").select(
        "id", "user_id", "geo_city", "resource_accessed", "reason")


@query(sql("SELECT a.id AS alert_id, a.attack_type, a.risk_score, f.id AS feedback_id, f.action, f.note, f.made_us AS created_us "
           "FROM alerts a JOIN feedback f ON f.alert_id = a.id", "alerts", "feedback"))
def alert_notes(spark, sf_dir):
    alerts = standin_alerts(load_log(spark, sf_dir))
    return A.notes(alerts, standin_feedback(alerts)).withColumn(
        "created_us", F.unix_micros("created_at")).drop("created_at")


@query(sql("SELECT id, status, latest_note, n_feedback FROM status", "status"))
def alert_status(spark, sf_dir):
    return status_rows(load_log(spark, sf_dir)).select("id", "status", "latest_note", "n_feedback")


@query(sql("SELECT id, user_id, risk_score, created_us FROM alerts ORDER BY created_us DESC, id LIMIT 5", "alerts"))
def recent_alerts(spark, sf_dir):
    return A.newest(standin_alerts(load_log(spark, sf_dir))).select(
        "id", "user_id", "risk_score", F.unix_micros("created_at").alias("created_us"))


@query(sql("SELECT id, event_id FROM alerts WHERE NOT (n % 3 = 0)", "alerts"))
def alert_upsert(spark, sf_dir):
    """A batch with copies against a store that already holds a third of it."""
    alerts = standin_alerts(load_log(spark, sf_dir))
    stored = alerts.filter("n % 3 = 0")
    copies = alerts.withColumns({"id": F.concat("id", F.lit("_again")), "created_at": shifted("created_at", 9)})
    return A.unseen(alerts.unionByName(copies), stored).select("id", "event_id")


@query(sql("SELECT id, event_id, us AS event_us FROM alerts", "alerts"))
def alert_first_wins(spark, sf_dir):
    """Two batches and then all events again, each copy ten days later: the first of an event stays."""
    alerts = checkpoint(standin_alerts(load_log(spark, sf_dir)).drop("n"))
    middle = F.lit(alerts.agg(F.percentile_approx(F.unix_micros("timestamp"), 0.5)).first()[0])
    early = F.unix_micros("timestamp") < middle
    path = ST.fresh_dir(shared_dir(spark), "first-wins")

    def again(rows):
        return rows.withColumns({"id": F.concat("id", F.lit("_again")), "timestamp": shifted("timestamp", 10 * 86_400)})

    for i, rows in enumerate((alerts.filter(early), again(alerts.filter(early)).unionByName(alerts.filter(~early)), again(alerts))):
        ST.append_alerts(rows, path, f"b{i}", pruned=True)
    return ST.read_alerts(spark, path).select("id", "event_id", F.unix_micros("timestamp").alias("event_us"))


@query(sql("SELECT count(*) AS total, count(*) FILTER (WHERE status = 'open') AS open, "
           "count(*) FILTER (WHERE status = 'confirmed') AS confirmed, "
           "count(*) FILTER (WHERE status = 'dismissed') AS dismissed FROM status", "status"))
def alert_kpis(spark, sf_dir):
    return A.kpis(status_rows(load_log(spark, sf_dir)))


@query(sql("SELECT count(*) AS total_feedback_labels, count(*) FILTER (WHERE action = 'confirm') AS confirmed_threats, "
           "count(*) FILTER (WHERE action = 'dismiss') AS dismissed_fps, count(*) FILTER (WHERE action = 'note') AS analyst_notes_logged, "
           "count(*) % 50 AS pending_retrain_batch, 50 AS retrain_trigger_threshold FROM feedback", "feedback"))
def feedback_kpis(spark, sf_dir):
    return A.feedback_kpis(standin_feedback(standin_alerts(load_log(spark, sf_dir))))


@query(sql("SELECT f.id, f.alert_id, f.action FROM feedback f JOIN alerts a ON a.id = f.alert_id "
           "WHERE a.risk_score >= 60 AND f.action IN ('confirm', 'dismiss', 'note')", "feedback", "alerts"))
def feedback_accepted(spark, sf_dir):
    """Feedback is only taken for alerts that exist; here those of risk 60 and up."""
    alerts = standin_alerts(load_log(spark, sf_dir))
    return A.valid_feedback(standin_feedback(alerts), alerts.filter("risk_score >= 60")).select(
        "id", "alert_id", "action")


@query(sql("SELECT count(*) FILTER (WHERE event_count < 60) AS cold_start_users FROM stats", "stats"))
def cold_start_users(spark, sf_dir):
    return B.cold_start_users(B.user_baselines(load_log(spark, sf_dir)), min_events=COLD_BELOW)


@query(sql("SELECT user_id, CASE WHEN event_count >= 60 THEN 'personal' ELSE 'population' END AS baseline_type FROM stats", "stats"))
def baseline_types(spark, sf_dir):
    return B.user_baselines(load_log(spark, sf_dir)).select(
        "user_id", B.baseline_type(F.col("event_count"), COLD_BELOW).alias("baseline_type"))


@query(sql("SELECT id, risk_score, attack_type FROM status WHERE risk_score >= 80 AND status = 'open'", "status"))
def critical_open(spark, sf_dir):
    return A.critical(status_rows(load_log(spark, sf_dir))).select("id", "risk_score", "attack_type")


@query(sql("SELECT CASE WHEN risk_score >= 90 THEN 'CRITICAL' WHEN risk_score >= 70 THEN 'HIGH' WHEN risk_score >= 40 "
           "THEN 'ELEVATED' ELSE 'MINIMAL' END AS band, upper(replace(attack_type, '_', ' ')) AS title, count(*) AS n, "
           "round(avg(round(bytes_transferred / 1024.0, 1)), 3) AS mean_kb FROM risked GROUP BY ALL", "risked"))
def risk_bands(spark, sf_dir):
    return standin_risk(load_log(spark, sf_dir)).groupBy(
        S.risk_band("risk_score").alias("band"), S.class_title("attack_type").alias("title")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(S.kilobytes("bytes_transferred")), 3).alias("mean_kb"))


_TOKENS = "|".join(S.TOKEN_PATTERNS.values()).replace("'", "''")


@query(sql(f"""SELECT kind, count(*) AS n, count(DISTINCT token) AS n_distinct FROM (SELECT token,
  CASE WHEN starts_with(token, '''') THEN 'quoted' WHEN regexp_matches(token, '^([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}$') THEN 'ip' ELSE 'quantity' END AS kind
  FROM (SELECT unnest(regexp_extract_all(reason, '{_TOKENS}')) AS token FROM alerts)) GROUP BY kind""", "alerts"))
def reason_tokens(spark, sf_dir):
    tokens = standin_alerts(load_log(spark, sf_dir)).select(F.explode(S.reason_tokens("reason")).alias("token"))
    return tokens.groupBy(S.token_kind("token").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("token").alias("n_distinct"))


@query(sql("SELECT id, trim(split_part(reason, '.', 1)) AS headline FROM alerts", "alerts"))
def first_sentences(spark, sf_dir):
    return standin_alerts(load_log(spark, sf_dir)).select("id", S.first_sentence("reason").alias("headline"))


@query(sql(f"""SELECT a.id AS alert_id, l.event_id, l.action, l.resource_accessed, l.success,
  {r6('(a.us - l.us) / 1000000.0', 'seconds_before')} FROM alerts a JOIN ordered_log o ON o.event_id = a.event_id
  JOIN ordered_log l ON l.user_id = a.user_id AND l.rn < o.rk AND l.rn >= o.rk - 30 AND l.us >= a.us - 3600000000""",
           "alerts", "ordered_log"))
def alert_timeline(spark, sf_dir):
    log = load_log(spark, sf_dir)
    return C.timelines(log, standin_alerts(log)).withColumn("seconds_before", F.round("seconds_before", 6))


@query(sql("""SELECT label, event_id FROM (SELECT label, event_id, row_number() OVER (PARTITION BY label ORDER BY
  CASE label WHEN 'brute_force' THEN CAST(rapid_failure_count AS DOUBLE) WHEN 'impossible_travel' THEN travel_speed_kmh ELSE 0 END DESC,
  user_id, timestamp, event_id) AS r FROM context WHERE label <> 'normal') WHERE r = 1""", "context"))
def richest_examples(spark, sf_dir):
    return SC.richest_examples(C.context_features(load_log(spark, sf_dir))).select("label", "event_id")


# --- drift --------------------------------------------------------------------------

# The tables span 30 days, so each window is 15 days long.
DAYS = 15
_SPLIT = f"""(SELECT *, CASE WHEN us >= e - {DAYS}*86400000000 THEN 1 ELSE 0 END AS r FROM access_log
  CROSS JOIN (SELECT max(us) AS e FROM access_log) WHERE us >= e - {2 * DAYS}*86400000000)"""


def _ks_sql(source: str, key: str, value: str) -> str:
    return f"""SELECT {key}, n_recent, n_baseline, ks_stat, CASE WHEN least(n_recent, n_baseline) < 10 THEN 1.0
    WHEN lam < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101),
      lambda k: CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * k * k * lam * lam))))) END AS p_value
  FROM (SELECT *, x + 1 / (6 * s) + (x - 1) / (4 * s * s) AS lam FROM (
    SELECT *, sqrt(en) AS s, sqrt(en) * ks_stat AS x FROM (
    SELECT {key}, max(nr) AS n_recent, max(nb) AS n_baseline, round(CAST(max(nr) AS DOUBLE) * max(nb) / (max(nr) + max(nb))) AS en,
      max(abs(cr / CAST(nr AS DOUBLE) - cb / CAST(nb AS DOUBLE))) AS ks_stat
    FROM (SELECT {key}, sum(wr) OVER c AS cr, sum(wb) OVER c AS cb, sum(wr) OVER g AS nr, sum(wb) OVER g AS nb
      FROM (SELECT {key}, {value}, sum(r) AS wr, sum(1 - r) AS wb FROM {source} WHERE {value} IS NOT NULL GROUP BY {key}, {value})
      WINDOW c AS (PARTITION BY {key} ORDER BY {value}), g AS (PARTITION BY {key})) GROUP BY {key})))"""


_USER_KS = _ks_sql(f"(SELECT user_id, hour(timestamp) AS h, r FROM {_SPLIT})", "user_id", "h")
_POP_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v, r FROM {_SPLIT}" for c in ("session_duration_s", "bytes_transferred"))
_POP_KS = _ks_sql(f"({_POP_LONG})", "feature", "v")
_KS_OUT = f"{i64('n_recent')}, {i64('n_baseline')}, {r6('ks_stat')}, {r6('p_value')}, p_value < 0.01 AS drifted"


def _ks_out(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, whole("n_recent"), whole("n_baseline"), num("ks_stat"), num("p_value"), "drifted")


@query(sql(f"SELECT user_id, {_KS_OUT} FROM ({_USER_KS})", "access_log"))
def drift_users(spark, sf_dir):
    return _ks_out(D.user_drift(load_log(spark, sf_dir), DAYS, "asymptotic"), "user_id")


# The last days of the log, each as the end of the windows.
_ENDS = 3
_DAY_OF = f"(SELECT d FROM (SELECT DISTINCT CAST(timestamp AS DATE) AS d FROM access_log ORDER BY d DESC LIMIT 1 OFFSET {{i}}))"
_ROLLING = " UNION ALL ".join(
    f"SELECT CAST({_DAY_OF.format(i=i)} AS VARCHAR) AS day, user_id, {_KS_OUT} FROM ("
    + _USER_KS.replace("access_log", f"(SELECT * FROM access_log WHERE CAST(timestamp AS DATE) <= {_DAY_OF.format(i=i)})") + ")"
    for i in range(_ENDS))


@query(sql(_ROLLING, "access_log"))
def drift_rolling(spark, sf_dir):
    """Windows moved day by day over the last days of the log."""
    log, root = load_log(spark, sf_dir), ST.fresh_dir(shared_dir(spark), "rolling")
    rolling, found = DA.RollingDrift(spark, root, DAYS), None
    rolling.add_days(log)
    for end in log_days(log, _ENDS):
        rolling.advance(end)
        day = rolling.drift(log, "asymptotic").withColumn("day", F.lit(str(end)))
        found = day if found is None else found.unionByName(day)
    return found.select("day", "user_id", whole("n_recent"), whole("n_baseline"), num("ks_stat"), num("p_value"), "drifted")


@query()
def drift_users_exact(spark, sf_dir):
    return _ks_out(D.user_drift(load_log(spark, sf_dir), DAYS, "auto"), "user_id")


@query(sql(f"SELECT feature, {_KS_OUT} FROM ({_POP_KS})", "access_log"))
def drift_population(spark, sf_dir):
    return _ks_out(D.population_drift(load_log(spark, sf_dir), days=DAYS, method="asymptotic"), "feature")


@query(sql(f"""SELECT {DAYS} AS window_days, count(*) AS users_checked, count(*) FILTER (WHERE p_value < 0.01) AS users_drifted,
  bool_or(p_value < 0.01) OR (SELECT bool_or(p_value < 0.01) FROM ({_POP_KS})) AS global_drift_detected FROM ({_USER_KS})""",
           "access_log"))
def drift_summary(spark, sf_dir):
    log = load_log(spark, sf_dir)
    return D.drift_summary(D.user_drift(log, DAYS, "asymptotic"),
                           D.population_drift(log, days=DAYS, method="asymptotic"), DAYS)


@query(sql(f"SELECT user_id, {r6('p_value')} FROM ({_USER_KS}) WHERE p_value < 0.01 ORDER BY p_value, user_id LIMIT 10",
           "access_log"))
def drift_worst_users(spark, sf_dir):
    users = D.user_drift(load_log(spark, sf_dir), DAYS, "asymptotic")
    return D.first_drifted(users).select("user_id", num("p_value"))


_DAILY = f"""(SELECT d.user_id, d.day, d.r, off_hours_login, session_duration_s, bytes_transferred, geo_distance_from_home,
  failed_login_rate, resource_rarity_score, distinct_hosts_count, auth_method_entropy FROM (
  SELECT l.user_id, CAST(l.timestamp AS DATE) AS day, l.r,
    avg(least(abs(hour(l.timestamp) - s.mean_hour), 24 - abs(hour(l.timestamp) - s.mean_hour))) AS off_hours_login,
    avg(l.session_duration_s) AS session_duration_s, avg(l.bytes_transferred) AS bytes_transferred,
    avg(12742.0 * asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians(h.lat) - radians(l.geo_lat)) / 2), 2)
      + cos(radians(l.geo_lat)) * cos(radians(h.lat)) * pow(sin((radians(h.lon) - radians(l.geo_lon)) / 2), 2)))))) AS geo_distance_from_home,
    CASE WHEN count(*) FILTER (WHERE l.action = 'login') > 0 THEN count(*) FILTER (WHERE l.action = 'login' AND NOT l.success)
      / CAST(count(*) FILTER (WHERE l.action = 'login') AS DOUBLE) END AS failed_login_rate,
    avg(q.rarity) AS resource_rarity_score, count(DISTINCT l.resource_accessed) AS distinct_hosts_count
  FROM {_SPLIT} l JOIN stats s ON s.user_id = l.user_id
  JOIN (SELECT user_id, geo_city, round(avg(geo_lat), 6) AS lat, round(avg(geo_lon), 6) AS lon FROM normal_log GROUP BY user_id, geo_city) h
    ON h.user_id = s.user_id AND h.geo_city = s.home_city
  JOIN (SELECT resource_accessed, CASE WHEN c > 0 THEN -ln(c / CAST(sum(c) OVER () AS DOUBLE)) END AS rarity FROM (
    SELECT resource_accessed, count(*) FILTER (WHERE r = 0) AS c FROM {_SPLIT} GROUP BY resource_accessed)) q
    ON q.resource_accessed = l.resource_accessed
  GROUP BY l.user_id, CAST(l.timestamp AS DATE), l.r) d
  JOIN (SELECT user_id, day, r, sum(-p * ln(p)) AS auth_method_entropy FROM (
    SELECT user_id, CAST(timestamp AS DATE) AS day, r, auth_method,
      count(*) / CAST(sum(count(*)) OVER (PARTITION BY user_id, CAST(timestamp AS DATE), r) AS DOUBLE) AS p
    FROM {_SPLIT} GROUP BY user_id, CAST(timestamp AS DATE), r, auth_method) GROUP BY user_id, day, r) e
  ON e.user_id = d.user_id AND e.day = d.day AND e.r = d.r)"""
# Rounded on both sides, so that equal values of two engines stay one value.
_DAILY_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(CAST({c} AS DOUBLE), 6) + 0.0 AS v, r FROM daily" for c in D.REPORT_FEATURES)
_REPORT_KS = _ks_sql("long", "feature", "v")


@query(sql("SELECT * FROM (WITH daily AS (SELECT * FROM " + _DAILY + "), long AS (" + _DAILY_LONG + f""")
SELECT k.feature, {r6('ks_stat')}, {r6('p_value')}, {r6('baseline_mean')}, {r6('recent_mean')},
  CASE WHEN p_value < 0.05 THEN 'DRIFTING' WHEN p_value < 0.15 THEN 'MONITOR' ELSE 'STABLE' END AS status
FROM ({_REPORT_KS}) k JOIN (SELECT feature, avg(v) FILTER (WHERE r = 0) AS baseline_mean,
  avg(v) FILTER (WHERE r = 1) AS recent_mean FROM long GROUP BY feature) m ON m.feature = k.feature)""",
           "access_log", "normal_log", "stats"))
def drift_feature_report(spark, sf_dir):
    log = load_log(spark, sf_dir)
    return D.feature_report(log, B.user_baselines(log), DAYS).select(
        "feature", num("ks_stat"), num("p_value"), num("baseline_mean"), num("recent_mean"), "status")


# --- evaluation ---------------------------------------------------------------------

def judged(log: DataFrame) -> DataFrame:
    """Stand-in score against the true label."""
    return standin_scores(log).withColumn("attack", (F.col("label") != "normal").cast("int"))


_AUC = """SELECT (sum(rk) FILTER (WHERE y = 1) - CAST(max(p) AS DOUBLE) * (max(p) + 1) / 2) / (CAST(max(p) AS DOUBLE) * max(n)) AS roc_auc
FROM (SELECT y, sum(y) OVER () AS p, sum(1 - y) OVER () AS n,
  rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM judged)"""
_AP = """SELECT sum(dp * cp / CAST(cn AS DOUBLE)) / sum(dp) AS pr_auc FROM (
SELECT dp, sum(dp) OVER w AS cp, sum(c) OVER w AS cn FROM (SELECT s, sum(y) AS dp, count(*) AS c FROM judged GROUP BY s)
WINDOW w AS (ORDER BY s DESC))"""


@query(sql(f"""SELECT {r6('roc_auc')}, {r6('pr_auc')}, {r6('threshold')}, tp, fp, fn, tn,
  {r6('tp / CAST(greatest(tp + fp, 1) AS DOUBLE)', 'precision')}, {r6('tp / CAST(greatest(tp + fn, 1) AS DOUBLE)', 'recall')},
  {r6('fp / CAST(greatest(fp + tn, 1) AS DOUBLE)', 'fpr')}
FROM (WITH judged AS (SELECT anomaly_score AS s, CASE WHEN label <> 'normal' THEN 1 ELSE 0 END AS y FROM standin),
  cut AS (SELECT quantile_cont(s, 0.98) AS threshold FROM judged)
SELECT (SELECT roc_auc FROM ({_AUC})) AS roc_auc, (SELECT pr_auc FROM ({_AP})) AS pr_auc, max(threshold) AS threshold,
  count(*) FILTER (WHERE s >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE s >= threshold AND y = 0) AS fp,
  count(*) FILTER (WHERE s < threshold AND y = 1) AS fn, count(*) FILTER (WHERE s < threshold AND y = 0) AS tn
FROM judged CROSS JOIN cut)""", "standin"))
def eval_binary(spark, sf_dir):
    rep = E.binary_report(judged(load_log(spark, sf_dir)), "anomaly_score", "attack")
    return rep.select(*[num(c) for c in ("roc_auc", "pr_auc", "threshold", "precision", "recall", "fpr")],
                      "tp", "fp", "fn", "tn")


def guessed(log: DataFrame) -> DataFrame:
    """Stand-in class guess: every seventh event moves to the next class of the list."""
    names = F.array(*[F.lit(c) for c in CLASSES])
    at = F.array_position(names, F.col("label")).cast("int") - 1
    rows = standin_scores(log)
    return rows.withColumn("guess", F.get(names, F.when(
        F.col("n") % 7 == 0, (at + 1) % len(CLASSES)).otherwise(at)))


_CLASS_LIST = "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"
_GUESSED = f"""(SELECT *, {_CLASS_LIST}[1 + CAST((list_position({_CLASS_LIST}, label) - 1 + CASE WHEN n % 7 = 0 THEN 1 ELSE 0 END) % 6 AS INT)] AS guess
  FROM standin)"""


@query(sql(f"""SELECT class, {r6('precision')}, {r6('recall')}, {r6('CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END', 'f1')},
  support, CASE WHEN precision >= 0.9 THEN 'Excellent' WHEN precision >= 0.8 THEN 'Good' WHEN precision >= 0.7 THEN 'Fair' ELSE 'Poor' END AS rating
FROM (SELECT class, coalesce(tp / CAST(nullif(pp, 0) AS DOUBLE), 0) AS precision, coalesce(tp / CAST(nullif(support, 0) AS DOUBLE), 0) AS recall, support
  FROM (SELECT class, count(*) FILTER (WHERE label = class AND guess = class) AS tp, count(*) FILTER (WHERE guess = class) AS pp,
    count(*) FILTER (WHERE label = class) AS support FROM {_GUESSED} CROSS JOIN (SELECT unnest({_CLASS_LIST}) AS class) GROUP BY class))
WHERE class <> 'normal'""", "standin"))
def eval_multiclass(spark, sf_dir):
    rep = E.class_report(guessed(load_log(spark, sf_dir)), "label", "guess").filter("class <> 'normal'")
    return rep.select("class", num("precision"), num("recall"), num("f1"), "support",
                      S.quality_rating("precision").alias("rating"))


@query(sql("SELECT label, " + ", ".join(f"count(*) FILTER (WHERE guess = '{c}') AS {c}" for c in CLASSES)
           + f" FROM {_GUESSED} GROUP BY label", "standin"))
def confusion(spark, sf_dir):
    return E.confusion_matrix(guessed(load_log(spark, sf_dir)), "label", "guess")


@query(sql("SELECT class, " + r6("pr_auc") + ", " + r6("roc_auc") + " FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS class, (WITH judged AS (SELECT CASE WHEN n % 3 = 0 THEN confidence ELSE 1 - confidence END AS s, CASE WHEN label = '{c}' THEN 1 ELSE 0 END AS y FROM standin) {_AP}) AS pr_auc,
    (WITH judged AS (SELECT CASE WHEN n % 3 = 0 THEN confidence ELSE 1 - confidence END AS s, CASE WHEN label = '{c}' THEN 1 ELSE 0 END AS y FROM standin) {_AUC}) AS roc_auc"""
    for c in CLASSES[:3]) + ")", "standin"))
def eval_one_vs_rest(spark, sf_dir):
    rows = standin_scores(load_log(spark, sf_dir)).withColumn(
        "p", F.when(F.col("n") % 3 == 0, F.col("confidence")).otherwise(1 - F.col("confidence")))
    return E.one_vs_rest_curves(rows, "label", {c: "p" for c in CLASSES[:3]}).select(
        "class", num("pr_auc"), num("roc_auc"))


@query(sql(f"""SELECT * FROM ({_ks_sql('''(SELECT 'l_extendedprice' AS feature, CAST(l_extendedprice AS DOUBLE) AS v,
  CASE WHEN l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 365 DAY THEN 1 ELSE 0 END AS r FROM lineitem
  WHERE l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 730 DAY)''', 'feature', 'v')
  .replace('ks_stat, CASE', 'round(ks_stat, 6) AS ks_stat, round(CASE', 1).replace('END AS p_value', 'END, 6) AS p_value')})"""))
def drift_lineitem_price(spark, sf_dir):
    """The same test on another table: item prices of the last year and the one before."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_extendedprice").cast("double").alias("value"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"))
    rows = D.split_windows(items, 365).select(F.lit("l_extendedprice").alias("feature"), "value", "side")
    return D.with_pvalue(D.ks_by_feature(rows, "feature"), "asymptotic").select(
        "feature", whole("n_recent"), whole("n_baseline"), num("ks_stat"), num("p_value"))


@query()
def adwin_users(spark, sf_dir):
    """Change of mean session length per user, over hourly means."""
    series = AD.slot_means(load_log(spark, sf_dir), "user_id", "session_duration_s")
    return AD.detect(series, "user_id", ["slot"], "value")


# --- models -------------------------------------------------------------------------

def split_table(log: DataFrame) -> DataFrame:
    return PM.training_table(log, train_baselines(log))


_TEST_N = "CAST(round(count(*) * 0.2) AS BIGINT)"


@query(sql(f"SELECT label, count(*) - {_TEST_N} AS n_train, {_TEST_N} AS n_test FROM access_log GROUP BY label", "access_log"))
def split_counts(spark, sf_dir):
    log = load_log(spark, sf_dir)
    return SA.stratified_split(log.select("event_id", "label")).groupBy("label").agg(
        F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test"))


@query(sql(f"""SELECT label, n_train AS real_rows, max(n_train) OVER () - n_train AS synthetic_rows FROM (
  SELECT label, count(*) - {_TEST_N} AS n_train FROM access_log GROUP BY label)""", "access_log"))
def smote_balanced(spark, sf_dir):
    table = split_table(load_log(spark, sf_dir))
    return SM.oversample(table.filter(~F.col("is_test")), FEATURES).groupBy("label").agg(
        F.count_if(~F.col("synthetic")).alias("real_rows"), F.count_if("synthetic").alias("synthetic_rows"))


@query()
def iforest_scores(spark, sf_dir):
    table = split_table(load_log(spark, sf_dir))
    forest, _ = PM.train_anomaly(table)
    return IF.with_isolation_score(table, forest).select(
        "event_id", "label", num("isolation_score"), num("decision"))


# A fixed forest over these, scored by leaf boxes in the reference SQL.
_BOXED = ["hour_deviation", "session_z", "bytes_z", "travel_speed_kmh", "session_duration_s", "bytes_transferred"]
_BOX_TREES, _BOX_DEPTH = 10, 3


def _box_rows() -> str:
    """(tree, leaf, low and high place in each feature's range) of every leaf of the fixed forest."""
    rows = []
    for t in range(_BOX_TREES):
        for leaf in range(2 ** _BOX_DEPTH):
            node, low, high = 1, [-1.0] * len(_BOXED), [2.0] * len(_BOXED)
            for level in range(_BOX_DEPTH):
                f, share = IF.grid_cut(t, node, len(_BOXED))
                right = leaf >> (_BOX_DEPTH - 1 - level) & 1
                low[f], high[f] = (max(low[f], share), high[f]) if right else (low[f], min(high[f], share))
                node = 2 * node + right
            rows.append(f"({t}, {leaf}, " + ", ".join(f"CAST({v!r} AS DOUBLE)" for pair in zip(low, high) for v in pair) + ")")
    return ", ".join(rows)


def _box_sql() -> str:
    ends = ", ".join(f"min(CAST({c} AS DOUBLE)) AS l{i}, max(CAST({c} AS DOUBLE)) AS h{i}" for i, c in enumerate(_BOXED))
    names = ", ".join(f"a{i}, b{i}" for i in range(len(_BOXED)))
    inside = " AND ".join(f"f.{c} > r.l{i} + b.a{i} * (r.h{i} - r.l{i}) AND f.{c} <= r.l{i} + b.b{i} * (r.h{i} - r.l{i})" for i, c in enumerate(_BOXED))
    c = "CASE WHEN {n} > 2 THEN 2.0 * (ln({n} - 1.0) + 0.5772156649) - 2.0 * ({n} - 1.0) / {n} WHEN {n} = 2 THEN 1.0 ELSE 0.0 END"
    return f"""r AS (SELECT {ends}, CAST(count(*) AS DOUBLE) AS total FROM features), b(tree, leaf, {names}) AS (VALUES {_box_rows()}),
j AS (SELECT f.event_id, b.tree, b.leaf FROM features f CROSS JOIN r JOIN b ON {inside}),
n AS (SELECT tree, leaf, CAST(count(*) AS DOUBLE) AS n FROM j GROUP BY tree, leaf),
p AS (SELECT j.event_id, avg({_BOX_DEPTH} + {c.format(n="n.n")}) AS path FROM j JOIN n ON n.tree = j.tree AND n.leaf = j.leaf GROUP BY j.event_id)
SELECT event_id, round(pow(2.0, -path / ({c.format(n="r.total")})), 6) AS isolation_score FROM p CROSS JOIN r"""


@query(sql("SELECT 1", "features").removesuffix("\nSELECT 1") + ",\n" + _box_sql())
def iforest_boxes(spark, sf_dir):
    rows = feature_rows(load_log(spark, sf_dir))
    forest = IF.fit_grid_forest(rows, _BOXED, _BOX_TREES, _BOX_DEPTH)
    return IF.with_isolation_score(rows, forest).select("event_id", num("isolation_score"))


@query()
def iforest_report(spark, sf_dir):
    _, report = PM.train_anomaly(split_table(load_log(spark, sf_dir)))
    return report


@query()
def classify_events(spark, sf_dir):
    table = split_table(load_log(spark, sf_dir))
    model, _ = PM.train_classes(table, trees=40, depth=8)
    return CL.classify(table, model, SC.MIN_CONFIDENCE).select(
        "event_id", "label", "attack_type", num("confidence"))


@query()
def classifier_report(spark, sf_dir):
    _, report = PM.train_classes(split_table(load_log(spark, sf_dir)), trees=40, depth=8)
    return report


@query()
def boosted_report(spark, sf_dir):
    """Held-out report of softmax boosting, beside ``classifier_report``."""
    _, report = PM.train_classes(split_table(load_log(spark, sf_dir)), "softmax", trees=20, depth=5)
    return report


@query()
def attribution_top4(spark, sf_dir):
    table = split_table(load_log(spark, sf_dir))
    model, _ = PM.train_classes(table, trees=40, depth=8)
    flagged = CL.classify(table, model).filter("attack_type <> 'normal'")
    return AT.with_attributions(flagged, model).select(
        "event_id", "attack_type", F.posexplode("top_features").alias("pos", "t")).select(
        "event_id", "attack_type", (F.col("pos") + 1).alias("rank"), "t.feature", F.round("t.credit", 6).alias("credit"))


@query()
def score_all(spark, sf_dir):
    """The whole offline job: train, score every event, explain the alerts."""
    log = load_log(spark, sf_dir)
    models, _, _ = PM.train(log, forest_trees=100, class_trees=20, depth=8)
    return SC.alert_rows(PM.score(log, models), shifted("timestamp", 60)).withColumn(
        "timestamp", S.iso_text("timestamp")).drop("created_at")


@query(sql("""SELECT CASE f.v WHEN 'confirm' THEN f.attack_type WHEN 'dismiss' THEN 'normal' ELSE l.label END AS label, count(*) AS n
FROM access_log l LEFT JOIN (SELECT a.event_id, a.attack_type, arg_max(b.action, {'u': b.made_us, 'i': b.id}) AS v FROM alerts a
  JOIN feedback b ON b.alert_id = a.id WHERE b.action IN ('confirm', 'dismiss') GROUP BY a.event_id, a.attack_type) f ON f.event_id = l.event_id
GROUP BY 1""", "access_log", "alerts", "feedback"))
def retrain_labels(spark, sf_dir):
    log = load_log(spark, sf_dir)
    alerts = standin_alerts(log)
    return RT.relabelled(log, alerts, standin_feedback(alerts)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT count(*) AS total_feedback_labels, count(*) % 50 AS pending_retrain_batch, count(*) % 50 = 0 AS due FROM feedback",
           "feedback"))
def retrain_due(spark, sf_dir):
    return RT.due(standin_feedback(standin_alerts(load_log(spark, sf_dir)))).select(
        "total_feedback_labels", "pending_retrain_batch", "due")


@query(sql(f"""SELECT {r6('m.roc_auc', 'anomaly_roc_auc')}, s.*, u.drift_users_affected, c.cold_start_users FROM (
  WITH judged AS (SELECT anomaly_score AS s, CASE WHEN label <> 'normal' THEN 1 ELSE 0 END AS y FROM standin) {_AUC}) m
CROSS JOIN (SELECT count(*) AS total_alerts, count(*) FILTER (WHERE status = 'open') AS open_alerts,
  count(*) FILTER (WHERE status = 'confirmed') AS confirmed_alerts, count(*) FILTER (WHERE status = 'dismissed') AS dismissed_alerts FROM status) s
CROSS JOIN (SELECT count(*) FILTER (WHERE p_value < 0.01) AS drift_users_affected FROM ({_USER_KS})) u
CROSS JOIN (SELECT count(*) FILTER (WHERE event_count < 20) AS cold_start_users FROM stats) c""",
           "standin", "status", "stats", "access_log"))
def metrics_dashboard(spark, sf_dir):
    log = load_log(spark, sf_dir)
    drift = D.drift_summary(D.user_drift(log, DAYS, "asymptotic"),
                            D.population_drift(log, days=DAYS, method="asymptotic"), DAYS)
    row = DB.metrics_row(E.binary_report(judged(log), "anomaly_score", "attack"), status_rows(log), drift,
                         B.user_baselines(log))
    return row.select(num("anomaly_roc_auc"), "total_alerts", "open_alerts", "confirmed_alerts",
                      "dismissed_alerts", "drift_users_affected", "cold_start_users")


# --- streaming ------------------------------------------------------------------------

def replay(spark: SparkSession, sf_dir: str, slices: int = 2) -> tuple[DataFrame, str]:
    """The log as files in time order, read as a stream, and a work folder."""
    root = ST.fresh_dir(shared_dir(spark), "replay")
    log = checkpoint(load_log(spark, sf_dir))
    first, last = log.agg(F.min("timestamp"), F.max("timestamp")).first()
    step = (last - first) / slices
    for i in range(slices):
        part = log.filter(F.col("timestamp") >= F.lit(first + step * i))
        if i + 1 < slices:
            part = part.filter(F.col("timestamp") < F.lit(first + step * (i + 1)))
        part.coalesce(8).write.mode("append").parquet(f"{root}/events")
    return HP.read_events(spark, f"{root}/events", 8, ACCESS_LOG), root


@query(sql(f"SELECT id, event_id, risk_score, attack_type, reason FROM alerts", "alerts"))
def stream_alerts_replay(spark, sf_dir):
    """Live path over the replayed log, with the stand-in score; equals the batch alerts."""
    events, root = replay(spark, sf_dir)
    base = train_baselines(load_log(spark, sf_dir))

    def each(batch: DataFrame, batch_id: int) -> None:
        scored = standin_risk(FT.features_from_context(batch, base, COLD_BELOW))
        ST.append_alerts(SC.alert_rows(scored, shifted("timestamp", 60)).withColumn(
            "id", F.concat(F.lit("al_"), "event_id")), f"{root}/alerts", f"live-{batch_id:012d}", pruned=True)

    rows = LS.with_live_context(HP.prepared(events, "40 days"), expire=False)
    (rows.writeStream.foreachBatch(each).option("checkpointLocation", f"{root}/state")
     .trigger(availableNow=True).start().awaitTermination())
    return ST.read_alerts(spark, f"{root}/alerts").select("id", "event_id", "risk_score", "attack_type", "reason")


def _finished(stream: DataFrame, root: str, mode: str) -> DataFrame:
    """Run a streaming aggregate to its end; the last state of each batch is kept."""
    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/{batch_id:06d}")

    done = (stream.writeStream.outputMode(mode).foreachBatch(each)
            .option("checkpointLocation", f"{root}/agg").trigger(availableNow=True).start())
    done.awaitTermination()
    last = max(p["batchId"] for p in done.recentProgress)
    return stream.sparkSession.read.parquet(f"{root}/out/{last:06d}")


@query(sql("SELECT label AS attack_type, 'open' AS status, count(*) AS n FROM access_log WHERE label <> 'normal' GROUP BY label", "access_log"))
def stream_kpis(spark, sf_dir):
    events, root = replay(spark, sf_dir)
    alerts = events.filter("label <> 'normal'").select(
        F.col("label").alias("attack_type"), F.lit("open").alias("status"))
    return _finished(HP.live_kpis(alerts), root, "complete")


@query(sql("""SELECT strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H') AS hour, count(*) AS events,
  count(*) FILTER (WHERE NOT success) AS failures, round(count(*) FILTER (WHERE NOT success) / CAST(count(*) AS DOUBLE), 6) AS failure_rate
FROM access_log GROUP BY 1""", "access_log"))
def stream_failure_rates(spark, sf_dir):
    events, root = replay(spark, sf_dir)
    return _finished(HP.failure_rates(events), root, "complete").select(
        F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "events", "failures", num("failure_rate"))


def _change_files(spark: SparkSession, sf_dir: str, slices: int = 3) -> tuple[DataFrame, str]:
    """Alerts and feedback as changes in an order that no clock gave, read as a stream."""
    root = ST.fresh_dir(shared_dir(spark), "changes")
    alerts = standin_alerts(load_log(spark, sf_dir))
    changes = checkpoint(STA.alert_changes(alerts).unionByName(STA.feedback_changes(standin_feedback(alerts))))
    slot = F.pmod(F.xxhash64("alert_id", "feedback_id"), F.lit(slices))
    for i in range(slices):
        changes.filter(slot == i).coalesce(1).write.mode("append").parquet(f"{root}/changes")
    return HP.read_events(spark, f"{root}/changes", 1, STA.CHANGES), root


@query(sql("SELECT attack_type, status, count(*) AS n FROM status GROUP BY ALL", "status"))
def stream_status_counts(spark, sf_dir):
    """Alert counts by class and status, with verdicts that come before or after their alerts."""
    changes, root = _change_files(spark, sf_dir)
    STA.start_counts(changes, f"{root}/counts", f"{root}/state", available_now=True).awaitTermination()
    return STA.live_counts(spark, f"{root}/counts")


# Every 50th event of the first half of the month comes after all others.
_STRAY = "CAST(substr(event_id, 5) AS BIGINT) % 50 = 7 AND timestamp < (SELECT date_trunc('day', min(timestamp)) + INTERVAL 15 DAY FROM access_log)"


@query(sql(f"""SELECT CASE WHEN {_STRAY} THEN 'late' ELSE 'on_time' END AS part,
  strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H') AS hour, count(*) AS n FROM access_log GROUP BY ALL""", "access_log"))
def stream_late_events(spark, sf_dir):
    root, log = ST.fresh_dir(shared_dir(spark), "late"), checkpoint(load_log(spark, sf_dir))
    middle = log.agg(F.date_trunc("day", F.min("timestamp")) + F.expr("INTERVAL 15 DAYS")).first()[0]
    stray = (F.substr("event_id", F.lit(5)).cast("long") % 50 == 7) & (F.col("timestamp") < F.lit(middle))
    early = F.col("timestamp") < F.lit(middle)
    for part in (~stray & early, ~early, stray):
        # Each part is one micro-batch of many files: the stream goes on where it stopped.
        log.filter(part).write.mode("append").parquet(f"{root}/events")
        events = HP.read_events(spark, f"{root}/events", HP.ALL_FILES, ACCESS_LOG)
        LA.start_split(events, f"{root}/out", f"{root}/state", 10, available_now=True).awaitTermination()
    parts = [LA.counts_by_hour(LA.read_part(spark, f"{root}/out", name, ACCESS_LOG)).select(
        F.lit(name).alias("part"), F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "n") for name in ("on_time", "late")]
    return parts[0].unionByName(parts[1])


@query(sql(f"""SELECT action AS name, p.col0 AS percentile, count(*) AS n, TRUE AS within_error FROM access_log,
  (VALUES ('p50'), ('p95'), ('p99')) p WHERE session_duration_s IS NOT NULL GROUP BY ALL""", "access_log"))
def stream_duration_percentiles(spark, sf_dir):
    """Percentiles of session times from merged sketches, held against exact ranks over the whole log."""
    events, root = replay(spark, sf_dir)
    LT.start_latency(events, f"{root}/latency", f"{root}/state", F.col("action"), F.col("session_duration_s"), available_now=True).awaitTermination()
    found = LT.percentiles(spark, f"{root}/latency")
    long = found.select("name", "n", F.inline(F.array(*[
        F.struct(F.lit(c).alias("percentile"), F.lit(p).alias("prob"), F.col(c).alias("value")) for c, p in LT.PROBABILITIES.items()])))
    log = load_log(spark, sf_dir).filter("session_duration_s IS NOT NULL").select(F.col("action").alias("name"), "session_duration_s")
    # One row per action and percentile.
    ranks = log.join(F.broadcast(long), "name").groupBy("name", "percentile", "n", "prob").agg(
        F.count_if(F.col("session_duration_s") < F.col("value")).alias("below"),
        F.count_if(F.col("session_duration_s") <= F.col("value")).alias("to"))
    error = F.lit(LT.rank_error()) * F.col("n") + 1
    return ranks.select("name", "percentile", "n", (
        (F.col("below") - error <= F.col("prob") * F.col("n")) & (F.col("prob") * F.col("n") <= F.col("to") + error)).alias("within_error"))
