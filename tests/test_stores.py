"""Alert table, feedback log, documents, live path."""

import json
import re

import pytest
from pyspark.sql import functions as F

from wardline.operators import alerts as A
from wardline.operators import scoring as SC
from wardline.plans.jobs import DRIFT_STATUS, NO_DRIFT_STATUS
from wardline.operators import drift as D
from wardline.queries import standin_alerts, standin_risk, train_baselines
from wardline.session import checkpoint
from wardline.sources import day_filters as DAYF
from wardline.sources import stores
from wardline.sources.access_log import read_log, with_live_defaults, write_log
from wardline.sources.schema import ALERT_COLUMNS, LIVE_EVENT
from wardline.streaming import hot_path as HP
from wardline.streaming import state as LS


@pytest.fixture(scope="module")
def alerts(log):
    return checkpoint(standin_alerts(log).drop("n"))


def test_alert_columns(alerts):
    assert alerts.columns == ALERT_COLUMNS and len(ALERT_COLUMNS) == 26


def test_insert_ignores_known_alerts(spark, alerts, tmp_path):
    path = str(tmp_path / "a")
    n = alerts.count()
    assert stores.append_alerts(alerts, path) == n
    assert stores.append_alerts(alerts, path) == 0
    copies = alerts.withColumn("id", F.concat("id", F.lit("x")))
    assert stores.append_alerts(copies, path) == 0
    incomplete = copies.withColumns({"event_id": F.col("id"), "reason": F.lit(None).cast("string")})
    assert stores.append_alerts(incomplete, path) == 0
    assert stores.read_alerts(spark, path).count() == n


def test_repeating_a_batch_changes_nothing(spark, alerts, tmp_path):
    path = str(tmp_path / "a")
    n = alerts.count()
    for _ in range(2):
        assert stores.append_alerts(alerts, path, "b1", pruned=True) == n
    assert stores.append_alerts(alerts, path, "b2", pruned=True) == 0
    assert stores.read_alerts(spark, path).count() == n


def days_later(alerts, days, suffix="x"):
    return alerts.withColumns({"timestamp": F.timestamp_micros(F.unix_micros("timestamp") + days * 86_400_000_000),
                               "id": F.concat("id", F.lit(suffix))})


def test_first_wins_over_all_days(spark, alerts, tmp_path):
    path = str(tmp_path / "a")
    n = alerts.count()
    assert stores.append_alerts(alerts, path, "b0", pruned=True) == n
    days = [r[0] for r in alerts.select(F.to_date("timestamp")).distinct().orderBy("to_date(timestamp)").collect()]
    one_day = alerts.filter(F.to_date("timestamp") == F.lit(days[3]))
    again = days_later(one_day, 10)
    # Only the day that holds the first copies is read.
    rows = stores.coerced(again)
    found = stores.candidates(rows, path, "b1")
    assert [r[0] for r in found.select("day").distinct().collect()] == [days[3]]
    files = found.select(F.input_file_name()).distinct().collect()
    assert files and all(f"day={days[3]}" in r[0] for r in files)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*day", plan)
    assert stores.append_alerts(again, path, "b1", pruned=True) == 0
    # Equal alert ids of other events are kept out as well; what is new comes in.
    same_id = days_later(one_day, 40, "").withColumn("event_id", F.concat("event_id", F.lit("y")))
    assert stores.append_alerts(same_id, path, "b2", pruned=True) == 0
    new = days_later(one_day, 40).withColumn("event_id", F.concat("event_id", F.lit("y")))
    assert stores.candidates(stores.coerced(new), path, "b3").isEmpty()
    m = one_day.count()
    for _ in range(2):  # a repeated batch changes nothing
        assert stores.append_alerts(new, path, "b3", pruned=True) == m
    out = stores.read_alerts(spark, path)
    assert out.count() == n + m == out.select("event_id").distinct().count()


def test_filters_of_an_older_table(spark, alerts, tmp_path):
    path = str(tmp_path / "old")
    some = stores.coerced(alerts.limit(40)).withColumns({"day": F.to_date("timestamp"), "batch": F.lit("b0")})
    some.write.partitionBy("day", "batch").parquet(path)
    stored = stores.read_alerts(spark, path)
    stores.rebuild_filters(spark, path)
    assert stores.append_alerts(days_later(stored, 5), path, "b1", pruned=True) == 0
    assert stores.append_alerts(stored.limit(0), path, "b2", pruned=True) == 0


def test_filters_never_leave_out_a_key(spark):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("event_id"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("al_"), "id")).alias("id"))
    marks = DAYF.key_blocks(rows)
    assert marks.count() == 20_000 + rows.filter("id IS NOT NULL").count()
    assert marks.filter("block < 0 OR block >= %d OR low = 0 OR high = 0" % DAYF.BLOCKS).isEmpty()
    days = rows.withColumn("day", F.date_add(F.lit("2024-03-01").cast("date"), F.col("event_id").cast("int") % 3))
    filters = DAYF.key_blocks(days, "day").groupBy("day", "block").agg(F.bit_or("low").alias("low"), F.bit_or("high").alias("high"))
    for k in range(3):
        part = days.filter(F.col("event_id").cast("int") % 3 == k)
        assert [d.day for d in DAYF.days_that_may_hold(part, filters)] == [k + 1]
    other = rows.select(F.concat("event_id", F.lit("z")).alias("event_id"), F.lit(None).cast("string").alias("id"))
    assert DAYF.days_that_may_hold(other, filters) == []


def test_feedback(spark, alerts, tmp_path):
    path, aid = str(tmp_path / "f"), alerts.first()["id"]
    assert stores.append_feedback(spark, path, alerts, aid, "note", "look") == "open"
    assert stores.append_feedback(spark, path, alerts, aid, "confirm") == "confirmed"
    assert stores.append_feedback(spark, path, alerts, aid, "note", "") == "confirmed"
    with pytest.raises(KeyError):
        stores.append_feedback(spark, path, alerts, "nobody", "note")
    with pytest.raises(ValueError):
        stores.append_feedback(spark, path, alerts, aid, "reopen")
    row = A.detail(alerts, stores.read_feedback(spark, path), aid).first()
    assert (row["status"], row["latest_note"], len(row["notes"])) == ("confirmed", "look", 3)
    assert [n["action"] for n in row["notes"]] == ["note", "confirm", "note"]


def test_queue_arguments(alerts):
    for bad in ({"page": 0}, {"limit": 0}, {"limit": 101}, {"min_risk": 101}):
        with pytest.raises(ValueError):
            A.queue(alerts, **bad)
    first, second = (A.queue(alerts, page=p, limit=10).collect() for p in (1, 2))
    assert [r["risk_score"] for r in first + second] == sorted((r["risk_score"] for r in first + second), reverse=True)
    assert not {r["id"] for r in first} & {r["id"] for r in second}
    empty = A.queue_size(alerts.filter("false")).first()
    assert (empty["total"], empty["pages"]) == (0, 1)


def test_drift_document(spark, log, tmp_path):
    path = str(tmp_path / "d")
    assert stores.read_document(spark, path, DRIFT_STATUS, NO_DRIFT_STATUS).first()["method"] == "not_run"
    stores.write_document(D.drift_status(log, 15), path)
    row = stores.read_document(spark, path, DRIFT_STATUS, NO_DRIFT_STATUS).first()
    assert row["users_checked"] == 15 and len(row["population_drift"]) == 2
    assert set(json.loads(spark.read.text(path).first()[0])) >= {"drifted_users", "checked_at"}


def test_log_round_trip(spark, log, tmp_path):
    write_log(log, str(tmp_path / "p"), str(tmp_path / "c"))
    assert read_log(spark, str(tmp_path / "p")).exceptAll(log).isEmpty()
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == log.count()


def test_live_defaults(spark):
    row = spark.createDataFrame([(None,) * len(LIVE_EVENT)], LIVE_EVENT)
    got = with_live_defaults(row).first()
    assert got["event_id"] and got["role"] == "standard"


def test_stateless_live_path_drops_copies(spark, log, tmp_path):
    base = train_baselines(log)
    # The same events twice, in two files: each alert is stored once.
    for _ in range(2):
        log.drop("label").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = HP.prepared(HP.read_events(spark, str(tmp_path / "in"), 1), "40 days")

    def each(batch, batch_id):
        from wardline.operators.features import build_features

        scored = standin_risk(build_features(batch, base, stateful=False).withColumn("label", F.lit("brute_force")))
        stores.append_alerts(SC.alert_rows(scored), str(tmp_path / "out"), f"live-{batch_id}", pruned=True)

    (events.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "state"))
     .trigger(availableNow=True).start().awaitTermination())
    out = stores.read_alerts(spark, str(tmp_path / "out"))
    assert out.count() == log.count() == out.select("event_id").distinct().count()


def test_live_drift_and_sessions(spark, log, tmp_path):
    shifted = spark.range(600).select(
        F.lit("k").alias("user_id"), F.format_string("e%05d", "id").alias("event_id"),
        F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("timestamp"),
        (F.col("id") % 2 + F.when(F.col("id") >= 300, 5).otherwise(0)).cast("double").alias("v"),
        (F.col("id") % 3 == 0).alias("success"))
    for part in ("id < 250", "id >= 250"):
        shifted.withColumn("id", F.substr("event_id", F.lit(2)).cast("int")).filter(part).drop("id").coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(shifted.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    outputs = {}
    for name, df, mode in (("drift", LS.drift_events(stream, "user_id", "v"), "append"),
                           ("sessions", HP.user_sessions(stream), "complete")):
        rows = outputs.setdefault(name, [])

        def keep(batch, batch_id, rows=rows, mode=mode):
            if mode == "complete":
                rows.clear()
            rows.extend(batch.collect())

        (df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", str(tmp_path / name))
         .trigger(availableNow=True).start().awaitTermination())
    assert [r["key"] for r in outputs["drift"]] == ["k"] and 300 <= outputs["drift"][0]["drift_at_index"] <= 360
    assert [(r["events"], r["failures"]) for r in outputs["sessions"]] == [(600, 400)]
