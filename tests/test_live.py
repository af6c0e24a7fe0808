"""Counts that follow feedback, and late events, over replayed streams."""

from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from wardline.operators import alerts as A
from wardline.sources.schema import ACCESS_LOG, FEEDBACK
from wardline.streaming import hot_path as HP
from wardline.streaming import late as LA
from wardline.streaming import state as LS
from wardline.streaming import status as STA

NOON = datetime(2024, 3, 1, 12, tzinfo=timezone.utc)


def streamed(spark, files, schema, path):
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return HP.read_events(spark, path, 1, schema)


def test_verdicts_in_any_order(spark, tmp_path):
    alerts = spark.createDataFrame([("a", "brute_force"), ("b", "brute_force"), ("c", "lateral_movement"), ("d", "brute_force")], "id string, attack_type string")
    feedback = spark.createDataFrame([
        (1, "a", "confirm", None, NOON), (2, "a", "dismiss", None, NOON + timedelta(1)), (3, "a", "note", "x", NOON + timedelta(2)),
        (4, "b", "dismiss", None, NOON), (5, "b", "confirm", None, NOON), (6, "gone", "confirm", None, NOON), (7, "c", "note", "x", NOON)], FEEDBACK)
    rows = [tuple(r) for r in STA.alert_changes(alerts).unionByName(STA.feedback_changes(feedback)).collect()]
    expected = A.kpis(A.with_status(alerts.withColumn("status", F.lit("open")), feedback)).first()
    for i, order in enumerate([rows, rows[::-1], rows[4:] + rows[:4] + rows[:1]]):
        root = str(tmp_path / str(i))
        files = [order[:3], order[3:4], order[4:]]
        changes = streamed(spark, files, STA.CHANGES, f"{root}/in")
        STA.start_counts(changes, f"{root}/counts", f"{root}/state", available_now=True).awaitTermination()
        assert STA.live_kpis(spark, f"{root}/counts").first() == expected
        counts = {(r["attack_type"], r["status"]): r["n"] for r in STA.live_counts(spark, f"{root}/counts").collect()}
        assert counts == {("brute_force", "dismissed"): 1, ("brute_force", "confirmed"): 1, ("brute_force", "open"): 1, ("lateral_movement", "open"): 1}
    assert STA.live_kpis(spark, str(tmp_path / "none")).first() == (0, 0, 0, 0)


def test_counts_go_on_after_a_stop(spark, tmp_path):
    root = str(tmp_path)
    for rows in ([("a", "x", None, None, None)], [("a", None, "confirm", 1, 5)], [("a", None, "dismiss", 2, 4), ("b", "x", None, None, None)]):
        changes = streamed(spark, [rows], STA.CHANGES, f"{root}/in")
        STA.start_counts(changes, f"{root}/counts", f"{root}/state", available_now=True).awaitTermination()
    counts = {(r["status"]): r["n"] for r in STA.live_counts(spark, f"{root}/counts").collect()}
    assert counts == {"confirmed": 1, "open": 1}  # the later verdict in time stands


def test_late_rows_are_counted(spark, make_log, tmp_path):
    root = str(tmp_path)
    minutes = [[0, 1, 30], [31, 19, 20.9, 21, 45], [34, 36, 2], [90]]
    rows = [make_log([(f"e{i}-{j}", int(m * 60), {}) for j, m in enumerate(ms)]).collect() for i, ms in enumerate(minutes)]
    rows[3].append(tuple(None if f == "timestamp" else v for f, v in zip(ACCESS_LOG.names, rows[3][0])))
    events = streamed(spark, rows, ACCESS_LOG, f"{root}/in")
    LA.start_split(events, f"{root}/out", f"{root}/state", 10, available_now=True).awaitTermination()
    late = sorted((r["event_id"], r["batch"]) for r in LA.read_part(spark, f"{root}/out", "late", ACCESS_LOG).collect())
    # Behind 30 - 10, then 45 - 10, and one without a time.
    assert late == [("e1-1", 1), ("e2-0", 2), ("e2-2", 2), ("e3-0", 3)]
    on_time = LA.read_part(spark, f"{root}/out", "on_time", ACCESS_LOG)
    assert on_time.count() + len(late) == sum(map(len, rows))
    by_hour = {r["hour"]: r["n"] for r in LA.counts_by_hour(LA.read_part(spark, f"{root}/out", "late", ACCESS_LOG)).collect()}
    assert sorted(by_hour.values()) == [1, 3] and by_hour[None] == 1


def test_late_events_are_not_written_by_one_task(spark, sf_dir, tmp_path, monkeypatch):
    from wardline import queries as Q

    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(str(tmp_path / "sf" / "events.parquet"))
    monkeypatch.setattr(Q, "shared_dir", lambda _: str(tmp_path / "shared"))
    n = {r["part"]: r["n"] for r in Q.QUERIES["stream_late_events"](spark, str(tmp_path / "sf")).groupBy("part").agg({"n": "sum"}).toDF("part", "n").collect()}
    assert set(n) == {"late", "on_time"} and sum(n.values()) == Q.load_log(spark, sf_dir).count()
    files = list((tmp_path / "shared").glob("late-*/events/*.parquet"))
    assert len(files) > 3


def test_one_call_serves_many_alerts(spark, tmp_path, monkeypatch):
    root, n = str(tmp_path), 300
    confirm = [(f"a{i}", None, "confirm", 2**53 + 1, 5) for i in range(n)]
    files = [[(f"a{i}", "x", None, None, None) for i in range(n)] + [("a0", "y", None, None, None)],
             confirm, [(f"a{i}", None, "dismiss", 2**53 + i % 2 * 2, 5) for i in range(n)]]
    changes = streamed(spark, files, STA.CHANGES, f"{root}/in")
    rows = []
    query = STA.status_changes(changes, groups=2).writeStream.foreachBatch(
        lambda b, i: rows.append(Counter((r["attack_type"], r["status"], r["n"]) for r in b.collect()))).option(
        "checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows == [{("x", "open", 1): n}, {("x", "open", -1): n, ("x", "confirmed", 1): n},
                    {("x", "confirmed", -1): n // 2, ("x", "dismissed", 1): n // 2}]  # of one instant, the larger id stands


def test_users_share_calls_but_no_state(spark, make_log, tmp_path):
    root = str(tmp_path)
    users = [None, "", "u", "v"]
    files = [make_log([(f"e{half}-{u}-{i}", 7 * i + 300 * half, {"user_id": user, "resource_accessed": f"r{i % (u + 2)}", "success": i % 3 > 0, "geo_city": f"c{i % (u + 1)}"})
                       for u, user in enumerate(users) for i in range(20)]).collect() for half in range(2)]
    found = {}
    for groups in (1, 1 << 12):
        events = streamed(spark, files, ACCESS_LOG, f"{root}/{groups}/in")
        out = []
        (LS.with_live_context(events, expire=False, groups=groups).writeStream.foreachBatch(lambda b, i: out.extend(b.collect()))
         .option("checkpointLocation", f"{root}/{groups}/state").trigger(availableNow=True).start().awaitTermination())
        found[groups] = sorted(out, key=lambda r: r["event_id"])
    assert found[1] == found[1 << 12] and len(found[1]) == 160
    for u in range(len(users)):
        mine = [r for r in found[1] if r["event_id"].split("-")[1] == str(u)]
        assert [r["session_resource_count"] for r in sorted(mine, key=lambda r: r["timestamp"])][-1] == u + 3
        assert sum(r["city_changed"] for r in mine) == (0 if u == 0 else sum(
            a % (u + 1) != b % (u + 1) for a, b in zip([*range(20)] * 2, [*range(1, 20), *range(20)])))
