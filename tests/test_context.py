"""Look-back features: edge rows, ties, and split timelines."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wardline.operators.context import CONTEXT_COLUMNS, context_features, timelines, uncapped_failures
from wardline.operators.hotkeys import SkewPolicy, split_timelines

TINY = SkewPolicy(hot_rows=20, segment_rows=7, slot_s=1)


def context_of(log, policy=SkewPolicy()):
    return {r["event_id"]: r for r in context_features(log, policy).select("event_id", *CONTEXT_COLUMNS).collect()}


def brute_force(rows):
    """Direct reading of the definitions, one user at a time."""
    out = {}
    for user in {r["user_id"] for r in rows}:
        mine = sorted((r for r in rows if r["user_id"] == user), key=lambda r: (r["timestamp"], r["event_id"]))
        for i, r in enumerate(mine):
            prior = [p for p in mine if p["timestamp"] < r["timestamp"]][-30:]
            fails = [p for p in prior if not p["success"] and p["source_ip"] == r["source_ip"]
                     and (r["timestamp"] - p["timestamp"]).total_seconds() <= 120]
            speed = 0.0
            if i:
                q = mine[i - 1]
                p1, p2 = math.radians(q["geo_lat"]), math.radians(r["geo_lat"])
                a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(
                    math.radians(r["geo_lon"] - q["geo_lon"]) / 2) ** 2
                hours = max((r["timestamp"] - q["timestamp"]).total_seconds() / 3600, 1e-6)
                speed = 2 * 6371.0 * math.asin(math.sqrt(a)) / hours
            out[r["event_id"]] = (
                len({p["resource_accessed"] for p in prior}) + 1, len(fails), round(min(speed, 20000.0), 6),
                int(speed > 800), int(i > 0 and mine[i - 1]["geo_city"] != r["geo_city"]))
    return out


def as_tuple(r):
    return (r["session_resource_count"], r["rapid_failure_count"], round(r["travel_speed_kmh"], 6),
            r["is_impossible_travel"], r["city_changed"])


@pytest.fixture(scope="module")
def busy_log(make_log):
    rng = random.Random(7)
    cities = [("London", 51.51, -0.13), ("Paris", 48.85, 2.35), ("Oslo", 59.91, 10.75)]
    rows = []
    for n in range(400):
        user = "busy" if n % 3 else f"u{n % 10}"
        city, lat, lon = rng.choice(cities)
        # Few distinct instants, so that ties and empty slots both occur.
        rows.append((f"e{n:04d}", rng.randrange(150) * rng.choice([1, 1, 40]), {
            "user_id": user, "resource_accessed": f"r{rng.randrange(12)}", "success": rng.random() < 0.5,
            "source_ip": f"10.0.0.{rng.randrange(2)}", "geo_city": city, "geo_lat": lat, "geo_lon": lon}))
    return make_log(rows)


def test_against_brute_force(busy_log):
    expected = brute_force([r.asDict() for r in busy_log.collect()])
    assert {k: as_tuple(v) for k, v in context_of(busy_log).items()} == expected


@pytest.mark.parametrize("segment_rows,slot_s", [(7, 1), (1, 1), (50, 60), (3, 7)])
def test_split_timelines_change_nothing(busy_log, segment_rows, slot_s):
    policy = SkewPolicy(hot_rows=20, segment_rows=segment_rows, slot_s=slot_s)
    parts = split_timelines(busy_log, policy)
    assert len(parts) == 2 and parts[1].rows.select("_seg").distinct().count() > 1
    whole, split = context_of(busy_log), context_of(busy_log, policy)
    assert {k: as_tuple(v) for k, v in split.items()} == {k: as_tuple(v) for k, v in whole.items()}


def test_segments_are_bounded(spark, make_log):
    log = make_log([(f"e{n:05d}", n, {}) for n in range(2000)])
    parts = split_timelines(log, SkewPolicy(hot_rows=500, segment_rows=100, slot_s=10))
    sizes = parts[1].rows.groupBy("_seg").count().agg(F.max("count")).first()[0]
    assert sizes <= 100 + 10 + 30        # target, one slot over, halo


def test_ties_do_not_see_one_another(make_log):
    log = make_log([("a", 0, {"resource_accessed": "x"}), ("b", 0, {"resource_accessed": "y"}),
                    ("c", 0, {"resource_accessed": "z"}), ("d", 5, {}), ("e", 6, {})])
    got = context_of(log)
    assert [got[k]["session_resource_count"] for k in "abcde"] == [1, 1, 1, 4, 5]


def test_only_last_thirty_count(make_log):
    rows = [(f"p{n:02d}", n, {"resource_accessed": f"r{n}", "success": False}) for n in range(35)]
    got = context_of(make_log([*rows, ("z", 60, {"resource_accessed": "q"})]))
    assert got["z"]["session_resource_count"] == 31
    assert got["z"]["rapid_failure_count"] == 30
    free = uncapped_failures(make_log([*rows, ("z", 60, {})])).filter("event_id = 'z'").first()
    assert free["failures_in_window"] == 35


def test_failure_window_edges(make_log):
    late = 1000.0
    log = make_log([("on", late - 120, {"success": False}), ("off", late - 120.000001, {"success": False}),
                    ("ip", late - 10, {"success": False, "source_ip": "10.0.0.9"}),
                    ("ok", late - 5, {}), ("z", late, {})])
    assert context_of(log)["z"]["rapid_failure_count"] == 1


def test_first_event_and_zero_elapsed(make_log):
    far = {"geo_city": "Tokyo", "geo_lat": 35.68, "geo_lon": 139.69}
    got = context_of(make_log([("a", 0, {}), ("b", 0, far)]))
    assert as_tuple(got["a"]) == (1, 0, 0.0, 0, 0)
    assert as_tuple(got["b"]) == (1, 0, 20000.0, 1, 1)


def test_travel_pairs_are_impossible(log):
    pairs = context_features(log).filter("label = 'impossible_travel'")
    # The second leg is the one on an outside address.
    legs = pairs.filter(F.col("source_ip").startswith("203.")).agg(
        F.count(F.lit(1)).alias("n"), F.min("travel_speed_kmh").alias("v")).first()
    assert legs["n"] >= 2 and legs["v"] > 800


def test_timeline_is_split_safe(busy_log):
    alerts = busy_log.filter("success = false").select("event_id", F.concat(F.lit("al_"), "event_id").alias("id"))
    plain = {tuple(r) for r in timelines(busy_log, alerts, 5).collect()}
    split = {tuple(r) for r in timelines(busy_log, alerts, 5, policy=TINY).collect()}
    assert plain and plain == split
