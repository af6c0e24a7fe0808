"""Baselines, deviations, rules, risk and reasons."""

import pytest
from pyspark.sql import functions as F

from wardline.functions import scalars as S
from wardline.operators import baselines as B
from wardline.operators import features as FT
from wardline.operators import rules as R
from wardline.operators import scoring as SC
from wardline.operators.hotkeys import SkewPolicy
from wardline.sources.schema import ACCESS_LOG, FEATURES


def one(spark, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])


def test_log_invariants(log):
    assert set(ACCESS_LOG.names) <= set(log.columns)
    assert {r[0] for r in log.select("label").distinct().collect()} == {
        "normal", "brute_force", "lateral_movement", "impossible_travel", "credential_misuse", "device_spoofing"}
    nulls = log.select(*[F.count_if(F.col(c).isNull()).alias(c) for c in log.columns]).first()
    assert not any(nulls)
    own = log.filter("label = 'normal'").groupBy("user_id").agg(
        F.countDistinct("device_id").alias("d"), F.countDistinct("resource_accessed").alias("r")).agg(
        F.max("d"), F.max("r")).first()
    assert own[0] <= 2 and own[1] <= 4


def test_haversine(spark):
    km = one(spark, a=40.71, b=-74.01, c=51.51, d=-0.13).select(S.haversine_km("a", "b", "c", "d")).first()[0]
    assert 5400 < km < 5800


def test_hour_wrap(spark):
    got = one(spark, h=23.0, m=1.0, s=0.2).select(S.hour_deviation("h", "m", "s")).first()[0]
    assert got == pytest.approx(4.0)


def test_prefix_rule(spark):
    assert one(spark, ip="172.217.0.1").select(S.is_public_ip("ip")).first()[0] == 0
    assert one(spark, ip="8.8.8.8").select(S.is_public_ip("ip")).first()[0] == 1


def test_baseline_edges(make_log):
    row = B.user_baselines(make_log([("a", 0, {})])).first()
    assert (row["std_hour"], row["std_session_s"], row["std_bytes"]) == (1.0, 1.0, 1.0)
    tie = B.user_baselines(make_log([("a", 0, {"geo_city": "Rome"}), ("b", 1, {"geo_city": "Bonn"})])).first()
    assert tie["home_city"] == "Bonn"


def test_unknown_user_takes_medians(make_log):
    known = [(f"k{n}", n * 60, {"user_id": f"u{n % 3}", "bytes_transferred": 100 * (n % 3 + 1)}) for n in range(30)]
    base = B.fit_baselines(make_log(known))
    row = FT.build_features(make_log([("z", 0, {"user_id": "stranger", "bytes_transferred": 207})]), base).first()
    assert (row["cold_start"], row["is_novel_device"], row["baseline_type"]) == (1, 1, "population")
    assert row["bytes_z"] == pytest.approx(5.0)      # (207 - 200) / max(0, 1), clipped
    assert row["n_known_devices"] == 1


def test_long_device_sets_stay_exact(make_log):
    """Beyond the set limit membership comes from the pairs."""
    rows = [(f"e{n}", n, {"user_id": "u" if n % 2 else "v", "device_id": f"d{n % 9}"}) for n in range(40)]
    log = make_log([*rows, ("x", 100, {"device_id": "new", "label": "brute_force"})])
    short = FT.build_features(log, B.fit_baselines(log, max_set=3))
    full = FT.build_features(log, B.fit_baselines(log))
    key = ("event_id", "is_novel_device")
    assert sorted(short.select(*key).collect()) == sorted(full.select(*key).collect())
    stats = B.user_baselines(log, max_set=3)
    assert stats.filter("known_devices IS NOT NULL").count() == 0


def test_hot_users_give_the_same_features(log):
    base = B.fit_baselines(log)
    tiny = SkewPolicy(hot_rows=60, segment_rows=20, slot_s=3600)
    cols = ["event_id", "baseline_type", *[F.round(F.col(c).cast("double"), 9).alias(c) for c in FEATURES]]
    plain = FT.build_features(log, base).select(*cols)
    split = FT.build_features(log, base, policy=tiny).select(*cols)
    assert plain.exceptAll(split).isEmpty() and split.exceptAll(plain).isEmpty()


def test_options(log):
    base = B.fit_baselines(log)
    legacy = FT.build_features(log, base, legacy_novel_device=True)
    assert legacy.filter("is_novel_device = 0").isEmpty()
    alone = FT.build_features(log, base, stateful=False)
    assert alone.filter("session_resource_count <> 1 OR rapid_failure_count <> 0 OR travel_speed_kmh <> 0").isEmpty()
    assert FT.feature_columns(log.select("event_id", "success", "bytes_transferred")) == ["bytes_transferred", "success"]
    merged = FT.attach_features(log, FT.feature_matrix(alone))
    assert merged.count() == log.count() and merged.columns.count("success") == 1


def test_baselines_round_trip(spark, log, tmp_path):
    base = B.fit_baselines(log)
    B.save_baselines(base, str(tmp_path))
    back = B.load_baselines(spark, str(tmp_path))
    assert sorted(back.stats.collect()) == sorted(base.stats.collect())


def test_guardrail_demo(spark):
    event = one(spark, event_id="e", user_id="u", timestamp=0, travel_speed_kmh=12000.0,
                rapid_failure_count=15, action="escalate", is_public_ip=1)
    got = [(r["rule"], r["severity"], r["detail"]) for r in R.rule_alerts(event).collect()]
    assert got == [
        ("impossible_travel", "high", "Travel speed 12,000 km/h exceeds physical maximum"),
        ("brute_force", "high", "15 failed logins in 2-minute window"),
        ("suspicious_escalation", "medium", "Privilege escalation from a public IP address")]


@pytest.mark.parametrize("a,kind,c,risk", [
    (1.0, "normal", 0.0, 30), (0.0, "unknown_anomaly", 0.39, 40), (0.0, "brute_force", 0.4, 50),
    (1.0, "brute_force", 1.0, 100)])
def test_risk(spark, a, kind, c, risk):
    assert one(spark, a=a, k=kind, c=c).select(SC.risk_score("a", "k", "c")).first()[0] == risk


def test_constant_scores_normalise_to_zero(spark):
    df = spark.range(5).select(F.lit(0.3).alias("d"))
    assert {r[0] for r in SC.minmax_normalised(df, "d", "s").select("s").collect()} == {0.0}
    assert one(spark, d=0.9).select(SC.shift_normalised("d")).first()[0] == 1.0


def test_sql_functions(spark):
    from wardline.functions.registry import register

    register(spark)
    row = spark.sql("SELECT haversine_km(40.71, -74.01, 51.51, -0.13) AS km, risk_band(95) AS band, "
                    "risk_score(1.0D, 'normal', 0.0D) AS risk").first()
    assert 5400 < row["km"] < 5800 and row["band"] == "CRITICAL" and row["risk"] == 30
