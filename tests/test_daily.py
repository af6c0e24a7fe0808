"""Day-by-day baselines and drift against the full recomputation."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from wardline.operators import baselines as B
from wardline.operators import daily as DA
from wardline.operators import drift as D

DAY = 86400


def rounded(df):
    doubles = [c for c, t in df.dtypes if t == "double"]
    return sorted((tuple(r) for r in df.withColumns({c: F.round(c, 6) for c in doubles}).select(sorted(df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def days(log):
    return [r[0] for r in log.select(F.to_date("timestamp")).distinct().orderBy(F.col("to_date(timestamp)")).collect()]


def of(log, *days):
    return log.filter(F.to_date("timestamp").isin([d.isoformat() for d in days]))


def test_refreshes_equal_the_whole_log(spark, log, days, tmp_path):
    kept = DA.DailyBaselines(spark, str(tmp_path))
    with pytest.raises(ValueError):
        kept.load()
    kept.add_days(of(log, *days[:-3]))
    kept.fold(days[-4])
    for d in days[-3:-1]:
        kept.refresh(of(log, d), d)
    part = log.filter(F.to_date("timestamp") < F.lit(days[-1]))
    assert kept.upto() == days[-2] and rounded(kept.load()) == rounded(B.user_baselines(part))
    kept.refresh(of(log, days[-1]), days[-1])
    assert rounded(kept.load()) == rounded(B.user_baselines(log))
    # A corrected day replaces what it held before.
    kept.refresh(of(log, days[5]).filter("user_id <> 'user_1'"), days[5])
    fixed = log.filter((F.to_date("timestamp") != F.lit(days[5])) | (F.col("user_id") != "user_1"))
    assert kept.upto() == days[-1] and rounded(kept.load()) == rounded(B.user_baselines(fixed))


def test_a_refresh_needs_one_day_only(spark, make_log, tmp_path):
    rows = [(f"e{i}", i * 7000, {"user_id": f"u{i % 3}", "session_duration_s": i % 11, "success": i % 4 > 0, "geo_city": f"c{i % 2}"}) for i in range(60)]
    log = make_log(rows)
    log.withColumn("day", F.to_date("timestamp")).write.partitionBy("day").parquet(str(tmp_path / "log"))
    stored = spark.read.parquet(str(tmp_path / "log"))
    names = [r[0] for r in stored.select("day").distinct().orderBy("day").collect()]
    kept = DA.DailyBaselines(spark, str(tmp_path / "state"))
    for d in names:
        kept.refresh(spark.read.parquet(str(tmp_path / "log" / f"day={d}")), d)  # nothing else of the log is there to read
    assert rounded(kept.load()) == rounded(B.user_baselines(log))
    state = kept._state("numbers", names[-1])
    assert state.count() == 3


def test_odd_values(spark, make_log, tmp_path):
    log = make_log([("a", 0, {"session_duration_s": None, "bytes_transferred": None, "success": None}), ("b", 3 * DAY, {"label": "brute_force"}),
                    ("c", DAY, {"user_id": "v", "bytes_transferred": 2**40}), ("d", 2 * DAY, {"user_id": "v", "bytes_transferred": 2**40 + 1})])
    kept = DA.DailyBaselines(spark, str(tmp_path))
    for d in (date(2024, 3, 1), date(2024, 3, 2), date(2024, 3, 3)):
        kept.refresh(of(log, d), d)
    assert rounded(kept.load()) == rounded(B.user_baselines(log))


def test_rolling_drift_equals_the_whole_log(spark, log, days, tmp_path):
    rolling = DA.RollingDrift(spark, str(tmp_path), days=7)
    with pytest.raises(ValueError):
        rolling.drift(log)
    rolling.add_days(log)
    for end in (days[8], days[9], days[13], days[-1]):  # one day on, several, and to the end
        rolling.advance(end)
        seen = log.filter(F.to_date("timestamp") <= F.lit(end))
        assert rounded(rolling.drift(log, "asymptotic")) == rounded(D.user_drift(seen, 7, "asymptotic")), end
    rolling.advance(days[10])  # back: counted anew
    assert rolling.upto() == days[10]


def test_whole_days():
    recent, baseline = DA.whole_days(date(2024, 3, 31), 3)
    assert sorted(recent) == [date(2024, 3, d) for d in (29, 30, 31)] and sorted(baseline) == [date(2024, 3, d) for d in (26, 27)]
    assert not recent & baseline and date(2024, 3, 31) - timedelta(days=3) not in recent | baseline
