"""Latency sketches against exact ranks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.streaming import hot_path as HP
from wardline.streaming import latency as LT

SCHEMA = "name string, ms double"


def off(values, estimate, p):
    """How far p lies outside the ranks that the estimate has."""
    values = np.sort(values)
    low, high = (np.searchsorted(values, estimate, side) / len(values) for side in ("left", "right"))
    return max(0.0, low - p, p - high)


@pytest.mark.parametrize("kind", ["skewed", "ties", "sorted"])
def test_merged_batches_are_within_the_error(spark, tmp_path, kind):
    rng = np.random.default_rng(3)
    values = {"skewed": rng.lognormal(3, 2, 60000), "ties": rng.integers(0, 5, 60000).astype(float), "sorted": np.arange(60000.0)}[kind]
    for i, part in enumerate(np.array_split(values, 7)):  # batches differ widely where the values are sorted
        df = spark.createDataFrame([("all", float(v)) for v in part], SCHEMA)
        for _ in range(1 + (i == 2)):  # a repeated batch counts once
            LT.store(df, str(tmp_path), i, F.col("name"), F.col("ms"))
    row = LT.percentiles(spark, str(tmp_path)).first()
    assert row["n"] == 60000
    for c, p in LT.PROBABILITIES.items():
        assert off(values, row[c], p) <= LT.rank_error()


def test_size_does_not_grow_with_the_rows(spark):
    def size(n):
        return len(LT.sketches(spark.range(n), F.lit("x"), F.col("id")).first()["sketch"])

    assert size(1_000_000) < 1.5 * size(50_000)


def test_odd_rows(spark, tmp_path):
    rows = [("a", 1.0), ("a", None), ("a", float("nan")), ("a", float("inf")), ("a", 1.0), (None, 5.0), ("none", None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", n string, sketch int")
    LT.store(df, str(tmp_path / "odd"), 0, F.col("name"), F.col("ms"))
    got = {r["name"]: tuple(r)[1:] for r in LT.percentiles(spark, str(tmp_path / "odd")).collect()}
    assert got == {"a": (2, 1.0, 1.0, 1.0), None: (1, 5.0, 5.0, 5.0)}
    assert LT.percentiles(spark, str(tmp_path / "nothing")).count() == 0
    LT.store(df.limit(0), str(tmp_path / "empty"), 0, F.col("name"), F.col("ms"))
    assert LT.percentiles(spark, str(tmp_path / "empty")).count() == 0


def test_a_stopped_stream_goes_on(spark, tmp_path):
    root = str(tmp_path)
    for i in range(2):
        spark.createDataFrame([("x", float(v)) for v in range(i * 50, i * 50 + 50)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
        events = HP.read_events(spark, f"{root}/in", 1, "name string, ms double")
        LT.start_latency(events, f"{root}/out", f"{root}/state", F.col("name"), F.col("ms"), available_now=True).awaitTermination()
    row = LT.percentiles(spark, f"{root}/out").first()
    assert row["n"] == 100 and abs(row["p50"] - 49) <= 2 and row["p99"] >= 96


def test_scoring_keeps_its_latency(spark, make_log, tmp_path, monkeypatch):
    """Every event of a micro-batch counts once, with the time the batch took."""
    root = str(tmp_path)
    make_log([(f"e{i}", i, {}) for i in range(5)]).coalesce(1).write.parquet(f"{root}/in")
    monkeypatch.setattr(HP.Models, "load", lambda *a: None)
    monkeypatch.setattr(HP, "process_batch", lambda *a: {"elapsed_ms": 12.5})
    events = HP.read_events(spark, f"{root}/in", 1, spark.read.parquet(f"{root}/in").schema)
    HP.start_scoring(events, "", "", f"{root}/state", False, True, latency_path=f"{root}/latency").awaitTermination()
    assert tuple(LT.percentiles(spark, f"{root}/latency").first()) == ("score_ms", 5, 12.5, 12.5, 12.5)
