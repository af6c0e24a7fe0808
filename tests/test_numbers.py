"""Running totals, percentiles, KS and curves against direct computations."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators import drift as D
from wardline.operators import evaluate as E
from wardline.operators.ordered import exact_percentiles, running_totals


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(3)
    rows = [(g, float(rng.choice([rng.randrange(5), rng.gauss(0, 100), 7]))) for g in "ab" for _ in range(700)]
    return rows, spark.createDataFrame(rows, "name string, value double")


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(values, descending):
    rows, df = values
    got = running_totals(df, "name", "value", {"n": F.lit(1)}, descending=descending, ranges=8).collect()
    for r in got:
        mine = [v for g, v in rows if g == r["name"]]
        up_to = sum(v >= r["value"] if descending else v <= r["value"] for v in mine)
        assert (r["cum_n"], r["all_n"]) == (up_to, len(mine))
    assert len(got) == len(set(rows))


def test_percentiles(values):
    rows, df = values
    got = exact_percentiles(df, "name", "value", [0.0, 0.37, 0.5, 0.98, 1.0]).collect()
    assert len(got) == 10
    for r in got:
        mine = [v for g, v in rows if g == r["name"]]
        assert r["percentile"] == pytest.approx(np.percentile(mine, r["prob"] * 100))


def test_exact_pvalue_by_enumeration():
    """All ways to interleave the two samples are equally likely."""
    for n, m in [(3, 3), (4, 3), (5, 4), (2, 6), (6, 6)]:
        stats = []
        for first in itertools.combinations(range(n + m), n):
            i = j = best = 0
            for t in range(n + m):
                i, j = (i + 1, j) if t in first else (i, j + 1)
                best = max(best, abs(i * m - j * n))
            stats.append(best)
        for d in set(stats):
            share = sum(s >= d for s in stats) / len(stats)
            assert D.path_pvalue(n, m, d / (n * m)) == pytest.approx(share)


def test_large_sample_formula_agrees_with_paths(spark):
    df = spark.createDataFrame([(400, 500, 0.08), (900, 800, 0.05), (300, 300, 0.12)],
                               "n_recent long, n_baseline long, ks_stat double")
    exact = D.with_pvalue(df, "auto").select("p_value").toPandas()["p_value"]
    approx = D.with_pvalue(df, "asymptotic").select("p_value").toPandas()["p_value"]
    assert np.allclose(exact, approx, atol=0.02)


def test_sample_size_rule(spark):
    df = spark.createDataFrame([(9, 10, 1.0), (10, 10, 1.0)], "n_recent long, n_baseline long, ks_stat double")
    got = [(r["p_value"] == 1.0, r["drifted"]) for r in D.with_pvalue(df).orderBy("n_recent").collect()]
    assert got == [(True, False), (False, True)]


def test_ks_by_key_and_by_feature_agree(spark):
    rng = random.Random(5)
    rows = [(rng.choice("xy"), float(rng.randrange(24)), rng.choice(["recent", "baseline"])) for _ in range(600)]
    df = spark.createDataFrame(rows, "name string, value double, side string")
    a = {r["name"]: round(r["ks_stat"], 12) for r in D.ks_by_key(df, "name", "value").collect()}
    b = {r["name"]: round(r["ks_stat"], 12) for r in D.ks_by_feature(df).collect()}
    assert a == b
    for name in "xy":
        r = np.sort([v for n, v, s in rows if n == name and s == "recent"])
        o = np.sort([v for n, v, s in rows if n == name and s == "baseline"])
        grid = np.arange(24)
        gap = np.abs(np.searchsorted(r, grid, "right") / len(r) - np.searchsorted(o, grid, "right") / len(o)).max()
        assert a[name] == pytest.approx(gap)


def test_auc_with_ties(spark):
    rng = random.Random(9)
    rows = [("g", round(rng.random(), 1), int(rng.random() < 0.3)) for _ in range(400)]
    got = E.curves(spark.createDataFrame(rows, "g string, s double, y int"), "g", "s", "y").first()
    pos = [s for _, s, y in rows if y]
    neg = [s for _, s, y in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert got["roc_auc"] == pytest.approx(wins / len(pos) / len(neg))


def test_undefined_classes_are_zero(spark):
    df = spark.createDataFrame([("normal", "normal"), ("brute_force", "normal")], "t string, p string")
    rep = {r["class"]: r for r in E.class_report(df, "t", "p").collect()}
    assert (rep["brute_force"]["precision"], rep["brute_force"]["f1"], rep["brute_force"]["support"]) == (0.0, 0.0, 1)
    assert rep["device_spoofing"]["support"] == 0


def test_latency_percentiles(spark):
    got = E.latency_percentiles(spark.range(1, 102).select(F.col("id").alias("ms")), "ms").first()
    assert (got["p50"], got["p95"], got["p99"]) == (51.0, 96.0, 100.0)
