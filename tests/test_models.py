"""Forest, oversampling, split, classifier, attribution and the jobs around them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators import adwin as AD
from wardline.operators import attribution as AT
from wardline.operators import classify as CL
from wardline.operators import iforest as IF
from wardline.operators import sampling as SA
from wardline.operators import scoring as SC
from wardline.operators import smote as SM
from wardline.plans import models as PM
from wardline.plans import retrain as RT
from wardline.sources import stores
from wardline.sources.schema import FEATURES


@pytest.fixture(scope="module")
def trained(log):
    return PM.train(log, forest_trees=50, class_trees=10, depth=6)


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    pts = rng.normal(size=(600, 3))
    pts[:200] = pts[0]                      # a third of the rows are copies of one point
    pts[200:300] = np.round(pts[200:300], 1)
    rows = [("a" if i % 4 else "b", f"p{i:03d}", [float(v) for v in p]) for i, p in enumerate(pts)]
    return rows, spark.createDataFrame(rows, "label string, id string, x array<double>")


@pytest.mark.parametrize("block_rows", [16, 1000])
def test_neighbours_are_exact(cloud, block_rows):
    rows, df = cloud
    got = {r["id"]: [n["dist"] for n in r["near"]] for r in SM.nearest_in_class(df, 3, block_rows=block_rows).collect()}
    assert len(got) == len(rows)
    for label in "ab":
        ids = [i for g, i, _ in rows if g == label]
        x = np.array([v for g, _, v in rows if g == label])
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        np.fill_diagonal(d, np.inf)
        best = np.sort(d, axis=1)[:, :3]
        assert np.allclose([got[i] for i in ids], best)


def test_oversampling_balances(log):
    rows = log.select("event_id", "label", "session_duration_s", "bytes_transferred")
    out = SM.oversample(rows, ["session_duration_s", "bytes_transferred"])
    sizes = {r[0]: r[1] for r in out.groupBy("label").count().collect()}
    assert len(set(sizes.values())) == 1
    assert out.filter("NOT synthetic").count() == rows.count()
    assert out.select("event_id").distinct().count() == out.count()
    # New rows lie between rows of their class.
    ends = rows.groupBy("label").agg(F.min("bytes_transferred").alias("lo"), F.max("bytes_transferred").alias("hi"))
    assert out.join(ends, "label").filter("bytes_transferred < lo OR bytes_transferred > hi").isEmpty()


def test_split_is_exact_and_stable(log):
    marked = SA.stratified_split(log.select("event_id", "label"))
    again = SA.stratified_split(log.select("event_id", "label").repartition(13))
    assert sorted(marked.collect()) == sorted(again.select(*marked.columns).collect())
    for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect():
        assert r["t"] == int(r["n"] * 0.2 + 0.5)


def test_forest_scores(spark, log, trained):
    forest = trained[0].forest
    rows = spark.createDataFrame(
        [(f"e{i}", float(i % 10), float(i % 7)) for i in range(500)] + [("far", 500.0, -900.0)],
        "event_id string, a double, b double")
    f = IF.fit_forest(rows, ["a", "b"], trees=60)
    g = IF.fit_forest(rows.repartition(9), ["a", "b"], trees=60)
    scored = IF.with_isolation_score(rows, f)
    low, high = scored.agg(F.min("isolation_score"), F.max("isolation_score")).first()
    assert 0 < low and high < 1
    assert scored.orderBy(F.desc("isolation_score")).first()["event_id"] == "far"
    # Trees depend on the data and the seed, not on the partitioning.
    assert sorted(f.nodes.collect()) == sorted(g.nodes.collect())
    assert forest.nodes.select("tree").distinct().count() == 50


def test_training_reports(trained):
    _, binary, classes = trained
    assert binary.first()["roc_auc"] > 0.5
    rep = {r["class"]: r for r in classes.collect()}
    assert rep["normal"]["recall"] > 0.8 and rep["brute_force"]["f1"] > 0.5


@pytest.mark.parametrize("norm,floor", [("minmax", None), ("shift", 0.4)])
def test_scored_ranges(log, trained, norm, floor):
    scored = PM.score(log, trained[0], norm=norm, min_confidence=floor)
    assert scored.count() == log.count()
    bad = scored.filter(
        "anomaly_score NOT BETWEEN 0 AND 1 OR confidence NOT BETWEEN 0 AND 1 OR NOT CASE attack_type "
        "WHEN 'normal' THEN risk_score BETWEEN 0 AND 30 WHEN 'unknown_anomaly' THEN risk_score BETWEEN 40 AND 70 "
        "ELSE risk_score BETWEEN 50 AND 100 END")
    assert bad.isEmpty()
    assert SC.alert_rows(scored).filter("reason IS NULL OR reason = ''").isEmpty()


def test_gate_keeps_low_scores_normal(log, trained):
    scored = PM.score(log, trained[0], gate=True)
    assert scored.filter("decision < 0 AND attack_type <> 'normal'").isEmpty()


def test_attributions_add_up(spark, log, trained):
    models = trained[0]
    table = PM.training_table(log, models.baselines).limit(50)
    got = AT.with_attributions(CL.classify(table, models.classifier), models.classifier, n_top=len(FEATURES))
    nodes = AT.tree_nodes(models.classifier, spark).filter("node = 0").collect()
    root = np.mean([np.array(r["stats"]) / sum(r["stats"]) for r in nodes], axis=0)
    for r in got.collect():
        at = CL.CLASSES.index(r["attack_type"])
        assert root[at] + sum(t["credit"] for t in r["top_features"]) == pytest.approx(r["probabilities"][at], abs=1e-6)


def test_boosted_alternative(log):
    from wardline.operators.baselines import fit_baselines

    table = PM.training_table(log, fit_baselines(log))
    model = CL.fit_classifier(table, FEATURES, algorithm="boosted", trees=2, depth=2)
    row = CL.classify(table, model).first()
    assert sum(row["probabilities"]) == pytest.approx(1.0)
    assert row["confidence"] == max(row["probabilities"])


def test_models_round_trip(spark, log, trained, tmp_path):
    trained[0].save(str(tmp_path))
    back = PM.Models.load(spark, str(tmp_path))
    cols = ["event_id", "attack_type", F.round("decision", 9), F.round("confidence", 9)]
    a, b = PM.score(log, trained[0]).select(*cols), PM.score(log, back).select(*cols)
    assert sorted(a.collect()) == sorted(b.collect())


def test_retrain_registers_a_version(spark, log, trained, tmp_path):
    root = str(tmp_path)
    alerts = SC.alert_rows(PM.score(log, trained[0]))
    stores.append_alerts(alerts, f"{root}/alerts")
    stored = stores.read_alerts(spark, f"{root}/alerts")
    first = stored.filter("attack_type <> 'normal'").orderBy("id").first()
    assert stores.append_feedback(spark, f"{root}/fb", stored, first["id"], "dismiss") == "dismissed"
    feedback = stores.read_feedback(spark, f"{root}/fb")
    label = RT.relabelled(log, stored, feedback).filter(F.col("event_id") == first["event_id"]).first()["label"]
    assert label == "normal"
    for _ in range(2):
        RT.retrain(log, stored, feedback, root, forest_trees=5, class_trees=2, depth=3)
    got = [(r["version"], r["status"]) for r in RT.versions(spark, f"{root}/versions").collect()]
    assert got == [(2, "active"), (1, "archived")]


def test_adwin(spark):
    steady = [("s", i, float(i % 2)) for i in range(600)]
    shifted = [("c", i, float(i % 2) + (5.0 if i >= 300 else 0.0)) for i in range(600)]
    df = spark.createDataFrame(steady + shifted, "k string, i int, v double").repartition(5)
    got = {r["key"]: r for r in AD.detect(df, "k", ["i"], "v").collect()}
    assert not got["s"]["drifted"] and got["s"]["n_values"] == 600
    assert got["c"]["drifted"] and 300 <= got["c"]["drift_at_index"] <= 360


def test_large_training_part_of_a_split_fills_every_tree(spark):
    rows = SA.stratified_split(spark.range(20_000).selectExpr("cast(id as string) AS event_id", "'normal' AS label", "cast(id % 97 as double) AS a"))
    train = rows.filter(~F.col("is_test"))
    sizes = {r["tree"]: r["count"] for r in IF.tree_samples(train, ["a"], "event_id", train.count(), 5, 16, 42).groupBy("tree").count().collect()}
    assert sizes == {t: 16 for t in range(5)}


def test_boxes_leave_few_cells_to_visit():
    """Points along a line in one wide and one narrow direction: balls around pivots meet, boxes do not."""
    rng = np.random.default_rng(3)
    rows = [("a", f"p{i}", [float(rng.uniform(0, 1e6)), float(rng.integers(0, 3) * 1e4)]) for i in range(4000)]
    cuts = SM.Cuts(np.array([r[2] for r in rows]), 64, 0)
    x = np.array([r[2] for r in rows])
    cell = cuts.cell(x)
    groups = [x[cell == c] for c in range(cuts.n)]
    boxes = SM.Boxes(list(range(cuts.n)), [g.min(0) for g in groups], [g.max(0) for g in groups], [1] * cuts.n)
    visits = 0
    for c, g in enumerate(groups):
        d = np.sort(SM._distances(g, g), axis=1)[:, 3]
        visits += len(boxes.reached(g, d, c)[0])
    assert cuts.n >= 48 and visits < len(rows)


def test_arrow_batches_of_oversampling_hold_points_not_blocks(cloud):
    """Rows that meet reach Python one by one; whole blocks in a row made batches of gigabytes."""
    plan = SM.nearest_in_class(cloud[1], 3, block_rows=16)._jdf.queryExecution().toString()
    assert "visitors" not in plan and "members" not in plan
