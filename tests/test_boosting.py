"""Softmax boosting against a plain booster that holds all rows in one place."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardline.operators import boosting as BO
from wardline.operators import classify as CL
from wardline.plans import models as PM
from wardline.queries import QUERIES

CLASSES = ["a", "b", "c"]
FEATURES = ["u", "v", "w"]


def made(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    u, v, w = rng.normal(size=n).round(2), rng.integers(0, 4, n), rng.normal(size=n).round(1)
    y = np.where(u + 0.3 * w > 0.4, "a", np.where(v >= 2, "b", "c"))
    rows = [(f"e{i}", float(u[i]), None if i % 50 == 0 else int(v[i]), float("nan") if i % 60 == 1 else float(w[i]), str(y[i]) if i % 90 else "unknown")
            for i in range(n)]
    return rows, spark.createDataFrame(rows, "event_id string, u double, v int, w double, label string")


def plain(rows, hashes, cuts, rounds, depth, step, l2, min_child, share_rows, share_features, seed):
    """One row at a time where it matters: sums by dictionaries, trees as nested tuples."""
    rows = [(h, r) for h, r in zip(hashes, rows) if r[4] in CLASSES]
    x = [[0.0 if z is None or z != z else float(z) for z in r[1:4]] for _, r in rows]
    y = np.array([CLASSES.index(r[4]) for _, r in rows])
    h64 = np.array([h for h, _ in rows])
    margins, trees = np.zeros((len(x), 3)), []

    def build(ids, g, h, c, allowed, level):
        gs, hs = sum(int(g[i, c]) for i in ids), sum(int(h[i, c]) for i in ids)
        leaf = -step * (gs / BO.UNIT) / (hs / BO.UNIT + l2)
        best = (1e-9, None)
        if hs and level < depth:
            for f in allowed:
                for cut in cuts[f]:
                    lg = sum(int(g[i, c]) for i in ids if x[i][f] <= cut)
                    lh = sum(int(h[i, c]) for i in ids if x[i][f] <= cut)
                    a, b = lh / BO.UNIT, hs / BO.UNIT - lh / BO.UNIT
                    if a < min_child or b < min_child:
                        continue
                    u = lg / BO.UNIT
                    t = gs / BO.UNIT
                    gain = u**2 / (a + l2) + (t - u)**2 / (b + l2) - t**2 / (hs / BO.UNIT + l2)
                    if gain > best[0]:
                        best = (gain, (f, cut))
        if best[1] is None:
            return leaf
        f, cut = best[1]
        return (f, cut, build([i for i in ids if x[i][f] <= cut], g, h, c, allowed, level + 1),
                build([i for i in ids if x[i][f] > cut], g, h, c, allowed, level + 1))

    def value(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    for turn in range(rounds):
        g, h = BO.gradients(margins, y)
        ids = np.flatnonzero(BO.sampled_rows(h64, turn, share_rows)).tolist()
        new = [build(ids, g, h, c, BO.sampled_features(3, turn, c, share_features, seed).tolist(), 0) for c in range(3)]
        for c, tree in enumerate(new):
            margins[:, c] += [value(tree, r) for r in x]
        trees += new
    return trees


def nested(nodes):
    at = {r.node: r for r in nodes.itertuples()}

    def of(n):
        r = at[n]
        return r.value if r.feature < 0 else (r.feature, r.threshold, of(r.left), of(r.right))
    return of(0)


def test_equals_a_plain_booster(spark):
    rows, df = made(spark)
    hashes = [r["h"] for r in df.select(F.xxhash64("event_id", F.lit(7)).alias("h")).collect()]
    cuts = [np.array([-1.0, -0.5, 0.0, 0.31, 0.4, 1.0]), np.array([0.0, 1.0, 2.0, 3.0]), np.array([-0.7, 0.0, 0.7])]
    model = BO.fit_boosted(df.repartition(5), FEATURES, rounds=4, depth=3, step=0.3, rows=0.7, columns=0.6, bins=8, min_child=0.5, keep=3,
                           classes=CLASSES, seed=7, cuts=cuts)
    expected = plain(rows, hashes, cuts, 4, 3, 0.3, 1.0, 0.5, 0.7, 0.6, 7)
    got = [nested(t) for _, t in model.nodes.groupby("tree")]
    assert len(got) == 12 and got == expected


def test_trees_do_not_depend_on_partitions(spark):
    _, df = made(spark, 300)
    cuts = [np.array([0.0, 0.5]), np.array([1.0]), np.array([0.0])]
    options = dict(rounds=3, depth=2, classes=CLASSES, cuts=cuts, keep=1)
    one = BO.fit_boosted(df.coalesce(1), FEATURES, **options)
    many = BO.fit_boosted(df.repartition(9), FEATURES, **options)
    assert one.nodes.equals(many.nodes)


def test_learns_and_scores(spark, tmp_path):
    _, df = made(spark, 1500)
    known = df.filter("label <> 'unknown'")
    model = BO.fit_boosted(known, FEATURES, rounds=15, depth=3, step=0.3, classes=CLASSES)
    scored = BO.with_probabilities(known, model)
    rows = scored.select("label", "probabilities").collect()
    right = np.mean([CLASSES[int(np.argmax(r["probabilities"]))] == r["label"] for r in rows])
    assert right > 0.95 and all(abs(sum(r["probabilities"]) - 1) < 1e-9 for r in rows)
    model.save(spark, str(tmp_path / "m"))
    back = BO.BoostedClasses.load(spark, str(tmp_path / "m"))
    assert [r["probabilities"] for r in BO.with_probabilities(known, back).collect()] == [r["probabilities"] for r in rows]
    assert BO.BoostedClasses.load(spark, str(tmp_path / "none")) is None
    assert BO.with_probabilities(known.limit(0), model).count() == 0


def test_cuts(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), None) for i in range(1000)], "x double, y double, z double")
    x, y, z = BO.bin_cuts(df, ["x", "y", "z"], 16)
    assert len(x) == 15 and np.all(np.diff(x) > 30) and y.tolist() == [0, 1, 2] and z.tolist() == [0]
    with pytest.raises(ValueError):
        BO.fit_boosted(df, ["x"], bins=300)


def test_report_is_as_good_as_the_forest(spark, sf_dir):
    boosted = {r["class"]: r["f1"] for r in QUERIES["boosted_report"](spark, sf_dir).collect()}
    forest = {r["class"]: r["f1"] for r in QUERIES["classifier_report"](spark, sf_dir).collect()}
    assert set(boosted) == set(forest)
    assert all(boosted[c] >= forest[c] - 0.02 for c in forest), (boosted, forest)


def test_models_with_boosting(spark, log, tmp_path):
    models, _, _ = PM.train(log, forest_trees=10, class_trees=3, depth=3, algorithm="softmax")
    models.save(str(tmp_path))
    back = PM.Models.load(spark, str(tmp_path))
    a, b = (PM.score(log, m, gate=True).select("event_id", "attack_type", F.round("confidence", 9).alias("c"), "risk_score") for m in (models, back))
    assert sorted(a.collect()) == sorted(b.collect())
    assert CL.classify(log.limit(0).withColumns({c: F.lit(0.0) for c in models.classifier.features if c not in log.columns}), models.classifier).count() == 0


def test_margins_take_newer_trees_without_walking_them():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 8, (300, 3)).astype(np.uint8)
    trees = []
    for i in range(5):
        tree, leaves = BO.Tree(), [0]
        for _ in range(i * 3):
            leaves += tree.split(leaves.pop(0), int(rng.integers(3)), int(rng.integers(7)))
        tree.value = rng.normal(size=len(tree.value)).tolist()
        trees.append(tree)
    begun = rng.normal(size=(300, 2))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(300)), pa.array(np.zeros(300, np.int32)), BO.fixed(x), BO.fixed(begun)], ["h", "y", "x", "m"])
    walked = begun.copy()
    for i, tree in enumerate(trees):
        walked[:, i % 2] += np.array(tree.value)[tree.reached(x)]
    use = np.arange(5, 300, 7)
    assert (BO.margins_of(batch, x, 2, BO.bin_scorer(trees)) == walked).all()
    assert (BO.margins_of(batch, x, 2, BO.bin_scorer(trees), use) == walked[use]).all()


def test_rows_travel_in_blocks(spark):
    rows, df = made(spark)
    cuts = [np.array([-0.5, 0.0, 0.4]), np.array([1.0, 2.0]), np.array([0.0])]
    found = BO.binned(df.coalesce(1), FEATURES, "label", "event_id", cuts, CLASSES, 7).collect()
    known = [r for r in rows if r[4] in CLASSES]
    assert [b.num_rows for b in found] == [1]
    x = BO.matrix(found[0].column(2), np.uint8, 1).reshape(3, -1)
    assert x.T.tolist() == [[int(np.searchsorted(c, 0.0 if z is None or z != z else z)) for c, z in zip(cuts, r[1:4])] for r in known]
    assert BO.matrix(found[0].column(1), np.int32, 1)[:, 0].tolist() == [CLASSES.index(r[4]) for r in known]


def test_only_the_smaller_child_is_added_up(spark, monkeypatch):
    """The sums of the other, taken from the parent, are those that adding up would give."""
    _, df = made(spark, 700)
    cuts = [np.array([-1.0, -0.5, 0.0, 0.31, 0.4, 1.0]), np.array([0.0, 1.0, 2.0]), np.array([-0.7, 0.0, 0.7])]
    add, grow, seen = BO.level_sums, BO.grow, []

    def level_sums(rows, growing, asked, usable, n_values, bins):
        nodes = [t.open for t in growing]
        seen.append((asked, nodes, add(rows, growing, nodes, usable, n_values, bins)))
        return add(rows, growing, asked, usable, n_values, bins)

    def compared(growing, sums, n_cuts, usable, *args):
        for c, t in enumerate(growing):
            for f in usable[c]:
                assert (sums[c, :len(t.open), f] == seen[-1][2][c, :len(t.open), f]).all()
        return grow(growing, sums, n_cuts, usable, *args)

    monkeypatch.setattr(BO, "level_sums", level_sums)
    monkeypatch.setattr(BO, "grow", compared)
    BO.fit_boosted(df.repartition(3), FEATURES, rounds=2, depth=4, rows=0.9, columns=0.7, bins=8, min_child=0.1, classes=CLASSES, cuts=cuts)
    deeper = [(a, n) for asked, nodes, _ in seen for a, n in zip(asked, nodes) if n and n != [0]]
    assert len(deeper) > 6 and all(2 * len(a) == len(n) and set(a) <= set(n) for a, n in deeper)


def test_features_of_few_bins_are_added_up_together():
    n_values = [64, 2, 2, 40, 3, 12, 256, 1]
    groups = BO.bundles(n_values)
    assert sorted(f for g in groups for f in g) == list(range(8)) and len(groups) < 5
    assert all(np.prod([n_values[f] for f in g]) <= BO.TOGETHER for g in groups)
