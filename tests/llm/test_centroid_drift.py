import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from wardline.llm import centroid_drift as CD
from wardline.llm.queries import ORACLES, QUERIES


def plain_distances(a, c):
    return [[sum((int(x) - int(y)) ** 2 for x, y in zip(r, s)) for s in c] for r in a]


def plain(rows, k, rounds, levels=64):
    """rows: (id, floats); Lloyd's rounds as the contract states them."""
    kept = [(i, [int(np.floor(levels * float(x))) for x in v]) for i, v in rows]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    for turn in range(rounds + 1):
        d = plain_distances([v for _, v in kept], centroids)
        own = [min(range(len(centroids)), key=lambda c: (x[c], c)) for x in d]
        if turn < rounds:
            for c in range(len(centroids)):
                mine = [v for (_, v), o in zip(kept, own) if o == c]
                if mine:
                    centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted((i, o, x[o]) for (i, _), o, x in zip(kept, own, d)), centroids


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    found, centroids = CD.clusters(df, **options)
    return sorted((r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()), centroids.tolist(), found


@pytest.mark.parametrize("seed,scale", [(0, 1.0), (1, 0.05), (2, 30.0)])
def test_against_plain_rounds(spark, seed, scale):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 2, (5, 6))
    rows = [(i, (centres[i % 5] + rng.normal(0, 0.3, 6)) * scale) for i in range(400)]
    rows += [(i, [0.5] * 6) for i in range(400, 440)] + [(7, [0.5] * 6)]
    got, centroids, _ = run(spark, rows, k=8, dim=6)
    assert (got, centroids) == plain(rows, 8, 3)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([2, 3, 5]), st.sampled_from([0.1, 1.0, 10.0]))
def test_loosening_bounds_every_member(seed, dim, spread):
    rng = np.random.default_rng(seed)
    old = rng.integers(-50, 50, (4, dim))
    new = old + rng.integers(-20, 21, (4, dim)) * rng.integers(0, 2, (4, 1))
    radius = rng.random(4) * 30 * spread
    loss = CD.loosening(old, new, radius)
    way = rng.normal(size=(200, dim))
    way *= (rng.random((200, 1)) ** (1 / dim)) / np.linalg.norm(way, axis=1, keepdims=True)
    for a in range(4):
        x = old[a] + way * radius[a]
        for j in range(4):
            nearer = np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)
            assert nearer.max() <= loss[a, j] + 1e-9
            assert loss[a, j] <= np.linalg.norm(new[j] - old[j]) + 1e-4


def test_loosening_is_less_than_the_drift():
    old = np.array([[0, 0], [100, 0]])
    sideways, away, near = (CD.loosening(old, np.array([[0, 0], to]), np.array([5.0, 5.0]))[0, 1] for to in ([100, 10], [110, 0], [90, 0]))
    assert sideways < 2 and away < -8 and 9.9 < near < 10.01


def test_most_vectors_are_not_scanned(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 3, (6, 8))
    rows = [(i, centres[i % 6] + rng.normal(0, 0.2, 8)) for i in range(900)]
    got, _, found = run(spark, rows, k=6, dim=8)
    scans = found.agg(F.sum("scans")).first()[0]
    assert 900 <= scans < 2 * 900  # of four passes
    assert got == plain(rows, 6, 3)[0]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 9), (1, [1.0, 0.0], 9), (1, [0.0, 1.0], 9), (2, [nan, 1.0], 9), (3, [inf, 0.0], 9), (4, None, 9), (5, [1.0], 9),
            (6, [1.0, None], 9), (7, [], 9), (None, [3.0, 3.0], 9), (8, [1e30, 0.0], 9), (9, [-0.001, 2e6], 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int")
    found, centroids = CD.clusters(df, dim=2)
    got = sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()), key=str)
    assert len(centroids) == 5 and {i for i, _, _ in got} == {1, 9, None} and len(got) == 5
    assert all(d == 0 for _, _, d in got) and [0, 64] in centroids.tolist() and [-1, 128_000_000] in centroids.tolist()
    none, centroids = CD.clusters(df.limit(0), dim=2)
    assert CD.report(none, centroids).count() == 0
    one, centroids = CD.clusters(df.filter("vec_id = 1").limit(1), dim=2)
    assert [(r["cluster"], r["inertia"]) for r in CD.report(one, centroids).collect()] == [(0, 0)]


def test_large_components_are_exact():
    rng = np.random.default_rng(5)
    a = rng.integers(-CD.LARGEST, CD.LARGEST, (20, 64))
    assert CD.squared(a, a[:3]).tolist() == plain_distances(a, a[:3])


def test_query(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    rows, centroids = plain([(r["vec_id"], r["embedding"]) for r in vectors], 16, 3)
    got = QUERIES["op11_geometric_drift"](spark, sf_dir).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got) == rows
    inertia = [sum(d for _, o, d in rows if o == c) for c in range(16)]
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    assert all((r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) == (inertia[r["cluster"]], sum(inertia), hashes[r["cluster"]]) for r in got)
    assert "op11_geometric_drift" in ORACLES
