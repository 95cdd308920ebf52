"""Clusters against plain integer rounds."""

import hashlib
import math
import random

import numpy as np
import pytest

from spanloom.llm import centroids


def brute(rows, k, rounds, dims, scale):
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)
    c = [x for _, x in start[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pick = lambda x: min(range(len(c)), key=lambda j: (far(x, c[j]), j))
    for _ in range(rounds):
        mine = [pick(x) for _, x in kept]
        for j in range(len(c)):
            of = [x for (_, x), m in zip(kept, mine, strict=True) if m == j]
            if of:
                c[j] = tuple(sum(col) // len(of) for col in zip(*of, strict=True))
    found = [(i, pick(x), x) for i, x in kept]
    inertia = [sum(far(x, c[j]) for _, m, x in found if m == j) for j in range(len(c))]
    return sorted((str(i), m, far(x, c[m]), inertia[m], sum(inertia), list(c[m])) for i, m, x in found)


def check(spark, rows, k=5, rounds=3, dims=6, scale=64.0, kind="float"):
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster string, x int")
    got = centroids.cluster(df, k, rounds, dims, scale, lead=2).collect()
    got = sorted((str(r["row"]["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid"]) for r in got)
    assert got == brute(rows, k, rounds, dims, scale)


def vectors(rnd, n, dims=6, size=1.0):
    middle = [[rnd.gauss(0, size) for _ in range(dims)] for _ in range(4)]
    return [(i, [float(np.float32(x + rnd.gauss(0, size / 4))) for x in rnd.choice(middle)]) for i in range(n)]


def test_clusters_are_those_of_plain_rounds(spark):
    rnd = random.Random(8)
    rows = vectors(rnd, 400)
    rows += [(900, None), (901, []), (902, [1.0] * 5), (903, [None] + [1.0] * 5), (904, [float("nan")] + [1.0] * 5), (905, [float("inf")] * 6)]
    rows += [(None, [0.5] * 6), (None, [-0.5] * 6), (7, rows[3][1])] + rows[:30] + [(i, [0.0] * 6) for i in range(2000, 2040)]
    check(spark, rows)
    check(spark, rows, k=16, rounds=0)
    check(spark, vectors(rnd, 60, size=1e4), scale=1.0, kind="double")


def test_ties_and_few_vectors(spark):
    check(spark, [(i, [float(i % 3)] * 6) for i in range(50)], k=8)
    check(spark, [(1, [1.0] * 6), (2, [2.0] * 6)], k=16)
    check(spark, [(1, [1.0] * 5)], k=16)
    check(spark, [], k=3)


def test_the_bound_spares_distances():
    rnd = np.random.default_rng(5)
    middle = rnd.normal(0, 300, (16, 64))
    x = np.floor(middle[rnd.integers(0, 16, 2000)] + rnd.normal(0, 20, (2000, 64))).astype(np.int64)
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :8]
    turn = centroids.Rotated(x.mean(0), axes)
    c = x[:16]
    cluster, distance, tried = centroids.nearest(x, *turn.of(x.astype(float)), c, turn.of(c.astype(float)))
    all_ = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (cluster == all_.argmin(1)).all() and (distance == all_.min(1)).all()
    assert tried < all_.size / 2


def test_too_large_components_fail(spark):
    df = spark.createDataFrame([(1, [1e30] * 6)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="would not fit"):
        centroids.cluster(df, dims=6).collect()
