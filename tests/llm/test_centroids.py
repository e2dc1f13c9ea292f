"""Centroid clustering against a plain version of its definition."""

import hashlib
import math
import random

import numpy as np
import pytest

from xmseq.llm.centroids import clusters, nearest

SCHEMA = "vec_id bigint, embedding array<double>"


def by_hand(rows, k, rounds, width, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centers = [v for _, v in first[:k]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centers))

    for _ in range(rounds if centers else 0):
        own = [[v for _, v in kept if place(v)[1] == n] for n in range(len(centers))]
        centers = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(own, centers, strict=True)]
    out = [(i, *reversed(place(v))) for i, v in kept] if centers else []
    total = sum(d for _, _, d in out)
    return sorted((str(i), c, d, sum(e for _, b, e in out if b == c), total, centers[c]) for i, c, d in out)


def found(df):
    return sorted((str(r[0]), *r[1:5], [int(x) for x in r["centroid"]]) for r in df.collect())


def vectors(n, width, seed=0):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.25, 1.0]) if i % 3 else rng.gauss(0, 1) for _ in range(width)]) for i in range(n)]
    rows += [(i + n, rows[0][1]) for i in range(20)]
    return rows + [(n + 30, None), (n + 31, [None] * width), (n + 32, [float("nan")] * width), (n + 33, [math.inf] * width), (n + 34, [0.0] * (width + 1)), (n + 35, []), (None, [0.5] * width), (3, [9.0] * width)]


@pytest.mark.parametrize(("k", "rounds", "width"), [(8, 10, 6), (3, 2, 1), (8, 0, 2), (40, 3, 4)])
def test_against_plain_version(spark, k, rounds, width):
    rows = vectors(60, width)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(clusters(df, k, rounds, width)) == by_hand(rows, k, rounds, width)


def test_few_none_and_clashing_columns(spark):
    rows = [(1, [0.1, 0.2]), (1, [0.1, 0.2]), (2, [-0.1, 5.0])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as cluster", "2 as x", "3 as id", "4 as distance", "5 as centroid")
    assert found(clusters(df, width=2)) == by_hand(rows, 8, 10, 2)
    empty = clusters(spark.createDataFrame([], SCHEMA), width=2)
    assert empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"] and empty.count() == 0
    assert clusters(spark.createDataFrame([(None, [1.0, 2.0])], SCHEMA), width=2).count() == 0


def test_large_components(spark):
    rows = [(i, [(-1) ** i * 1e9 + i, 3e8 * i]) for i in range(12)] + [(50, [1.0, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    want = by_hand(rows, 4, 3, 2)
    got = sorted(clusters(df, 4, 3, 2).collect(), key=lambda r: str(r[0]))
    for r, w in zip(got, want, strict=True):
        assert (str(r[0]), r[1], [int(x) for x in r["centroid"]]) == (w[0], w[1], w[5])
        assert r["distance"] == (w[2] if w[2] < 2**63 else None) and r["inertia"] == (w[4] if w[4] < 2**63 else None)


def test_ties_go_to_the_smaller_number():
    centers = np.array([[4, 0], [0, 4], [0, 4], [-4, 0]])
    cluster, distance = nearest(np.array([[0, 0], [2, 2], [0, 4]]), centers)
    assert cluster.tolist() == [0, 0, 1] and distance.tolist() == [16, 8, 0]


def test_walk_equals_all_distances():
    rng = np.random.default_rng(1)
    for _ in range(30):
        x, c = rng.integers(-9, 9, (50, 5)), rng.integers(-9, 9, (7, 5))
        all_ = ((x[:, None] - c[None]) ** 2).sum(2)
        cluster, distance = nearest(x, c)
        assert cluster.tolist() == all_.argmin(1).tolist() and distance.tolist() == all_.min(1).tolist()
