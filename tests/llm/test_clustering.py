"""The threshold walk and whole clusterings against plain distance tables."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from runlens.llm import clustering


def brute(rows, clusters=16, rounds=3, size=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
            and max(map(abs, v)) < 1e6]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
                for _, v in kept]
    for _ in range(rounds):
        near = assign()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, m) in zip(kept, near) if m == n]
            if mine:
                centroids[n] = [sum(col) // len(mine) for col in zip(*mine)]
    near = assign()
    return sorted((((i is None, i or 0), n, d, sum(e for e, m in near if m == n), sum(e for e, _ in near),
                    hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest())
                   for (i, _), (d, n) in zip(kept, near)))


def rows_of(df):
    return sorted(((r[0] is None, r[0] or 0), *r[1:]) for r in map(tuple, df.collect()))


@pytest.mark.parametrize("size,k,spread", [(1, 1, 3), (3, 5, 2), (8, 16, 40), (64, 16, 3), (64, 7, 1000)])
def test_walk_finds_the_nearest(size, k, spread):
    rng = np.random.default_rng(size * k)
    centroids = rng.integers(-spread, spread, (k, size))
    centroids[k // 2] = centroids[0]                                # equal centroids
    vectors = np.concatenate([rng.integers(-spread, spread, (500, size)), centroids,
                              np.full((1, size), 90 * spread)])
    exact = ((vectors[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    cluster, distance = clustering.nearest(vectors, centroids)
    assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()


def test_walk_meets_a_tie_at_the_frontier():
    # centroid 0 is as near as 1, but is met last in every dimension
    centroids = np.array([[2, 0], [0, 2]])
    assert clustering.nearest(np.array([[0, 0]]), centroids)[0][0] == 0
    assert clustering.nearest(np.array([[1, 1]]), centroids[::-1])[0][0] == 0


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((9, 64))
    rows = [(int(i), (centres[i % 9] + rng.standard_normal(64) * 0.3).astype(np.float32).tolist())
            for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(50)] + [rows[7]] * 3
    rows += [(400, None), (401, []), (402, [0.1] * 63), (403, [0.1] * 65), (404, [None] * 64),
             (405, [float("nan")] + [0.0] * 63), (406, [float("inf")] + [0.0] * 63), (407, [0.0] * 64),
             (408, [1e30] + [0.0] * 63), (None, [0.25] * 64)]
    return rows


def test_equals_brute_force(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(5)
    assert rows_of(clustering.cluster_vectors(df)) == brute(vectors)


def test_fewer_vectors_than_centroids_and_other_columns(spark, vectors):
    few = [(i, v) for i, v in vectors[:5]]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in few],
                               "vec_id long, embedding array<double>, cluster int, v string")
    assert rows_of(clustering.cluster_vectors(df)) == brute(few)


def test_empty_and_unusable_tables(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        got = clustering.cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        assert got.count() == 0 and got.columns == [
            "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
