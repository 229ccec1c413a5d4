import hashlib

import numpy as np
import pytest

from assayflow.llm import clusters

SCHEMA = "vec_id long, embedding array<float>, own int, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)


def plain(rows, k=8, rounds=10):
    """Every distance in every round."""
    x = [tuple(int(np.floor(1024 * float(np.float32(c)))) for c in v) for _, v in rows]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centroids = [list(v) for _, v in sorted((name(i), v) for (i, _), v in zip(rows, x))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for v in x]
        for j in range(len(centroids)):
            if members := [v for v, o in zip(x, own) if o == j]:
                centroids[j] = [sum(c) // len(members) for c in zip(*members)]
    best = [nearest(v) for v in x]
    total = {j: sum(d for d, o in best if o == j) for _, j in best}
    sums = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), j, d, total[j], sum(total.values()), sums[j]) for (i, _), (d, j) in zip(rows, best))


def found(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize(("n", "dims", "k", "rounds", "grid"), [(300, 4, 8, 10, 0), (200, 2, 8, 10, 1), (200, 3, 2, 5, 0), (120, 2, 4, 3, 1), (60, 3, 1, 3, 0), (5, 3, 8, 10, 0)])
def test_matches_every_distance(spark, n, dims, k, rounds, grid):
    rng = np.random.default_rng(n + dims)
    values = rng.integers(0, 3, (n, dims)) / 8 if grid else rng.normal(size=(n, dims))  # on the grid many are equally near
    rows = [(i % (n - 3), v.tolist()) for i, v in enumerate(values.astype(np.float32))]
    got = clusters.cluster(frame(spark, rows), k, rounds, dims=dims)
    assert found(got) == plain(rows, k, rounds)


def test_vectors_that_do_not_count(spark):
    good = [(1, [0.5, 1.0]), (2, [0.25, -1.0]), (None, [0.5, 1.0]), (2, [0.25, -1.0])]
    bad = [(5, None), (6, []), (7, [1.0]), (8, [1.0, None]), (9, [float("nan"), 0.0]), (10, [float("inf"), 0.0]), (11, [1.0, 2.0, 3.0]), (12, [1e30, 0.0])]
    assert found(clusters.cluster(frame(spark, good + bad), dims=2)) == plain(good)
    assert clusters.cluster(frame(spark, bad), dims=2).count() == 0 and clusters.cluster(frame(spark, []), dims=2).count() == 0


def test_bounds_spare_distances_and_stay_right():
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(12, 6)) * 4000
    x = (middles[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 6)) * 300).astype(np.int64)
    centroids = x[:12].copy()
    bounds = clusters.Bounds.scanned(x, centroids, 3)
    for _ in range(12):
        squares = np.stack([clusters._squares(x, c) for c in centroids], axis=1)
        assert (bounds.own == squares.argmin(axis=1)).all()
        roots = np.sqrt(squares)
        assert (bounds.upper >= roots[np.arange(3000), bounds.own] * (1 - 1e-12)).all()
        assert (bounds.low <= np.take_along_axis(roots, bounds.near, axis=1) * (1 + 1e-12)).all()
        rest = roots.copy()
        np.put_along_axis(rest, np.column_stack([bounds.own, bounds.near]), np.inf, axis=1)
        assert (bounds.rest <= rest.min(axis=1) * (1 + 1e-12)).all()
        old, centroids = centroids, np.array([x[bounds.own == c].sum(axis=0) // max(1, (bounds.own == c).sum()) if (bounds.own == c).any() else centroids[c] for c in range(12)])
        bounds.rescan(x, centroids, np.sqrt(clusters._squares(centroids, old)))
    assert bounds.scans.sum() < 0.5 * 13 * 12 * 3000
