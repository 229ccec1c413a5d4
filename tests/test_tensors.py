"""Closed-form eigenvalues, tensors under operations, axes of view."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayflow.functions import dist
from assayflow.operators import tensors
from assayflow.operators.structure import cartesian


def test_eigenvalues(spark):
    rng = np.random.default_rng(0)
    made = [a @ a.T for a in rng.normal(size=(20, 3, 3))] + [np.diag([1.0, 1, 1]), np.diag([2.0, 2, 5]), np.diag([5.0, 2, 2]), np.zeros((3, 3)), -np.eye(3), np.array([[0, 1, 0], [1, 0, 0], [0, 0, 0.0]])]
    df = spark.createDataFrame([(i, *[float(m[a - 1, b - 1]) for a, b in tensors.PLACES]) for i, m in enumerate(made)], "i long, " + ", ".join(f"{n} double" for n in tensors.NAMES))
    got = df.select("i", *[e.alias(f"e{k}") for k, e in enumerate(tensors.eigenvalues({n: F.col(n) for n in tensors.NAMES}))]).collect()
    assert all(np.allclose([r.e0, r.e1, r.e2], np.linalg.eigvalsh(made[r.i]), atol=1e-7) for r in got)


def test_images_of_a_tensor(spark):
    """Against matrices, in an oblique cell for its own operations and in one whose metric the operations keep."""
    cells = {1: (7.0, 8.0, 9.0, 80.0, 100.0, 95.0), 2: (7.0, 7.0, 9.0, 90.0, 90.0, 120.0)}
    turns = {1: [np.eye(3), -np.eye(3)], 2: [np.eye(3), np.array([[0, -1, 0], [1, -1, 0], [0, 0, 1.0]]), np.array([[0, 1, 0], [1, 0, 0], [0, 0, -1.0]])]}
    u = np.array([[0.03, 0.004, -0.002], [0.004, 0.05, 0.006], [-0.002, 0.006, 0.02]])
    bad = np.diag([0.03, 0.04, -0.01])
    names = [f"u{a}{b}" for a, b in tensors.PLACES]
    atoms = spark.createDataFrame([(s, k, *[float(m[a - 1, b - 1]) for a, b in tensors.PLACES], "x") for s in cells for k, m in enumerate((u, bad))], "structure long, idx long, " + ", ".join(f"{n} double" for n in names) + ", a string")
    ops = spark.createDataFrame([(s, k, *map(int, r.ravel()), 0.0, 0.0, 0.0) for s, found in turns.items() for k, r in enumerate(found)], "structure long, op int, " + ", ".join(f"r{i}{j} int" for i in (1, 2, 3) for j in (1, 2, 3)) + ", t1 double, t2 double, t3 double")
    found = tensors.displaced_images(atoms, ops, spark.createDataFrame([(s, *c) for s, c in cells.items()], "structure long, a double, b double, c double, alpha double, beta double, gamma double")).collect()
    assert len(found) == 2 * (2 + 3)
    scale = math.sqrt(dist.chi2_ppf(0.5, 3))
    for r in found:
        m = cartesian(cells[r.structure])
        n = np.diag(np.linalg.norm(np.linalg.inv(m), axis=1))
        turned = m @ turns[r.structure][r.op] @ np.linalg.inv(m)
        c = turned @ m @ n @ (u, bad)[r.idx] @ n @ m.T @ turned.T
        assert np.allclose([r[x] for x in tensors.NAMES], [c[a - 1, b - 1] for a, b in tensors.PLACES])
        values = np.linalg.eigvalsh(c)
        assert np.allclose([r.e1, r.e2, r.e3], values) and r.u_eq == pytest.approx(np.trace(c) / 3)
        assert (r.a1, r.a3) == ((None, None) if r.idx else (pytest.approx(scale * math.sqrt(values[0])), pytest.approx(scale * math.sqrt(values[2]))))
    by = {}
    for r in found:
        by.setdefault((r.structure, r.idx), []).append((r.e1, r.e2, r.e3))
    assert all(np.allclose(v, v[0]) for v in by.values())  # these operations keep lengths


def cloud(seed, n=30):
    p = np.random.default_rng(seed).gamma(2.0, size=(n, 3)) * [5, 2, 1]
    return p


def turn(seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(3, 3)))
    return q * np.sign(np.linalg.det(q))


def frame(spark, clouds):
    return spark.createDataFrame([(s, k, *map(float, v)) for s, p in clouds.items() for k, v in enumerate(p)], "structure long, idx long, x double, y double, z double")


def coordinates(atoms, axes):
    out = {}
    for r in tensors.seen(atoms, axes).collect():
        out.setdefault(r.structure, {})[r.idx] = (r.u, r.v, r.w)
    return {s: np.array([v[k] for k in sorted(v)]) for s, v in out.items()}


def test_turning_a_structure_turns_nothing_that_is_seen(spark):
    base = cloud(1)
    clouds = {0: base} | {k: base @ turn(k).T + k for k in range(1, 6)}
    mirrored = {9: base * [1, 1, -1]}
    atoms = frame(spark, clouds | mirrored)
    axes = tensors.view_axes(atoms)
    got = coordinates(atoms, axes)
    for k in clouds:
        assert np.allclose(got[k], got[0], atol=1e-6)
    assert not np.allclose(got[9], got[0], atol=0.1) and np.allclose(np.abs(got[9]), np.abs(got[0]), atol=1e-6)
    values = np.sort(np.linalg.eigvalsh(np.cov(base.T, bias=True) * len(base)))[::-1]
    for r in axes.collect():
        m = np.array([[r[f"{a}{k}"] for k in (1, 2, 3)] for a in "xyz"])
        assert np.allclose(m @ m.T, np.eye(3), atol=1e-9) and np.linalg.det(m) == pytest.approx(1) and np.allclose([r.w1, r.w2, r.w3], values)
        assert (got[r.structure][:, 0] ** 3).sum() > 0 and (got[r.structure][:, 2] ** 3).sum() > 0 and r.code == "unique"
    spread = (got[0] ** 2).sum(0)
    assert spread[0] > spread[1] > spread[2]


def test_flat_round_and_single(spark):
    square = np.array([[1, 1, 0], [1, -1, 0], [-1, 1, 0], [-1, -1, 0.0]])
    clouds = {1: square, 2: np.array([[1.0, 2, 3]]), 3: np.array([[1.0, 2, 3]] * 3), 4: np.outer(np.arange(5.0), [0, 3, 4]), 5: np.vstack([square, [[0, 0, 1], [0, 0, -1]]]) * [1, 1, 2**0.5]}
    rows = {r.structure: r for r in tensors.view_axes(frame(spark, clouds)).collect()}
    assert rows[1].code == "degenerate" and rows[1].severity == "WARN" and rows[1].z3 == pytest.approx(1)
    assert rows[2].code == rows[3].code == "single" and (rows[2].x1, rows[2].y2, rows[2].z3) == (1, 1, 1)
    assert (rows[4].x2, rows[4].x3) == (pytest.approx(0.6), pytest.approx(0.8)) and rows[4].code == "unique"
    for r in rows.values():
        m = np.array([[r[f"{a}{k}"] for k in (1, 2, 3)] for a in "xyz"])
        assert np.linalg.det(m) == pytest.approx(1)
    assert tensors.view_axes(frame(spark, clouds).limit(0)).count() == 0


def test_given_sight_roll_and_tilt(spark):
    base = cloud(3)
    atoms = frame(spark, {1: base, 2: base})
    sight = spark.createDataFrame([(1, 0.0, 2.0, 0.0), (2, 1.0, 1.0, 1.0)], "structure long, s1 double, s2 double, s3 double")
    axes = tensors.view_axes(atoms, sight)
    for r in axes.collect():
        z = np.array([0.0, 1, 0]) if r.structure == 1 else np.ones(3) / math.sqrt(3)
        p = (base - base.mean(0)) - np.outer((base - base.mean(0)) @ z, z)
        x = np.linalg.eigh(p.T @ p)[1][:, -1]
        assert np.allclose([r.z1, r.z2, r.z3], z) and abs(np.dot([r.x1, r.x2, r.x3], x)) == pytest.approx(1)
    vectors = spark.createDataFrame([(1, 1.0, 0.0, 1.0), (1, 1.0, 5.0, 0.0), (2, 1.0, 0.0, 0.0), (2, -1.0, 0.0, 0.0)], "structure long, v1 double, v2 double, v3 double")
    rolled = {r.structure: r for r in tensors.rolled(axes, vectors).collect()}
    mean = np.array([2.0, 5, 1])
    one = np.array([[rolled[1][f"{a}{k}"] for k in (1, 2, 3)] for a in "xyz"])
    assert rolled[1].rolled and (one @ mean)[1] == pytest.approx(0, abs=1e-9) and (one @ mean)[0] > 0 and np.linalg.det(one) == pytest.approx(1)
    assert not rolled[2].rolled and rolled[2].x1 == pytest.approx({r.structure: r for r in axes.collect()}[2].x1)
    tilt = {r.structure: r for r in tensors.tilted(axes, 10, 20, 30).collect()}
    m = np.array([[tilt[1][f"{a}{k}"] for k in (1, 2, 3)] for a in "xyz"])
    assert np.linalg.det(m) == pytest.approx(1) and np.allclose(m @ m.T, np.eye(3))
    plain = {r.structure: r for r in tensors.tilted(axes).collect()}
    assert plain[1].x1 == pytest.approx({r.structure: r for r in axes.collect()}[1].x1)
