"""Scatter corrections refitted for each fold, and principal components of many channels, against direct fits."""

import numpy as np
import pytest

from assayflow.operators import foldwise, validate, wide
from assayflow.operators.validate import SCATTER


def spectra(spark, x, y, fold):
    return spark.createDataFrame([(i, [float(v) for v in r] if r is not None else None, None if t is None else float(t), f, "c") for i, (r, t, f) in enumerate(zip(x, y, fold))], "sample long, spectrum array<double>, y double, fold string, q string").drop("q")


def corrected(x, reference, degree):
    """Each spectrum freed of its slope on the reference and a polynomial, by least squares of its own."""
    z = 2 * np.arange(x.shape[1]) / (x.shape[1] - 1) - 1
    design = np.column_stack([reference, *[z**k for k in range(degree + 1)]])
    c = np.linalg.lstsq(design, x.T, rcond=None)[0]
    return ((x.T - design[:, 1:] @ c[1:]) / c[0]).T


def pls(x, y, a):
    """NIPALS with scores, columns scaled by their sample deviation."""
    mx, my, sx, sy = x.mean(0), y.mean(), x.std(0, ddof=1), y.std(ddof=1)
    e, f = (x - mx) / sx, (y - my) / sy
    w, p, q = [], [], []
    for _ in range(a):
        u = e.T @ f / np.linalg.norm(e.T @ f)
        t = e @ u
        load, c = e.T @ t / (t @ t), f @ t / (t @ t)
        e, f = e - np.outer(t, load), f - c * t
        w, p, q = [*w, u], [*p, load], [*q, c]
    w, p = np.array(w).T, np.array(p).T
    return lambda new: my + sy * ((new - mx) / sx) @ (w @ np.linalg.solve(p.T @ w, np.array(q)))


@pytest.mark.parametrize(("chain", "a", "at_once"), [("msc", 3, 1 << 24), ("emsc", 2, 1), ("msc+center", 1, 400)])
def test_predictions_equal_a_refit_for_each_fold(spark, chain, a, at_once, monkeypatch):
    monkeypatch.setattr(foldwise, "MOST_PRODUCTS", at_once)
    rng = np.random.default_rng(a)
    n, p = 60, 12
    y = rng.normal(size=n)
    x = (5 + np.outer(y, rng.normal(size=p)) + rng.normal(size=(n, p)) + np.linspace(0, 4, p)) * rng.uniform(0.5, 2, (n, 1)) + rng.normal(size=(n, 1))
    fold = [f"f{k % 4}" for k in range(n)]
    got = {(r.sample, r.a): r.predicted for r in validate.predictions(spectra(spark, x, y, fold), a, chain=chain).collect()}
    assert len(got) == n * a
    degree = SCATTER[chain.split("+")[0]]
    for f in set(fold):
        train = np.array([g != f for g in fold])
        reference = x[train].mean(0)
        model = pls(corrected(x[train], reference, degree), y[train], a)
        want = model(corrected(x[~train], reference, degree))
        assert np.allclose([got[i, a] for i in np.flatnonzero(~train)], want, atol=1e-7)


def test_fold_cases(spark):
    x, y = np.random.default_rng(0).normal(size=(12, 5)) + 3, np.arange(12.0)
    rows = spectra(spark, [*x, None], [*y, 1.0], ["a", "b", "c"] * 4 + ["a"])
    assert validate.predictions(rows, 1, chain="msc").count() == 12
    with pytest.raises(ValueError):
        validate.predictions(spectra(spark, x, y, ["a"] * 12), 1, chain="msc")
    for chain in ("msc+snv", "msc+emsc", "center+msc"):
        with pytest.raises(ValueError):
            validate.predictions(rows, 1, chain=chain)
    with pytest.raises(ValueError):
        foldwise.MOST_REFERENCES, was = 10, foldwise.MOST_REFERENCES
        try:
            foldwise.references(rows.filter("spectrum is not null"), "spectrum", "fold")
        finally:
            foldwise.MOST_REFERENCES = was


def direct(x, scale=False):
    z = x - x.mean(0)
    if scale:
        sd = z.std(0, ddof=1)
        z = z / np.where(sd > 0, sd, 1)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    vt = vt * np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(1)])[:, None]
    return s**2 / (len(x) - 1), vt.T, z


def table(spark, x, parts=6):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "sample long, spectrum array<double>").repartition(parts)


@pytest.mark.parametrize(("n", "p", "rank", "scale"), [(120, 5000, 8, False), (300, 40, 40, False), (200, 700, 12, True), (6, 30, 4, False)])
def test_axes_of_many_channels(spark, n, p, rank, scale):
    rng = np.random.default_rng(p)
    x = 10 + rng.normal(size=(n, rank)) * (3.0 * 0.8 ** np.arange(rank)) @ rng.normal(size=(rank, p)) / np.sqrt(p) + 1e-3 * rng.normal(size=(n, p))
    df = table(spark, x)
    model = wide.principal(df, 4, scale=scale)
    values, axes, z = direct(x, scale)
    assert np.abs(model.axes - axes[:, :4]).max() < 1e-6 and np.allclose(model.values, values[:4], rtol=1e-9)
    assert np.allclose(model.shares, values[:4] / values.sum(), rtol=1e-9) and model.residual < 1e-9
    got = {r.sample: r for r in wide.scores(df, model).collect()}
    t = z @ axes[:, :4]
    assert np.allclose([got[i].scores for i in range(n)], t, atol=1e-5)
    assert np.allclose([got[i].t2 for i in range(n)], (t**2 / values[:4]).sum(1), rtol=1e-5) and np.allclose([got[i].q for i in range(n)], (z**2).sum(1) - (t**2).sum(1), atol=1e-5)


def test_wide_cases(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "sample long, spectrum array<double>")
    with pytest.raises(ValueError):
        wide.principal(one, 1)
    same = table(spark, np.ones((5, 3)))
    model = wide.principal(same, 2)
    assert np.allclose(model.values, 0) and np.allclose(model.shares, 0)
    line = table(spark, np.outer(np.arange(6.0), [3.0, 4.0, 0.0]))
    model = wide.principal(line, 3)
    assert model.axes.shape[1] == 1 and np.allclose(model.axes[:, 0], [0.6, 0.8, 0]) and np.allclose(model.shares, [1])
    rows = {r.sample: r.scores for r in wide.scores(one, wide.principal(table(spark, np.eye(4)[:, :2]), 1)).collect()}
    assert rows[2] is None and len(rows[1]) == 1
    with pytest.raises(ValueError):
        wide.MOST_NUMBERS, was = 10, wide.MOST_NUMBERS
        try:
            wide.principal(line, 1)
        finally:
            wide.MOST_NUMBERS = was
