"""Moments of a spectral matrix in one distributed pass, and the linear models that follow from them alone.

A partition sums its own p x p products in Arrow batches; Spark adds those up by matrix row. What reaches the driver
depends on the number of channels and folds, never on the number of samples. Sums are taken about the overall mean, so
that leaving a fold out by subtraction loses few digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dot
from .preprocess import channel_stats


@dataclass(frozen=True)
class Moments:
    """n, sums and products of (x, y) about a fixed shift; the last place is y."""

    n: float
    shift: np.ndarray
    sums: np.ndarray
    products: np.ndarray

    def without(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.shift, self.sums - other.sums, self.products - other.products)

    def without_row(self, row: np.ndarray) -> Moments:
        d = row - self.shift
        return Moments(self.n - 1, self.shift, self.sums - d, self.products - np.outer(d, d))

    @property
    def mean(self) -> np.ndarray:
        return self.shift + self.sums / self.n

    @property
    def scatter(self) -> np.ndarray:
        """Products about the mean."""
        return self.products - np.outer(self.sums, self.sums) / self.n


def _batch(b: pa.RecordBatch) -> np.ndarray:
    x = b.column("spectrum")
    return np.column_stack([x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1), b.column("y").to_numpy(zero_copy_only=False)])


def moments(df: DataFrame, spectrum: str = "spectrum", y: str = "y", fold: str | None = None) -> dict[object, Moments]:
    """Moments by fold (key None without folds). Spectra are of one length; rows with a null spectrum or y are left out."""
    rows = df.filter(F.col(spectrum).isNotNull() & F.col(y).isNotNull())
    shift = np.append(channel_stats(rows, spectrum)[0], rows.agg(F.avg(F.col(y).cast("double"))).first()[0])
    slim = rows.select(F.col(spectrum).cast("array<double>").alias("spectrum"), F.col(y).cast("double").alias("y"), (F.col(fold).cast("string") if fold else F.lit("")).alias("fold"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            z = np.column_stack([np.ones(b.num_rows), _batch(b) - shift])
            names, which = np.unique(np.array(b.column("fold").to_pylist()), return_inverse=True)
            for k, name in enumerate(names):
                own = z[which == k]
                total[name] = total.get(name, 0) + own.T @ own
        for name, g in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(g)), pa.array(np.arange(len(g), dtype=np.int32)), pa.array(g.tolist(), pa.list_(pa.float64()))], names=["fold", "i", "v"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": pdf["fold"].iloc[:1], "i": pdf["i"].iloc[:1], "v": [np.sum(np.stack(pdf["v"].to_list()), axis=0)]})

    schema = "fold string, i int, v array<double>"
    cells = slim.mapInArrow(run, schema).groupBy("fold", "i").applyInPandas(add, schema).toPandas()
    out: dict[object, Moments] = {}
    for name, g in cells.groupby("fold"):
        m = np.stack(g.sort_values("i")["v"].to_list())
        out[name if fold else None] = Moments(m[0, 0], shift, m[0, 1:], m[1:, 1:])
    return out


def total(parts: dict[object, Moments]) -> Moments:
    every = list(parts.values())
    return Moments(sum(m.n for m in every), every[0].shift, sum(m.sums for m in every), sum(m.products for m in every))


@dataclass(frozen=True)
class LinearModel:
    """y = intercept + coef x for each number of components 1..A; coef is (A, p). Weights and loadings are (p, A)."""

    coef: np.ndarray
    intercept: np.ndarray
    weights: np.ndarray
    loadings: np.ndarray
    rotations: np.ndarray
    y_loadings: np.ndarray
    score_ss: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def predict(self, spectrum: Column, a: int) -> Column:
        return dot(spectrum, vector(self.coef[a - 1])) + float(self.intercept[a - 1])

    def score(self, spectrum: Column, k: int) -> Column:
        w = self.rotations[:, k] / self.scale
        return dot(spectrum, vector(w)) - float(w @ self.mean)


def vector(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def pls(m: Moments, components: int, scale: bool = True) -> LinearModel:
    """PLS1 by deflating x'x and x'y: the weight of each component is the current x'y, so no scores are needed."""
    s, n = m.scatter, m.n
    p = len(s) - 1
    sd = np.sqrt(np.clip(np.diag(s), 0, None) / (n - 1)) if scale else np.ones(p + 1)
    sd = np.where(sd > 0, sd, 1.0)
    a, b = s[:p, :p] / np.outer(sd[:p], sd[:p]), s[:p, p] / (sd[:p] * sd[p])
    weights, loadings, rotations, ys, tts, coefs = [], [], [], [], [], []
    coef = np.zeros(p)
    for _ in range(max(1, min(components, int(n) - 1, p))):
        size = np.linalg.norm(b)
        if size < 1e-12:
            break
        w = b / size
        tt = w @ a @ w
        load, q = a @ w / tt, b @ w / tt
        r = w.copy()
        for other, turned in zip(loadings, rotations):
            r -= (other @ w) * turned
        coef = coef + q * r
        a, b = a - tt * np.outer(load, load), b - tt * q * load
        for kept, v in ((weights, w), (loadings, load), (rotations, r), (ys, q), (tts, tt), (coefs, coef * sd[p] / sd[:p])):
            kept.append(v)
    return _model(coefs, weights, loadings, rotations, ys, tts, m, sd[:p])


def _model(coefs, weights, loadings, rotations, ys, tts, m: Moments, scale: np.ndarray) -> LinearModel:
    p = len(scale)
    c = np.array(coefs).reshape(-1, p)
    stack = lambda v: np.array(v).reshape(-1, p).T
    return LinearModel(c, m.mean[p] - c @ m.mean[:p], stack(weights), stack(loadings), stack(rotations), np.array(ys), np.array(tts), m.mean[:p], scale)


def principal(m: Moments, components: int, scale: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues (n - 1), loadings (p, A) and explained shares, largest first; the largest weight is positive."""
    p = len(m.sums) - 1
    s = m.scatter[:p, :p] / (m.n - 1)
    if scale:
        sd = np.sqrt(np.diag(s))
        sd = np.where(sd > 0, sd, 1.0)
        s = s / np.outer(sd, sd)
    values, vectors = np.linalg.eigh(s)
    values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(p)])
    a = max(1, min(components, p, int(m.n) - 1))
    return values, vectors[:, :a], values[:a] / values.sum()


def pcr(m: Moments, components: int) -> LinearModel:
    """Regression on principal scores; they are orthogonal, so each coefficient stands alone."""
    _, loadings, _ = principal(m, components)
    p = len(loadings)
    s = m.scatter
    tts = np.einsum("ia,ij,ja->a", loadings, s[:p, :p], loadings)
    ys = loadings.T @ s[:p, p] / np.where(tts > 0, tts, np.inf)
    coefs = np.cumsum(loadings * ys, axis=1).T
    return _model(coefs, loadings.T, loadings.T, loadings.T, ys, tts, m, np.ones(p))


def vip(model: LinearModel) -> np.ndarray:
    """Importance of each channel: the squares sum to the number of channels; zeros where nothing is explained."""
    ss = model.y_loadings**2 * model.score_ss
    w = model.weights / np.linalg.norm(model.weights, axis=0)
    return np.sqrt(len(w) * (w**2 @ ss) / ss.sum()) if ss.sum() > 0 else np.zeros(len(w))
