"""Distances to a principal-component model, their limits, and one-class acceptance."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.columns import dot
from . import gram
from .gram import vector


#: Fixed value: the most degrees of freedom of a distance.
MOST_DOF = 250


@dataclass(frozen=True)
class OutlierModel:
    n: int
    mean: np.ndarray
    scale: np.ndarray
    eigenvalues: np.ndarray  # all, of the n - 1 covariance
    loadings: np.ndarray  # p x A

    @property
    def components(self) -> int:
        return self.loadings.shape[1]


def fit(df: DataFrame, components: int = 2, scale: bool = False, spectrum: str = "spectrum") -> OutlierModel:
    m = gram.moments(df.withColumn("__y", F.lit(0.0)), spectrum, "__y")[None]
    p = len(m.sums) - 1
    sd = np.sqrt(np.diag(m.scatter)[:p] / (m.n - 1)) if scale else np.ones(p)
    values, loadings, _ = gram.principal(m, p, scale)
    rank = int((np.sqrt(values) > np.sqrt(values[0]) * max(m.n, p) * np.finfo(float).eps).sum())
    a = max(1, min(components, rank))
    return OutlierModel(int(m.n), m.mean[:p], np.where(sd > 0, sd, 1.0), values, loadings[:, :a])


def distances(df: DataFrame, model: OutlierModel, spectrum: str = "spectrum") -> DataFrame:
    """df with t2, q and leverage; t2 = (n - 1) leverage. New rows are projected on the stored model."""
    z = F.zip_with(F.zip_with(spectrum, vector(model.mean), lambda v, m: v - m), vector(model.scale), lambda v, s: v / s)
    out = df.withColumn("__z", z)
    scores = F.array(*[dot(F.col("__z"), vector(model.loadings[:, k])) for k in range(model.components)])
    out = out.withColumn("__t", scores)
    eig = vector(model.eigenvalues[: model.components])
    t2 = F.aggregate(F.zip_with("__t", eig, lambda t, e: t * t / e), F.lit(0.0), lambda s, v: s + v)
    out = out.withColumn("t2", t2).withColumn("q", F.greatest(dot(F.col("__z"), F.col("__z")) - dot(F.col("__t"), F.col("__t")), F.lit(0.0)))
    return out.withColumn("leverage", F.col("t2") / (model.n - 1)).drop("__z", "__t")


def t2_limit(model: OutlierModel, alpha: float = 0.05, form: str = "F_textbook") -> float:
    n, a = model.n, model.components
    if form == "chi2" or n - a <= 0:
        return dist.chi2_ppf(1 - alpha, a)
    if form == "beta":
        return (n - 1) ** 2 / n * dist.beta_ppf(1 - alpha, a / 2, (n - a - 1) / 2)
    factor = {"F_textbook": a * (n - 1) / (n - a), "F_n2m1": a * (n * n - 1) / (n * (n - a))}[form]
    return factor * dist.f_ppf(1 - alpha, a, n - a)


def q_limit(model: OutlierModel, alpha: float = 0.05, method: str = "jm", scored: DataFrame | None = None) -> float:
    """Jackson-Mudholkar (jm) or Box's matched chi-squared (box) limit; 0 without residual space.

    Both come from the eigenvalues left out; box takes the mean and variance of q in scored instead, where given.
    """
    rest = model.eigenvalues[model.components :]
    t1, t2, t3 = (float((rest**k).sum()) for k in (1, 2, 3))
    if t1 <= 1e-12 * float(model.eigenvalues.sum()):
        return 0.0
    if method == "box" and scored is not None:
        mean, var = scored.agg(F.avg("q"), F.var_samp("q")).first()
        return var / (2 * mean) * dist.chi2_ppf(1 - alpha, 2 * mean * mean / var)
    if method == "box":
        return t2 / t1 * dist.chi2_ppf(1 - alpha, t1 * t1 / t2)
    h = 1 - 2 * t1 * t3 / (3 * t2 * t2)
    h = h if h > 0 else 1e-6
    c = dist.norm_ppf(1 - alpha)
    return t1 * (c * np.sqrt(2 * t2 * h * h) / t1 + 1 + t2 * h * (h - 1) / t1**2) ** (1 / h)


@dataclass(frozen=True)
class Acceptance:
    """Scaled-distance acceptance: full distance f = nh h / h0 + nq q / q0 against chi-squared limits."""

    nh: int
    h0: float
    nq: int
    q0: float
    critical: float
    outlier: float


def _robust_dof(median: float, iqr: float) -> tuple[int, float]:
    """Degrees of freedom whose chi-squared has this ratio of quartile range to median, and the mean that fits.

    The ratio falls as they grow: its root is bisected between 1 and MOST_DOF and rounded, half to even; a ratio out
    of reach takes the nearer end. Without a spread there is one degree of freedom.
    """
    if not median > 0 or not iqr > 0:
        return 1, max(median or 0.0, 1e-12)
    off = lambda n: (dist.chi2_ppf(0.75, n) - dist.chi2_ppf(0.25, n)) / dist.chi2_ppf(0.5, n) - iqr / median
    low, high = 1.0, float(MOST_DOF)
    if off(low) * off(high) >= 0:
        root = low if abs(off(low)) <= abs(off(high)) else high
    else:
        while high - low > 1e-5:
            root = (low + high) / 2
            low, high = (root, high) if off(root) > 0 else (low, root)
        root = (low + high) / 2
    best = max(1, min(MOST_DOF, round(root)))
    return best, best * median / dist.chi2_ppf(0.5, best)


def acceptance(scored: DataFrame, alpha: float = 0.05, gamma: float | None = 0.01, method: str = "classical") -> Acceptance:
    """Limits from the training rows' leverage and q: one aggregation, then scalars.

    Without a residual space (q is 0 beside the mean leverage) q has no say. Without gamma nothing is an outlier.
    """
    quart = lambda c: [F.percentile(c, q) for q in (0.25, 0.5, 0.75)]
    r = scored.agg(F.count("*"), F.avg("leverage"), F.var_samp("leverage"), F.avg("q"), F.var_samp("q"), F.max("q"), *quart("leverage"), *quart("q")).first()
    n, mean_h, var_h, mean_q, var_q, max_q, h1, h2, h3, q1, q2, q3 = r
    flat = max_q is None or max_q <= 1e-12 * max(1.0, mean_h)

    def classical(mean: float, var: float) -> tuple[int, float]:
        return int(min(MOST_DOF, max(1, round(2 * mean * mean / var)))) if var > 0 else 1, mean

    nh, h0 = classical(mean_h, var_h) if method == "classical" else _robust_dof(h2, h3 - h1)
    nq, q0 = (0, float("inf")) if flat else classical(mean_q, var_q) if method == "classical" else _robust_dof(q2, q3 - q1)
    return Acceptance(nh, h0, nq, q0, dist.chi2_ppf(1 - alpha, nh + nq), dist.chi2_ppf((1 - gamma) ** (1 / n), nh + nq) if gamma else float("inf"))


def accept(scored: DataFrame, limits: Acceptance) -> DataFrame:
    """scored with f, kind (regular, extreme, outlier) and accepted (f <= the critical value)."""
    f = limits.nh * F.col("leverage") / limits.h0 + (F.lit(0.0) if limits.nq == 0 else limits.nq * F.col("q") / limits.q0)
    out = scored.withColumn("f", f)
    kind = F.when(F.col("f") > limits.outlier, "outlier").when(F.col("f") > limits.critical, "extreme").otherwise("regular")
    return out.withColumn("kind", kind).withColumn("accepted", F.col("f") <= limits.critical)
