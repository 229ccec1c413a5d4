"""Student t, chi-squared, F, beta and normal distributions in numpy, and as columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

_TINY = 1e-300


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > _TINY else _TINY)
            c = 1 + num / c
            c = c if abs(c) > _TINY else _TINY
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_cdf(x: float, a: float) -> float:
    """Regularised lower incomplete gamma: a series for small x, a continued fraction beyond."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return total * front
    b, c = x + 1 - a, 1 / _TINY
    d = h = 1 / b
    for i in range(1, 1000):
        b += 2
        d = 1 / (b - i * (i - a) * d or _TINY)
        c = b - i * (i - a) / c or _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def _invert(cdf, p: float, low: float, high: float) -> float:
    while cdf(high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def t_cdf(t: float, dof: float) -> float:
    tail = beta_cdf(dof / (dof + t * t), dof / 2, 0.5) / 2
    return 1 - tail if t > 0 else tail


def t_ppf(p: float, dof: float) -> float:
    if not dof > 0 or not 0 < p < 1:
        return math.nan
    if p == 0.5:
        return 0.0
    q = max(p, 1 - p)
    t = _invert(lambda v: t_cdf(v, dof), q, 0.0, 2.0)
    return t if p > 0.5 else -t


def chi2_ppf(p: float, dof: float) -> float:
    return 2 * _invert(lambda v: gamma_cdf(v, dof / 2), p, 0.0, dof + 10)


def beta_ppf(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, a, b) < p else (low, mid)
    return (low + high) / 2


def f_ppf(p: float, d1: float, d2: float) -> float:
    x = beta_ppf(p, d1 / 2, d2 / 2)
    return d2 * x / (d1 * (1 - x))


def norm_cdf(z: float) -> float:
    return math.erfc(-z / math.sqrt(2)) / 2


def norm_ppf(p: float) -> float:
    return math.copysign(_invert(norm_cdf, max(p, 1 - p), 0.0, 2.0), p - 0.5) if p != 0.5 else 0.0


def t_expansion(z: float) -> list[float]:
    """Terms of a Student's quantile in powers of the inverse degrees of freedom, from the normal quantile z."""
    return [
        z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]


def t_quantile(p: float, dof: Column) -> Column:
    """The t quantile for each row's degrees of freedom; null below 1. For tables of models, not of measurements."""

    @pandas_udf("double")
    def quantile(dofs: pd.Series) -> pd.Series:
        known = {d: t_ppf(p, d) for d in dofs.dropna().unique() if d > 0}
        return dofs.map(known).astype(float).where(dofs.notna(), None)

    out = quantile(dof.cast("double"))
    return F.when(~F.isnan(out), out)


def t_two_sided(t: Column, dof: Column) -> Column:
    """The two-sided p-value of each row's t; null without degrees of freedom."""

    @pandas_udf("double")
    def pvalue(ts: pd.Series, dofs: pd.Series) -> pd.Series:
        ok = ts.notna() & dofs.notna() & (dofs > 0)
        return pd.Series([2 * (1 - t_cdf(abs(t), d)) if k else np.nan for t, d, k in zip(ts, dofs, ok)], index=ts.index)

    out = pvalue(t.cast("double"), dof.cast("double"))
    return F.when(~F.isnan(out), out)
