"""Preprocessing of spectra in array form (sample, spectrum): row-wise steps as expressions, column steps as models."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dot, mean, snv
from ..functions.savgol import filter_array

DERIVATIVE_WINDOW, DERIVATIVE_POLY = 17, 3
ROW_STEPS = ("snv", "d1", "d2")


def channel_stats(df: DataFrame, spectrum: str = "spectrum") -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each channel: one row per channel comes to the driver."""
    rows = df.select(F.posexplode(spectrum).alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("pos").collect()
    return np.array([r.m for r in rows]), np.array([r.s for r in rows])


def _vector(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _msc(a: Column, reference: np.ndarray) -> Column:
    """Each spectrum freed of its own slope and offset against a reference spectrum."""
    r = reference - reference.mean()
    slope = dot(a, _vector(r)) / float(r @ r or 1.0)
    fit = F.struct(slope.alias("b"), (mean(a) - slope * float(reference.mean())).alias("a"))
    return F.get(F.transform(F.array(fit), lambda q: F.transform(a, lambda v: (v - q["a"]) / F.when(q["b"] == 0, 1.0).otherwise(q["b"]))), F.lit(0))


@dataclass
class Preprocessor:
    """A chain such as "snv+center". fit() learns column steps on its rows only; transform() then applies to any."""

    chain: str
    state: list[tuple[str, np.ndarray, np.ndarray]] = field(default_factory=list)
    length: int = 0

    def __post_init__(self) -> None:
        unknown = set(self.steps) - {"none", *ROW_STEPS, "msc", "center", "autoscale"}
        if unknown:
            raise ValueError(f"unknown steps {sorted(unknown)}")

    @property
    def steps(self) -> list[str]:
        return self.chain.split("+")

    def _apply(self, a: Column, step: str, m: np.ndarray, s: np.ndarray) -> Column:
        if step == "snv":
            return snv(a)
        if step in ("d1", "d2"):
            return filter_array(a, DERIVATIVE_WINDOW, DERIVATIVE_POLY, int(step[1]), self.length)
        if step == "msc":
            return _msc(a, m)
        if step == "center":
            return F.zip_with(a, _vector(m), lambda v, c: v - c)
        if step == "autoscale":
            return F.zip_with(F.zip_with(a, _vector(m), lambda v, c: v - c), _vector(np.where(s == 0, 1.0, s)), lambda v, c: v / c)
        return a

    def fit(self, df: DataFrame, spectrum: str = "spectrum") -> Preprocessor:
        self.state = []
        first = df.select(F.size(spectrum).alias("n")).first()
        self.length = first.n if first else 0
        rows = df
        for step in self.steps:
            m, s = channel_stats(rows, spectrum) if step in ("msc", "center", "autoscale") else (np.zeros(0), np.zeros(0))
            self.state.append((step, m, s))
            rows = rows.withColumn(spectrum, self._apply(F.col(spectrum), step, m, s))
        return self

    def transform(self, df: DataFrame, spectrum: str = "spectrum") -> DataFrame:
        for step, m, s in self.state:
            df = df.withColumn(spectrum, self._apply(F.col(spectrum), step, m, s))
        return df


def emsc(df: DataFrame, axis: np.ndarray, reference: np.ndarray, poly: int = 2, interferents: list[np.ndarray] | None = None, weights: np.ndarray | None = None, spectrum: str = "spectrum") -> DataFrame:
    """df with emsc (scale, coefficients) and the corrected spectrum: x ~ b ref + polynomial + interferents per row.

    All rows share one design, so its pseudo-inverse is found once and each row costs a few dot products.
    """
    z = 2 * (axis - axis.min()) / (axis.max() - axis.min()) - 1
    parts = [reference, *[z**k for k in range(poly + 1)], *(interferents or [])]
    design = np.column_stack(parts)
    root = np.sqrt(weights) if weights is not None else np.ones(len(axis))
    solve = np.linalg.pinv(design * root[:, None]) * root
    coefs = F.array(*[dot(F.col(spectrum), _vector(row)) for row in solve])
    out = df.withColumn("emsc", coefs)
    scale = F.when(F.get("emsc", F.lit(0)) == 0, 1.0).otherwise(F.get("emsc", F.lit(0)))
    base = F.lit(None)
    for k, part in enumerate(parts[1:], 1):
        term = _scaled(part, F.get("emsc", F.lit(k)))
        base = term if k == 1 else F.zip_with(base, term, lambda u, v: u + v)
    return out.withColumn("corrected", F.transform(F.zip_with(F.col(spectrum), base, lambda u, v: u - v), lambda v: v / scale))


def _scaled(part: np.ndarray, by: Column) -> Column:
    return F.transform(_vector(part), lambda v: v * by)


def check_matrix(df: DataFrame, components: int, spectrum: str = "spectrum") -> DataFrame:
    """Findings about a spectral matrix: code, severity, ok."""
    bad = F.exists(spectrum, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    s = df.agg(F.count("*").alias("n"), F.count_distinct(F.size(spectrum)).alias("lengths"), F.count_if(bad).alias("bad"))
    tests = [("one_length", "FAIL", F.col("lengths") <= 1), ("finite", "FAIL", F.col("bad") == 0), ("enough_samples", "WARN", F.col("n") >= 4), ("components_below_samples", "WARN", F.lit(components) < F.col("n"))]
    return s.select(F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.when(ok, "INFO").otherwise(v).alias("severity"), ok.alias("ok")) for c, v, ok in tests])).alias("f")).select("f.*")
