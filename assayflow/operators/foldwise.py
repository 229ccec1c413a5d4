"""Scatter corrections refitted inside every fold: MSC and EMSC against the mean spectrum of the other folds.

A spectrum x is taken as b times the reference r plus a polynomial along the channels (a constant for MSC). With the
polynomial part of both removed, which is the same for every fold, the fit is b = x.q / q.q, q being what is left of r,
and the corrected spectrum is (x less its polynomial part) / b plus the polynomial part of r. So one product of a batch
with all folds' q gives every b, and no row is copied for each fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dot
from . import gram

#: Numbers in all folds' reference spectra together, and in the products that a task sums at a time.
MOST_REFERENCES, MOST_PRODUCTS = 1 << 23, 1 << 24


def projector(channels: int, degree: int, axis: np.ndarray | None = None) -> np.ndarray:
    """An orthonormal basis, by columns, of polynomials up to a degree along the channels."""
    x = np.arange(channels, dtype=float) if axis is None else np.asarray(axis, float)
    z = 2 * (x - x.min()) / ((x.max() - x.min()) or 1.0) - 1
    return np.linalg.qr(np.column_stack([z**k for k in range(min(degree + 1, channels))]))[0]


def references(rows: DataFrame, spectrum: str, fold: str) -> tuple[list[str], np.ndarray]:
    """Folds and, for each, the mean spectrum of all others: the total less its own sums. Folds x channels reach the driver."""
    width = rows.select(F.size(spectrum)).first()
    n = rows.select(fold).distinct().count()
    if width is not None and n * width[0] > MOST_REFERENCES:
        raise ValueError(f"{n} folds of {width[0]} channels are more than {MOST_REFERENCES} numbers")
    sums = rows.select(F.col(fold).cast("string").alias("f"), F.posexplode(spectrum).alias("k", "v")).groupBy("f", "k").agg(F.sum("v").alias("s"), F.count("*").alias("n")).toPandas()
    names = sorted(sums["f"].unique())
    wide = sums.pivot(index="f", columns="k", values="s").loc[names].to_numpy()
    counts = sums[sums["k"] == 0].set_index("f")["n"].loc[names].to_numpy()
    rest = counts.sum() - counts
    if len(names) < 2:
        raise ValueError("one fold leaves nothing to learn from")
    return names, (wide.sum(axis=0) - wide) / rest[:, None]


def models(rows: DataFrame, components: int, method: str = "pls", degree: int = 0, spectrum: str = "spectrum", y: str = "y", fold: str = "fold", axis: np.ndarray | None = None) -> DataFrame:
    """A row per fold and number of components: f, a, q, w, base, so that a held-out spectrum's prediction is (w.x) / (q.x) + base.

    Each task sums every fold's training products over its own rows; Spark adds them by fold and row of the product,
    and a task per fold fits its models. Folds are taken some at a time where all products together would not fit.
    """
    slim = rows.filter(F.col(spectrum).isNotNull() & F.col(y).isNotNull()).select(F.col(spectrum).cast("array<double>").alias("spectrum"), F.col(y).cast("double").alias("y"), F.col(fold).cast("string").alias("fold"))
    names, refs = references(slim, "spectrum", "fold")
    basis = projector(refs.shape[1], degree, axis)
    part = refs @ basis @ basis.T  # the references' polynomial parts
    q = refs - part
    size = (q * q).sum(axis=1)
    q = q / np.where(size > 0, size, 1.0)[:, None]
    middle = slim.agg(F.avg("y")).first()[0]
    cells = (refs.shape[1] + 2) ** 2
    at_once = max(1, MOST_PRODUCTS // cells)
    out = None
    for low in range(0, len(names), at_once):
        some = _products(slim, names, refs, part, q, basis, middle, range(low, min(len(names), low + at_once)))
        out = some if out is None else out.unionByName(some)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"f": pdf["f"].iloc[:1], "i": pdf["i"].iloc[:1], "v": [np.sum(np.stack(pdf["v"].to_list()), axis=0)]})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.stack(pdf.sort_values("i")["v"].to_list())
        k = names.index(pdf["f"].iloc[0])
        m = gram.Moments(g[0, 0], np.append(refs[k], middle), g[0, 1:], g[1:, 1:])
        found = (gram.pls if method == "pls" else gram.pcr)(m, components)
        w = found.coef - found.coef @ basis @ basis.T
        return pd.DataFrame({"f": names[k], "a": np.arange(1, len(w) + 1), "q": [q[k].tolist()] * len(w), "w": w.tolist(), "base": found.intercept + found.coef @ part[k]})

    schema = "f string, i int, v array<double>"
    return out.groupBy("f", "i").applyInPandas(add, schema).groupBy("f").applyInPandas(fit, "f string, a int, q array<double>, w array<double>, base double")


def _products(slim: DataFrame, names: list[str], refs: np.ndarray, part: np.ndarray, q: np.ndarray, basis: np.ndarray, middle: float, which: range) -> DataFrame:
    """f, i, v: rows of the sums of products of (1, corrected spectrum less the reference, y less its mean) over each fold's training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = refs.shape[1] + 2
        total = np.zeros((len(which), width, width))
        for b in batches:
            z = gram._batch(b)
            x, target = z[:, :-1], z[:, -1] - middle
            left = x - x @ basis @ basis.T
            scales = x @ q.T
            scales = np.where(scales == 0, 1.0, scales)
            folds = np.array(b.column("fold").to_pylist())
            for j, k in enumerate(which):
                train = folds != names[k]
                v = np.column_stack([np.ones(train.sum()), left[train] / scales[train, k][:, None] + part[k] - refs[k], target[train]])
                total[j] += v.T @ v
        for j, k in enumerate(which):
            yield pa.RecordBatch.from_arrays([pa.array([names[k]] * width), pa.array(np.arange(width, dtype=np.int32)), pa.array(total[j].tolist(), pa.list_(pa.float64()))], names=["f", "i", "v"])

    return slim.mapInArrow(run, "f string, i int, v array<double>")


def predictions(rows: DataFrame, components: int, method: str = "pls", degree: int = 0, spectrum: str = "spectrum", y: str = "y", fold: str = "fold") -> DataFrame:
    """rows by number of components (a) with predicted, by models and corrections of the other folds. Null spectra aren't predicted."""
    found = models(rows, components, method, degree, spectrum, y, fold)
    joined = rows.filter(F.col(spectrum).isNotNull()).join(found, F.col(fold).cast("string") == F.col("f"))
    slope = dot(F.col(spectrum), F.col("q"))
    return joined.withColumn("predicted", dot(F.col(spectrum), F.col("w")) / F.when(slope == 0, 1.0).otherwise(slope) + F.col("base")).drop("f", "q", "w", "base")
