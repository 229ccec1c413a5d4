"""Baselines that need a whole trace at once: asymmetrically reweighted smoothing and the lower convex hull.

A trace is one array; traces are spread over tasks in Arrow batches, and a task holds a batch of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAMBDA, RATIO, ROUNDS = 1e5, 1e-6, 50


#: Points of the traces that are solved together, about.
TOGETHER = 1 << 18


def _solve_many(weights: np.ndarray, values: np.ndarray, lam: float) -> np.ndarray:
    """(W + lam D'D) z = W y with D the second difference: symmetric five-band systems, by LDL' without pivots.

    Rows are places and columns are systems, so each step is one array operation over all systems.
    """
    n, k = values.shape
    d0, d1, d2 = np.zeros(n), np.zeros(n), np.zeros(n)
    for j, c in enumerate((1.0, -2.0, 1.0)):
        d0[j : n - 2 + j] += lam * c * c
    d1[: n - 2] += -2 * lam
    d1[1 : n - 1] += -2 * lam
    d2[: n - 2] += lam
    diag, one, two = weights + d0[:, None], np.zeros((n, k)), np.zeros((n, k))
    z = weights * values
    for i in range(n):
        e = np.full(k, d1[i])
        if i >= 1:
            diag[i] -= one[i - 1] ** 2 * diag[i - 1]
            e -= one[i - 1] * two[i - 1] * diag[i - 1]
            z[i] -= one[i - 1] * z[i - 1]
        if i >= 2:
            diag[i] -= two[i - 2] ** 2 * diag[i - 2]
            z[i] -= two[i - 2] * z[i - 2]
        one[i], two[i] = e / diag[i], d2[i] / diag[i]
    for i in range(n - 1, -1, -1):
        z[i] /= diag[i]
        if i + 1 < n:
            z[i] -= one[i] * z[i + 1]
        if i + 2 < n:
            z[i] -= two[i] * z[i + 2]
    return z


def _solve_smooth(weights: np.ndarray, values: np.ndarray, lam: float) -> np.ndarray:
    """The same for one system."""
    return _solve_many(weights[:, None], values[:, None], lam)[:, 0]


def arpls_many(traces: list[np.ndarray], lam: float = LAMBDA, ratio: float = RATIO, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Asymmetrically reweighted penalised least squares of several traces at once, of any lengths.

    Shorter traces are lengthened by places of no weight, which the smoother meets with a straight line at no cost, so
    their solution is that of the trace alone. Traces of fewer than three points are their own baseline.
    """
    out = [np.asarray(y, float).copy() for y in traces]
    order = sorted((i for i, y in enumerate(out) if len(y) >= 3), key=lambda i: len(out[i]))
    while order:
        many = max(1, TOGETHER // len(out[order[-1]]))
        some, order = order[-many:], order[:-many]
        n = len(out[some[-1]])
        y, inside = np.zeros((n, len(some))), np.zeros((n, len(some)), bool)
        for c, i in enumerate(some):
            y[: len(out[i]), c], inside[: len(out[i]), c] = out[i], True
        w, at = inside.astype(float), np.arange(len(some))
        for _ in range(rounds):
            z = _solve_many(w, y, lam)
            for c, i in enumerate(at):
                out[some[i]] = z[: len(out[some[i]]), c]
            residual = y - z
            below = inside & (residual < 0)
            count = below.sum(0)
            mean = np.where(below, residual, 0.0).sum(0) / np.maximum(count, 1)
            sd = np.sqrt(np.where(below, (residual - mean) ** 2, 0.0).sum(0) / np.maximum(count, 1))
            with np.errstate(divide="ignore", invalid="ignore"):
                new = inside / (1 + np.exp(np.clip(2 * (residual - (2 * sd - mean)) / sd, -500, 500)))
                change = np.linalg.norm(new - w, axis=0) / np.linalg.norm(w, axis=0)
            on = (count > 0) & (sd > 0) & ~(change < ratio)
            if not on.any():
                break
            w, y, inside, at = new[:, on], y[:, on], inside[:, on], at[on]
    return out


def arpls(y: np.ndarray, lam: float = LAMBDA, ratio: float = RATIO, rounds: int = ROUNDS) -> np.ndarray:
    return arpls_many([y], lam, ratio, rounds)[0]


def rubber_band(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The lower convex hull, interpolated; x ascends."""
    hull: list[int] = []
    for i in range(len(x)):
        while len(hull) > 1 and (x[hull[-1]] - x[hull[-2]]) * (y[i] - y[hull[-2]]) <= (y[hull[-1]] - y[hull[-2]]) * (x[i] - x[hull[-2]]):
            hull.pop()
        hull.append(i)
    return np.interp(x, x[hull], y[hull])


def corrected(df: DataFrame, method: str | None, key: str = "trace", x: str = "x", y: str = "y", lam: float = LAMBDA) -> DataFrame:
    """key, x, y, baseline, corrected, method: each trace without its arpls, rubberband or (None) zero baseline.

    Traces are gathered to arrays, sorted by x. Where arpls fails the rubber band stands in and method says so.
    """
    wide = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("p"))
    wide = wide.select(F.col(key).alias("key"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, used = [], []
            pairs = [(np.array(xs, float), np.array(ys, float)) for xs, ys in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
            smooth = arpls_many([ya for _, ya in pairs], lam) if method == "arpls" else [None] * len(pairs)
            for (xa, ya), line in zip(pairs, smooth):
                how = method or "none"
                line = np.zeros(len(ya)) if method is None else rubber_band(xa, ya) if line is None else line
                if not np.isfinite(line).all():
                    line, how = rubber_band(xa, ya), "rubberband after arpls"
                base.append(line.tolist())
                used.append(how)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "x", "y")), pa.array(base, pa.list_(pa.float64())), pa.array(used)], names=["key", "x", "y", "baseline", "method"])

    kind = df.schema[key].dataType.simpleString()
    done = wide.mapInArrow(run, f"key {kind}, x array<double>, y array<double>, baseline array<double>, method string")
    rows = done.select(F.col("key").alias(key), "method", F.explode(F.arrays_zip("x", "y", "baseline")).alias("p")).select(key, "p.*", "method")
    return rows.withColumn("corrected", F.col("y") - F.col("baseline"))
