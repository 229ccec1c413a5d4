"""Principal components of spectra with many channels, where a channels x channels matrix is too large to make.

Block Krylov iteration: each pass multiplies a few vectors by the scatter matrix, row by row where the spectra lie, and
adds up a channels x block product. The driver holds such blocks alone, orthonormal, and finds the best axes within
all of them; their residuals, which it has for nothing, say when to stop.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors beyond those asked for, blocks kept before a restart, passes at most, and numbers that the driver may hold.
SPARE, BLOCKS, PASSES, MOST_NUMBERS = 6, 12, 80, 1 << 26


@dataclass(frozen=True)
class WideModel:
    """values: eigenvalues (divisor n - 1), axes (channels x A), shares of all spread, residual: how far from exact, to the largest value."""

    n: int
    mean: np.ndarray
    scale: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    shares: np.ndarray
    residual: float
    passes: int


def _spectra(b: pa.RecordBatch) -> np.ndarray:
    x = b.column(0)
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _summed(rows: DataFrame, make, width: int) -> np.ndarray:
    """The sum over all batches of make(matrix), an array of `width` columns: by tasks, then by lanes, then whole. One row per row of it reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = make(_spectra(b))
                total = part if total is None else total + part
        if total is not None:
            at = TaskContext.get().partitionId()
            for k, v in enumerate(total):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at], pa.int32()), pa.array([np.ascontiguousarray(v).tobytes()])], names=["k", "lane", "v"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(v=[np.sum([np.frombuffer(v) for v in pdf["v"]], axis=0).tobytes()])

    schema = "k int, lane int, v binary"
    lanes = ceil(sqrt(rows.rdd.getNumPartitions()))
    parts = rows.mapInArrow(run, schema).withColumn("lane", F.pmod("lane", F.lit(lanes)).cast("int"))
    found = parts.groupBy("k", "lane").applyInPandas(add, schema).groupBy("k").applyInPandas(add, schema)
    out = {r["k"]: np.frombuffer(r["v"]) for r in found.toLocalIterator()}
    return np.stack([out[k] for k in sorted(out)]) if out else np.zeros((0, width))


def principal(df: DataFrame, components: int, spectrum: str = "spectrum", scale: bool = False, tolerance: float = 1e-11, seed: int = 0) -> WideModel:
    """The first principal axes of spectra of one length, however many channels they have; null spectra are left out.

    An axis is off by its residual over the gap to the next value, in parts of the largest. It stops when the largest
    residual is below the tolerance or the blocks span all channels or all spread. The largest weight is positive.
    """
    rows = df.filter(F.col(spectrum).isNotNull()).select(F.col(spectrum).cast("array<double>").alias("spectrum"))
    sums = _summed(rows, lambda x: np.vstack([x.sum(axis=0), np.full(x.shape[1], len(x))]), 0)
    if not len(sums) or sums[1, 0] < 2:
        raise ValueError("principal components need two spectra at least")
    n, mean = int(sums[1, 0]), sums[0] / sums[1, 0]
    p = len(mean)
    squares = _summed(rows, lambda x: ((x - mean) ** 2).sum(axis=0, keepdims=True), p)[0]
    sd = np.sqrt(squares / (n - 1)) if scale else np.ones(p)
    sd = np.where(sd > 0, sd, 1.0)
    total = float((squares / sd**2).sum())
    block = min(p, components + SPARE)
    if p * block * 2 * BLOCKS > MOST_NUMBERS:
        raise ValueError(f"{components} components of {p} channels are more than the driver may hold")

    def times(v: np.ndarray) -> np.ndarray:
        def make(x: np.ndarray) -> np.ndarray:
            z = (x - mean) / sd
            return (z.T @ (z @ v)).T

        return _summed(rows, make, p).T

    v = np.linalg.qr(np.random.default_rng(seed).normal(size=(p, block)))[0]
    basis, image = np.zeros((p, 0)), np.zeros((p, 0))
    for done in range(1, PASSES + 1):
        basis, image = np.hstack([basis, v]), np.hstack([image, times(v)])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:block], turn[:, ::-1][:, :block]
        axes, moved = basis @ turn, image @ turn
        a = min(components, len(values), int((values > values[0] * 1e-13).sum()) or 1)
        off = moved - axes * values
        residual = float(np.linalg.norm(off[:, :a], axis=0).max() / max(values[0], 1e-300))
        if residual <= tolerance or basis.shape[1] >= p or values[0] <= 0:
            break
        if basis.shape[1] >= block * BLOCKS:
            basis, image = axes, moved
        v = off
        for least in (1e-13 * values[0], 0.5):  # twice, so that what is left is at right angles to rounding
            v, r = np.linalg.qr(v - basis @ (basis.T @ v))
            v = v[:, np.abs(np.diag(r)) > least]
        if not v.shape[1]:
            break
    axes = axes[:, :a] * np.where(axes[np.abs(axes[:, :a]).argmax(axis=0), range(a)] < 0, -1.0, 1.0)
    return WideModel(n, mean, sd, values[:a] / (n - 1), axes, values[:a] / total if total > 0 else np.zeros(a), residual, done)


def scores(df: DataFrame, model: WideModel, spectrum: str = "spectrum", key: str = "sample") -> DataFrame:
    """key, scores (one per axis), t2 and q of each spectrum; null ones have nulls."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = (_spectra(b) - model.mean) / model.scale
            t = z @ model.axes
            q = np.maximum((z * z).sum(axis=1) - (t * t).sum(axis=1), 0)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(t.tolist(), pa.list_(pa.float64())), pa.array((t * t / model.values).sum(axis=1)), pa.array(q)], names=[key, "scores", "t2", "q"])

    rows = df.filter(F.col(spectrum).isNotNull()).select(F.col(spectrum).cast("array<double>"), key)
    out = rows.mapInArrow(run, f"{key} {kind}, scores array<double>, t2 double, q double")
    none = df.filter(F.col(spectrum).isNull()).select(key, *[F.lit(None).cast(t).alias(c) for c, t in (("scores", "array<double>"), ("t2", "double"), ("q", "double"))])
    return out.unionByName(none)
