"""Spectra in the binary SPC layout (little-endian, version 0x4B): the x axis and the first trace."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The layout's version byte, header sizes, flags (16-bit y, several traces, own x per trace, stored x) and
# the exponent that marks y as 32-bit floats.
VERSION, HEADER, TRACE_HEADER = 0x4B, 512, 32
SHORT_Y, SEVERAL, OWN_X, STORED_X, FLOATS = 0x01, 0x04, 0x40, 0x80, -128
_MOST_ROWS = 1 << 16


def decode(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """x and y of the first trace; ValueError if the bytes are no such file or end early."""
    if len(raw) < HEADER + TRACE_HEADER or raw[1] != VERSION:
        raise ValueError("not an SPC file of version 0x4B")
    flags, _, _, exponent, n, first, last, _ = struct.unpack_from("<BBBbiddi", raw)
    at = HEADER
    stored = flags & STORED_X and not flags & OWN_X
    begin = at + (4 * n if stored else 0)
    if n < 0 or len(raw) < begin + TRACE_HEADER:
        raise ValueError("the file ends before its trace")
    own_exponent, own_n = struct.unpack_from("<xb14xi", raw, begin)
    if flags & OWN_X:
        n = own_n
    if flags & SEVERAL:
        exponent = own_exponent
    body = begin + TRACE_HEADER
    y_at = body + (4 * n if flags & OWN_X else 0)
    kind = np.dtype("<f4" if exponent == FLOATS else "<i2" if flags & SHORT_Y else "<i4")
    if n < 0 or len(raw) < y_at + n * kind.itemsize:
        raise ValueError("the file ends before its last point")
    y = np.frombuffer(raw, kind, n, y_at).astype(float)
    if exponent != FLOATS:
        y *= 2.0 ** (exponent - 8 * kind.itemsize)
    if stored or flags & OWN_X:
        return np.frombuffer(raw, "<f4", n, at if stored else body).astype(float), y
    return np.linspace(first, last, n), y


def parse_spc(files: DataFrame, name: str = "file", content: str = "content") -> DataFrame:
    """file, x, y, problem: a row per point, ascending in x; a file that can't be read has one row that says why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ["file", "x", "y", "problem"]
        for batch in batches:
            for label, value in zip(batch.column("file"), batch.column("content")):
                try:
                    x, y = decode(value.as_py() or b"")
                except ValueError as e:
                    yield pa.RecordBatch.from_arrays([pa.array([label.as_py()], pa.string()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64()), pa.array([str(e)])], names=fields)
                    continue
                order = np.argsort(x, kind="stable")
                for k in range(0, len(order), _MOST_ROWS):
                    some = order[k : k + _MOST_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([label.as_py()] * len(some), pa.string()), pa.array(x[some]), pa.array(y[some]), pa.nulls(len(some), pa.string())], names=fields)

    return files.select(F.col(name).cast("string").alias("file"), F.col(content).alias("content")).mapInArrow(run, "file string, x double, y double, problem string")


def read_spc(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder or glob; each is one value in one task, a spectrum of some megabytes at most."""
    return parse_spc(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content"))
