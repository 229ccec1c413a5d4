"""Whitening of embeddings by a tiled covariance.

Vectors are cut into row blocks and each row block into column blocks. Column blocks are shuffled by row block; where
those of one row block meet, each tile key (a pair of column blocks) gets the product of its two, and the products are
summed for each tile in two steps. Only the assembled matrix, whose size is that of the vectors squared, reaches the
driver, which takes its eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Columns of a block, rows of a row block.
COLUMNS, ROWS = 16, 1024
#: Entries are taken as floor(SCALE * c) + SHIFT; beyond LARGEST in magnitude a double doesn't hold SCALE * c to the unit.
SCALE, SHIFT, LARGEST = 64, 1_000_000, 2.0**45
#: Eigenvalues below this share of the largest are rounding, not spread.
LEAST_SHARE = 1e-12


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(kind, copy=False)


def _sums(vectors: DataFrame, column: str) -> tuple[int, list]:
    """The number of vectors and the sum of each entry: exact for whole numbers."""
    kind = vectors.schema[column].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for b in batches:
            n, total = n + b.num_rows, total + _matrix(b.column(0), np.int64 if kind == "bigint" else np.float64).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()])], names=["n", "s"])

    parts = vectors.select(column).mapInArrow(run, f"n long, s array<{kind}>")
    rows = parts.select("n", F.posexplode("s").alias("k", "s")).groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    return (rows[0]["n"] if rows else 0), [r["s"] for r in sorted(rows, key=lambda r: r["k"])]


def tiled_covariance(vectors: DataFrame, column: str, n: int, sums: list, columns: int = COLUMNS, rows: int = ROWS) -> np.ndarray:
    """The covariance (divisor n) of vectors of one length, centred before they are multiplied."""
    dims = len(sums)
    mean = np.array([s / n for s in sums])
    edges = list(range(0, dims, columns))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for b in batches:
            z = _matrix(b.column(0), np.float64) - mean
            for k in range(0, len(z), rows):
                blocks = [np.ascontiguousarray(z[k : k + rows, e : e + columns]) for e in edges]
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(edges)), pa.array(range(len(edges)), pa.int32()), pa.array([x.tobytes() for x in blocks])], names=["row_block", "column_block", "entries"])
                at += 1

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = {c: np.frombuffer(raw).reshape(-1, min(columns, dims - c * columns)) for c, raw in zip(pdf["column_block"], pdf["entries"])}
        tiles = [(i, j) for i in sorted(blocks) for j in sorted(blocks) if i <= j]
        row = pdf["row_block"].iloc[0]
        return pd.DataFrame({"i": [i for i, _ in tiles], "j": [j for _, j in tiles], "row_block": row, "product": [(blocks[i].T @ blocks[j]).tobytes() for i, j in tiles]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(raw) for raw in pdf["product"]], axis=0)
        return pdf.iloc[:1].assign(product=[total.tobytes()])

    dealt = vectors.select(column).mapInArrow(deal, "row_block long, column_block int, entries binary")
    tile = "i int, j int, row_block long, product binary"
    products = dealt.groupBy("row_block").applyInPandas(multiply, tile)
    lanes = ceil(sqrt(n / rows)) + 1
    some = products.withColumn("lane", F.pmod(F.xxhash64("row_block"), F.lit(lanes))).groupBy("i", "j", "lane").applyInPandas(lambda pdf: add(pdf[["i", "j", "row_block", "product"]]), tile)
    out = np.zeros((dims, dims))
    for r in some.groupBy("i", "j").applyInPandas(add, tile).toLocalIterator():
        a, b = r["i"] * columns, r["j"] * columns
        part = np.frombuffer(r["product"]).reshape(min(columns, dims - a), -1)
        out[a : a + part.shape[0], b : b + part.shape[1]] = part
        out[b : b + part.shape[1], a : a + part.shape[0]] = part.T
    return out / n


def _result(kind: str) -> str:
    return f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Entries are taken as the whole numbers x = floor(64 c) + 1000000. The fit list has each different x vector once, so
    copies of a vector don't draw the components to it. deviation is the sum of (n x - S)^2, exact, and null where it
    doesn't fit a long. whitened is x less its mean on a component, over the root of its eigenvalue. identity_error is
    the largest entry of whitened's own covariance less the identity.

    Vectors that are null or have null or non-finite entries, or entries beyond 2^45, are left out, and so are those
    that aren't of the length that most vectors have (of equally many the longest). Components without spread aren't
    given, so a single different vector, or none, gives no rows. Ids may be null or repeat; other columns are ignored.
    """
    spark = vectors.sparkSession
    entries = F.col(vector_col)
    sound = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) <= LARGEST))
    x = F.transform(entries, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    kept = vectors.filter(entries.isNotNull() & sound & (F.size(entries) > 0)).select(F.col(id_col).alias("vec_id"), x.alias("x"))
    schema = _result(kept.schema["vec_id"].dataType.simpleString())
    length = kept.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if length is None:
        return spark.createDataFrame([], schema)
    kept = kept.filter(F.size("x") == length["size"])
    fit = materialize(kept.select("x").distinct(), "whitening-fit")
    n, sums = _sums(fit, "x")
    values, axes = np.linalg.eigh(tiled_covariance(fit, "x", n, sums))
    values, axes = values[::-1], axes[:, ::-1]
    top = min(components, int((values > max(values[0], 0) * LEAST_SHARE).sum()))
    if not top:
        return spark.createDataFrame([], schema)
    # one sign for all rows: the largest entry of each axis is positive
    axes = axes[:, :top] * np.sign(axes[np.abs(axes[:, :top]).argmax(axis=0), range(top)])
    turn = axes / np.sqrt(values[:top])
    middle = np.array([s // n for s in sums])
    rest = np.array([s - n * (s // n) for s in sums])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off = _matrix(b.column("x"), np.int64) - middle
            # n x - S, from numbers near the mean, so that it is exact
            far = float(np.abs(off).max(initial=0) + 1) * n
            exact = off * n - rest if far * far * len(sums) < 2.0**62 else off.astype(object) * n - rest.astype(object)
            deviation = (exact * exact).sum(axis=1)
            whitened = (exact / n).astype(float) @ turn
            yield pa.RecordBatch.from_arrays([
                b.column("vec_id"), pa.array([int(d) if d < 2**63 else None for d in deviation], pa.int64()),
                pa.ListArray.from_arrays(np.arange(0, (len(off) + 1) * top, top, dtype=np.int32), whitened.ravel()),
            ], names=["vec_id", "deviation", "whitened"])

    out = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, deviation long, whitened array<double>"
    own = fit.select(F.lit(None).cast(kept.schema["vec_id"].dataType).alias("vec_id"), "x").mapInArrow(project, out)
    white = materialize(own.select("whitened"), "whitening-checked")
    error = float(np.abs(tiled_covariance(white, "whitened", n, _sums(white, "whitened")[1]) - np.eye(top)).max())
    shares = F.array(*[F.lit(float(v / values.sum())) for v in values[:top]])
    rows = kept.mapInArrow(project, out).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
