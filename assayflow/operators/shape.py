"""Extents of groups of points along their principal axes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def principal_extents(points: DataFrame, by: str) -> DataFrame:
    """by, short, middle: sorted extents over the longest. Axes come from a table of moments, a row per group."""
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    m = points.groupBy(by).agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"], *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs])

    def axes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cov = np.zeros((b.num_rows, 3, 3))
            for a, c in pairs:
                i, j = "xyz".index(a), "xyz".index(c)
                cov[:, i, j] = cov[:, j, i] = b.column(f"c{a}{c}").to_numpy(zero_copy_only=False)
            vectors = np.linalg.eigh(cov)[1].transpose(0, 2, 1).reshape(b.num_rows, 9)
            yield pa.RecordBatch.from_arrays([b.column("of"), pa.array(vectors.tolist(), pa.list_(pa.float64()))], names=["of", "axes"])

    kind = points.schema[by].dataType.simpleString()
    found = m.withColumnRenamed(by, "of").mapInArrow(axes, f"of {kind}, axes array<double>")
    rows = points.join(found, F.col(by) == F.col("of"))
    along = [sum(F.get("axes", F.lit(3 * k + i)) * F.col(c) for i, c in enumerate("xyz")) for k in range(3)]
    spans = rows.groupBy(by).agg(F.sort_array(F.array(*[F.max(v) - F.min(v) for v in along])).alias("e"))
    ratio = lambda k: F.try_divide(F.get("e", F.lit(k)), F.get("e", F.lit(2)))
    return spans.select(by, ratio(0).alias("short"), ratio(1).alias("middle"))
