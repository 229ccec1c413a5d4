"""Ranks and quantiles of columns of any length: values are cut into slices of about equally many, ranked slice by slice.

A window without a partition, or one over a large group, would sort everything in one task. Here a task sorts one slice;
the slices' counts, a few hundred numbers, give each its offset.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize

SLICES = 256


def sliced(df: DataFrame, column: str, name: str = "__slice") -> DataFrame:
    """df with the slice (0 and up, by ascending value) of a numeric column; equal values share one. Nulls are in none."""
    rows = df.withColumn("__at", F.col(column).cast("double"))
    edges = rows.approxQuantile("__at", [k / SLICES for k in range(1, SLICES)], 0.25 / SLICES)
    deal = Bucketizer(splits=[float("-inf"), *(sorted(set(edges)) or [0.0]), float("inf")], inputCol="__at", outputCol=name, handleInvalid="keep")
    out = deal.transform(rows.fillna(float("inf"), ["__at"])).withColumn(name, F.when(F.col(column).isNotNull(), F.col(name).cast("int")))
    return out.drop("__at")


def ranked(df: DataFrame, column: str, by: list[str] | None = None, name: str = "rank", ties: str | None = None) -> DataFrame:
    """df with the 0-based place of each row by ascending column (then ties), in each group of `by` or overall.

    Rows are written with their slices, so that counts and places are of the same values: sums of doubles differ in
    their last bits when they are worked out again, which moves a value that is the edge of a slice.
    """
    keys = by or []
    rows = materialize(sliced(df, column), "slices")
    counts = rows.groupBy(*keys, "__slice").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col("__slice").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)  # a row per slice
    offsets = counts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__slice").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    same = F.col("__slice").eqNullSafe(F.col("__of"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    inside = Window.partitionBy(*keys, "__slice").orderBy(column, *([ties] if ties else []))
    placed = rows.withColumn("__k", F.row_number().over(inside) - 1).join(offsets, same)
    return placed.withColumn(name, F.col("__before") + F.col("__k")).select(*df.columns, name)


def quantiles(df: DataFrame, by: list[str], column: str, probabilities: list[float]) -> DataFrame:
    """by, n and one column q0, q1, ... per probability: exact, interpolated between neighbours, nulls left out.

    Unlike percentile() no task holds a group's values; for many small groups that is the faster one.
    """
    rows = df.filter(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("__v"))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
    placed = ranked(rows, "__v", by)
    placed = placed.join(sizes, by) if by else placed.crossJoin(F.broadcast(sizes))  # without keys sizes is one row
    cells = []
    for i, p in enumerate(probabilities):
        at = (F.col("n") - 1) * p
        low, high = (F.max(F.when(F.col("rank") == place, F.col("__v"))) for place in (F.floor(at), F.ceil(at)))
        part = F.max(at - F.floor(at))
        cells.append((low + (high - low) * part).alias(f"q{i}"))
    return placed.groupBy(*by, "n").agg(*cells)
