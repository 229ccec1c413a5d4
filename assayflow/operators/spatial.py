"""Joins by distance and range as equi-joins on buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def near_pairs(left: DataFrame, right: DataFrame, radius: float, xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Rows l, r (structs) and d for all pairs at most radius apart. Each right point goes to the 27 buckets around it."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    a = left.select(F.struct("*").alias("l"), *[cell(c).alias(f"b{k}") for k, c in enumerate(xyz)])
    b = right.select(F.struct("*").alias("r"), *[cell(c).alias(f"c{k}") for k, c in enumerate(xyz)])
    for k in range(3):
        b = b.withColumn(f"s{k}", F.explode(steps)).withColumn(f"b{k}", F.col(f"c{k}") + F.col(f"s{k}")).drop(f"s{k}", f"c{k}")
    d2 = sum((F.col(f"l.{c}") - F.col(f"r.{c}")) * (F.col(f"l.{c}") - F.col(f"r.{c}")) for c in xyz)
    return a.join(b, ["b0", "b1", "b2"]).select("l", "r", F.sqrt(d2).alias("d")).filter(F.col("d") <= radius)


def range_join(points: DataFrame, intervals: DataFrame, at: str, low: Column, high: Column, width: float, how: str = "inner") -> DataFrame:
    """points x intervals with low <= at < high, as a join on buckets of the given width. Columns must not clash.

    An interval goes to every bucket that it touches, so width should be near the typical length of an interval.
    """
    spans = intervals.withColumns({"__low": low, "__high": high})
    buckets = F.sequence(F.floor(F.col("__low") / width), F.floor(F.col("__high") / width))
    dealt = spans.withColumn("__bucket", F.explode(buckets))
    placed = points.withColumn("__place", F.floor(F.col(at) / width))
    inside = (F.col("__place") == F.col("__bucket")) & (F.col(at) >= F.col("__low")) & (F.col(at) < F.col("__high"))
    return placed.join(dealt, inside, how).drop("__low", "__high", "__bucket", "__place")
