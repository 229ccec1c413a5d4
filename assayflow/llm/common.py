"""What the corpus operators share: reading tables, folding case, bounded slices of batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize, scratch_dir

__all__ = ["ascii_lower", "keep_one", "materialize", "scratch_dir", "slices", "table", "text_sum"]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The rows in slices of at most about `most` bytes of text (a longer text alone), so that word lists stay small."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // most
        edges = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip(np.r_[0, edges], np.r_[edges, batch.num_rows]):
            yield batch.slice(a, b - a)


def text_sum() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def keep_one(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """One row of docs for each part; parts has a row (doc_id, sum, part) per row of docs, sum being text_sum().

    Only rows that go, and those that repeat a row that stays, are joined with docs: no part meets in one task.
    """
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "sum")
    many = parts.groupBy("part").agg(F.min(order).alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    seen = materialize(parts.join(many, "part").groupBy("doc_id", "sum").agg(F.min(order == F.col("first")).alias("stays"), F.count("*").alias("rows")), "copies")
    same = docs["doc_id"].eqNullSafe(F.col("x.of")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("x.of_sum"))
    marks = lambda rows: rows.select(F.col("doc_id").alias("of"), F.col("sum").alias("of_sum")).alias("x")
    repeated = seen.filter("stays and rows > 1")
    if repeated.isEmpty():
        return docs.join(marks(seen.filter("not stays")), same, "left_anti")
    kept = docs.join(marks(seen.filter("not stays or rows > 1")), same, "left_anti")
    again = docs.join(marks(repeated), same, "left_semi").select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_sum().alias("sum"))
    first = Window.partitionBy("id", "sum").orderBy(F.xxhash64("row"))
    return kept.unionByName(again.withColumn("at", F.row_number().over(first)).filter("at = 1").select("row.*"))
