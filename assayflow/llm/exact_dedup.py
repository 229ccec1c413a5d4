"""Exact dedup: rows grouped by a 128-bit content hash, bytes compared inside the groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = ascii_lower(F.col(text_col))
    return docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), norm.alias("norm")).withColumn("hash", F.unhex(F.md5("norm")))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per different text: hash, part, keep_id, group_size.

    min(norm) = max(norm) compares the bytes of every text in a group while partial aggregation sends at most one
    pair of texts from each task, so a group of any size never meets in one task. part is null in such a group; where
    two texts share a hash, each gets its own row and part is its SHA-256.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    hashed = _hashed(docs, id_col, text_col).select("id", "norm", "hash")
    found = materialize(
        hashed.groupBy("hash").agg(pick("id").alias("keep_id"), F.count("*").alias("group_size"), (F.min("norm") != F.max("norm")).alias("collides")),
        "dedup-groups",
    )
    clean = found.filter(~F.col("collides")).select("hash", F.lit(None).cast("string").alias("part"), "keep_id", "group_size")
    if found.filter("collides").isEmpty():
        return clean
    split = (
        hashed.join(found.filter("collides").select("hash"), "hash", "left_semi")
        .groupBy("hash", "norm")
        .agg(pick("id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("hash", F.sha2("norm", 256).alias("part"), "keep_id", "group_size")
    )
    return clean.unionByName(split)


def _marked(docs: DataFrame, id_col: str, text_col: str, keep: str) -> DataFrame:
    found = groups(docs, id_col, text_col, keep).withColumnRenamed("hash", "group_hash")
    rows = _hashed(docs, id_col, text_col).select("row", "id", "hash", F.sha2("norm", 256).alias("sha"))
    return rows.join(found, (F.col("hash") == F.col("group_hash")) & (F.col("part").isNull() | (F.col("part") == F.col("sha"))))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """A row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null and empty texts form one
    group. keep names which id of a group stays, the smallest or the largest. Null ids are counted but never stay
    unless the whole group has none (then keep_id is null and nothing is kept). Rows that repeat both id and text are
    all marked kept, since nothing tells them apart. An empty table gives an empty result; other columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _marked(slim, "doc_id", "text", keep).select(
        F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """docs with all its columns, one row of each group of equal texts (see exact_dedup for nulls).

    Of rows that repeat id and text one stays. Where no row of a group has an id, one row of each different text as
    it was given stays: nothing names the row to keep, so texts that differ in case are not lost.
    """
    kept = _marked(docs, id_col, text_col, keep).filter(F.col("id").eqNullSafe(F.col("keep_id")))
    given = F.when(F.col("id").isNull(), F.sha2(F.coalesce(F.col(f"row.{text_col}"), F.lit("")), 256)).alias("given")
    same = ["id", "sha", "given"]
    rows = _hashed(docs, id_col, text_col).select("row", "id", F.sha2("norm", 256).alias("sha"))
    repeats = materialize(rows.select("id", "sha", given).groupBy(*same).count().filter("count > 1").drop("count"), "repeats")
    if repeats.isEmpty():
        return kept.select("row.*")
    kept = kept.select("row", "id", "sha", given)
    marks = repeats.select(*[F.col(c).alias(f"of_{c}") for c in same])
    meets = F.col("sha") == F.col("of_sha")
    for c in ("id", "given"):
        meets &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    # the window's limit is applied in each task before its shuffle, so no group meets in one task
    first = F.row_number().over(Window.partitionBy(*same).orderBy(F.xxhash64("row")))
    again = kept.join(marks, meets, "left_semi").withColumn("at", first).filter("at = 1")
    return kept.join(marks, meets, "left_anti").unionByName(again.drop("at")).select("row.*")
