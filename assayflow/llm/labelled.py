"""Labelled documents for fitting, all or bounded samples, and which documents are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOLDS = 5
#: Bytes of the longest text that is learnt from, and of all such texts together.
LONGEST, MOST_BYTES = 1 << 20, 1 << 26


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; fold 0 is held out. A null id is in no fold."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)).cast("int")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def known(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, y, fold of the labelled ids outside fold 0; a label other than 0 counts as 1."""
    rows = labels.select(F.col("doc_id"), (F.col(label) != 0).cast("int").alias("y")).filter("doc_id is not null and y is not null")
    return rows.withColumn("fold", fold(F.col("doc_id"))).filter("fold <> 0")


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, by_label: bool = False) -> DataFrame:
    """text, y, fold of at most `most` labelled documents outside fold 0 (per label if by_label), by hash of the id.

    The ids are at most `most` per label, so their broadcast is bounded. Rows without an id, label or document are
    left out; a label other than 0 counts as 1. Ids labelled or stored more than once appear as often, so callers cut
    the rows to their bound again.
    """
    rows = known(labels, label).withColumn("order", F.xxhash64(F.col("doc_id"), F.lit(11)))
    if by_label:
        chosen = rows.filter("y = 1").orderBy("order", "doc_id").limit(most).unionByName(rows.filter("y = 0").orderBy("order", "doc_id").limit(most))
    else:
        chosen = rows.orderBy("order", "doc_id").limit(most)
    chosen = F.broadcast(chosen.withColumnRenamed("doc_id", "known_id"))
    return docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("known_id")).select("text", "y", "fold", "order")


def within(rows: DataFrame, most: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """At most `most` rows and `most_bytes` of text of a sample(), in its order; texts over LONGEST are not learnt from."""
    order = ["order", F.xxhash64("text")]
    few = rows.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST).orderBy(*order).limit(most)
    so_far = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # over `most` rows
    return few.withColumn("so_far", so_far).filter(F.col("so_far") <= most_bytes).drop("so_far")
