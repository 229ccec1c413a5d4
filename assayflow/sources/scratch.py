"""Scratch tables on storage that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; set here only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by the driver and the executors")
        folder = tempfile.mkdtemp(prefix="assayflow-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Tables written in the scopes that are open, innermost last.
_SCOPES: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Removes the tables that materialize() writes inside when it ends, but for those taken off the list it gives.

    For a caller that has written its result, or has all of it in a table that it keeps.
    """
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.remove(made)
        _remove(spark, made)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def discard(df: DataFrame) -> None:
    """Removes the table that materialize() wrote and gave as df, as soon as one that follows from it is written."""
    _remove(df.sparkSession, sorted({f.rpartition("/")[0] for f in df.inputFiles()}))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: cuts lineage and survives lost executors.

    Unlike checkpoint(), the copy is compressed, and what reads it has no inherited partitioning, so joins on it
    shuffle both sides and adaptive execution may split skewed keys.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
