"""Stateless scoring of streams by models fitted before: the batch operators apply unchanged to readStream frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import outliers


def score(stream: DataFrame, model: outliers.OutlierModel, limits: outliers.Acceptance) -> DataFrame:
    """Spectra of a stream with distances and acceptance; no state, so late or repeated rows change nothing else."""
    return outliers.accept(outliers.distances(stream, model), limits)


def band_totals(stream: DataFrame, delay: str = "10 minutes", every: str = "1 hour", ts: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and means by key and time window; rows later than delay are dropped by the watermark."""
    rows = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", delay)
    return rows.groupBy(F.window("__ts", every), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), key, "n", "mean")


def run_to_end(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything available now into the memory table `name`; for tests and small results."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def written(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Everything available now, written as Parquet to a folder that all executors share, and read back.

    The sink writes each batch once, whatever is repeated; the checkpoint says how far it came.
    """
    df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
