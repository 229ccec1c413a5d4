"""The driver's tables in the roles that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison with other engines; minus zero becomes zero."""
    return df.select(*[(F.round(F.col(c), digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, spectrum (64 channels), y, grp from embeddings."""
    return as_spectra(table(spark, sf_dir, "embeddings"))


def as_spectra(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("vec_id").alias("sample"), F.col("embedding").cast("array<double>").alias("spectrum"), F.col("label").cast("double").alias("y"), F.col("label").cast("int").alias("grp"))


def traces(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """trace, x (hours since the start of 2024), y, step (tie-break) and any more columns from events."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("trace"), (seconds / 3.6e9).alias("x"), F.col("value").alias("y"), F.col("event_id").alias("step"), *more)


#: The same roles in SQL.
SPECTRA_SQL = "SELECT vec_id AS sample, CAST(embedding AS DOUBLE[]) AS spectrum, CAST(label AS DOUBLE) AS y, CAST(label AS INT) AS grp FROM embeddings"
TRACES_SQL = "SELECT user_id AS trace, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9 AS x, value AS y, event_id AS step FROM events"
CHANNELS_SQL = "SELECT sample, y, grp, k - 1 AS pos, spectrum[k] AS v FROM sp, unnest(range(1, 65)) AS u(k)"


def principal_sql(train: str = "true", components: int = 2) -> str:
    """CTEs over sp and ch: ev (component, eigenvalue, total), ax (component, pos, u), sc (each sample's t_1.., t2, q, leverage).

    The covariance of the rows that `train` selects is squared 14 times and scaled by its trace, which leaves its first
    axis; taken off, the next follows. The largest weight of an axis is positive.
    """
    parts = [f"tn AS (SELECT count(*) AS n FROM sp WHERE {train})", f"cm AS (SELECT pos, avg(v) AS m FROM ch WHERE {train} GROUP BY pos)",
             "cz AS MATERIALIZED (SELECT ch.sample, ch.y, ch.grp, pos, v - m AS v FROM ch JOIN cm USING (pos))",
             f"c1 AS MATERIALIZED (SELECT a.pos AS i, b.pos AS j, sum(a.v * b.v) / (SELECT n - 1 FROM tn) AS v FROM (SELECT * FROM cz WHERE {train}) a JOIN cz b USING (sample) GROUP BY ALL)"]
    for k in range(1, components + 1):
        parts.append(f"s{k}_0 AS (SELECT i, j, v / sum(v) FILTER (i = j) OVER () AS v FROM c{k})")
        for m in range(14):
            parts.append(f"s{k}_{m + 1} AS MATERIALIZED (SELECT i, j, v / sum(v) FILTER (i = j) OVER () AS v FROM (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM s{k}_{m} a JOIN s{k}_{m} b ON a.j = b.i GROUP BY ALL))")
        parts.append(f"w{k} AS (SELECT i, v / sqrt(sum(v * v) OVER ()) AS u FROM s{k}_14 WHERE j = (SELECT arg_max(i, v) FROM s{k}_14 WHERE i = j))")
        parts.append(f"u{k} AS MATERIALIZED (SELECT i, u * (SELECT sign(arg_max(u, abs(u))) FROM w{k}) AS u FROM w{k})")
        parts.append(f"e{k} AS MATERIALIZED (SELECT sum(c.v * a.u * b.u) AS e FROM c{k} c JOIN u{k} a ON a.i = c.i JOIN u{k} b ON b.i = c.j)")
        parts.append(f"c{k + 1} AS MATERIALIZED (SELECT c.i, c.j, c.v - (SELECT e FROM e{k}) * a.u * b.u AS v FROM c{k} c JOIN u{k} a ON a.i = c.i JOIN u{k} b ON b.i = c.j)")
    every = range(1, components + 1)
    parts.append("ev AS (" + " UNION ALL ".join(f"SELECT {k} AS component, e AS eigenvalue, (SELECT sum(v) FROM c1 WHERE i = j) AS total FROM e{k}" for k in every) + ")")
    parts.append("ax AS (" + " UNION ALL ".join(f"SELECT {k} AS component, i AS pos, u FROM u{k}" for k in every) + ")")
    joins = " ".join(f"JOIN u{k} ON u{k}.i = cz.pos" for k in every)
    parts.append(f"st AS (SELECT sample, y, grp, sum(v * v) AS norm, {', '.join(f'sum(v * u{k}.u) AS t_{k}' for k in every)} FROM cz {joins} GROUP BY ALL)")
    t2 = " + ".join(f"t_{k} * t_{k} / (SELECT e FROM e{k})" for k in every)
    parts.append(f"sc AS MATERIALIZED (SELECT *, {t2} AS t2, greatest(norm - {' - '.join(f't_{k} * t_{k}' for k in every)}, 0) AS q, ({t2}) / ((SELECT n FROM tn) - 1) AS leverage FROM st)")
    return ",\n".join(parts)
