"""Run orders: levels by repeats, operators dealt in turn, shuffled the same way everywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def schedule(spark: SparkSession, levels: list[float], reps: int, operators: list[str], instruments: list[str]) -> DataFrame:
    """level, rep, operator, instrument in standard order (place): operator and instrument follow (repeat + level) in turn."""
    base = spark.createDataFrame([(i, float(v)) for i, v in enumerate(levels)], "i int, level double").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    turn = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), F.pmod(F.col("rep") + F.col("i"), F.lit(len(names))) + 1)
    return base.select((F.col("rep") * len(levels) + F.col("i")).alias("place"), "level", (F.col("rep") + 1).alias("rep"), turn(operators).alias("operator"), turn(instruments).alias("instrument"))


def run_order(spark: SparkSession, plan: DataFrame, n: int, seed: int) -> DataFrame:
    """plan with run 1..n by a seeded permutation of its places, independent of partitioning."""
    order = np.random.default_rng(seed).permutation(n)
    runs = spark.createDataFrame([(int(p), k + 1) for k, p in enumerate(order)], "place int, run int")
    return plan.join(F.broadcast(runs), "place").drop("place")


def balance(plan: DataFrame) -> DataFrame:
    return plan.groupBy("operator", "level").agg(F.count("*").alias("n"))
