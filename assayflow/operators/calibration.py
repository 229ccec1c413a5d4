"""Straight-line calibration: one model per group in one aggregation, with inference, limits and guarded inversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..functions.dist import t_quantile, t_two_sided

LOD_FACTOR, LOQ_FACTOR = 3.3, 10.0
#: Residual variance below this share of the total is rounding; such a fit counts as exact.
EXACT = 1e-12


def fit(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """n, slope, intercept, r2, s_resid, se_slope, se_intercept, x_mean, sxx, x_low, x_high per group.

    Rows with a null x or y are left out. r2 is null where y doesn't vary, all errors are null below three points.
    """
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.select(*by, xs.alias("x"), ys.alias("y")).filter("x is not null and y is not null")
    g = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.avg("x").alias("x_mean"), F.min("x").alias("x_low"), F.max("x").alias("x_high"),
        F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"),
    )
    sse = F.col("syy") - ratio(F.col("sxy") * F.col("sxy"), F.col("sxx"))
    g = g.withColumn("sse", F.when(sse > EXACT * F.col("syy"), sse).otherwise(F.when(sse.isNotNull(), 0.0)))
    g = g.withColumn("r2", 1 - ratio(F.col("sse"), F.col("syy"))).withColumn("s_resid", F.sqrt(ratio(F.col("sse"), F.when(F.col("n") > 2, F.col("n") - 2))))
    g = g.withColumn("se_slope", ratio(F.col("s_resid"), F.sqrt("sxx"))).withColumn("se_intercept", F.col("s_resid") * F.sqrt(1 / F.col("n") + ratio(F.col("x_mean") * F.col("x_mean"), F.col("sxx"))))
    return g.drop("syy", "sxy")


def refined(df: DataFrame, models: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """fit()'s models with their errors from residuals summed in a second pass, exact where a line is nearly perfect."""
    sums = residuals(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), models, by, x, y).groupBy(*by).agg(F.sum(F.col("residual") * F.col("residual")).alias("__sse"), (F.var_pop(F.col(y).cast("double")) * F.count("*")).alias("__total"))
    old = F.col("sse")
    m = models.join(sums, by, "left").withColumn("sse", F.when(old.isNotNull(), F.col("__sse"))).withColumn("r2", 1 - ratio(F.col("sse"), F.col("__total"))).withColumn("s_resid", F.sqrt(ratio(F.col("sse"), F.when(F.col("n") > 2, F.col("n") - 2))))
    m = m.withColumn("se_slope", ratio(F.col("s_resid"), F.sqrt("sxx"))).withColumn("se_intercept", F.col("s_resid") * F.sqrt(1 / F.col("n") + ratio(F.col("x_mean") * F.col("x_mean"), F.col("sxx"))))
    return m.select(*models.columns)


def with_limits(models: DataFrame, blank_sd: Column | None = None) -> DataFrame:
    """lod = 3.3 s / |slope| and loq = 10 s / |slope|, s the residual deviation or that of blanks."""
    s = F.col("s_resid") if blank_sd is None else blank_sd
    return models.withColumn("lod", ratio(LOD_FACTOR * s, F.abs("slope"))).withColumn("loq", ratio(LOQ_FACTOR * s, F.abs("slope")))


def with_intervals(models: DataFrame, confidence: float = 0.95) -> DataFrame:
    t = models.withColumn("t_crit", t_quantile(0.5 + confidence / 2, F.col("n") - 2))
    for name in ("slope", "intercept"):
        half = F.col("t_crit") * F.col(f"se_{name}")
        t = t.withColumn(f"{name}_low", F.col(name) - half).withColumn(f"{name}_high", F.col(name) + half)
    return t


def intercept_test(models: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Whether the line misses the origin: t, p, significant (the interval excludes 0)."""
    m = with_intervals(models, confidence).withColumn("t", ratio(F.col("intercept"), F.col("se_intercept")))
    return m.withColumn("p", t_two_sided(F.col("t"), F.col("n") - 2)).withColumn("significant", (F.col("intercept_low") > 0) | (F.col("intercept_high") < 0))


def residuals(df: DataFrame, models: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    rows = df.join(models.select(*by, "slope", "intercept"), by)
    fitted = F.col("slope") * F.col(x).cast("double") + F.col("intercept")
    return rows.withColumn("fitted", fitted).withColumn("residual", F.col(y).cast("double") - F.col("fitted")).drop("slope", "intercept")


def inverse(signals: DataFrame, models: DataFrame, by: list[str], signal: str) -> DataFrame:
    """x for each signal by its group's line. Outside the calibrated range status is REFUSED and x null."""
    rows = signals.join(models.select(*by, "slope", "intercept", "x_low", "x_high"), by)
    value = ratio(F.col(signal).cast("double") - F.col("intercept"), F.col("slope"))
    inside = value.between(F.col("x_low"), F.col("x_high"))
    return rows.withColumn("status", F.when(inside, "OK").otherwise("REFUSED")).withColumn("x_predicted", F.when(inside, value)).drop("slope", "intercept", "x_low", "x_high")


def bands(models: DataFrame, by: list[str], points: int = 200) -> DataFrame:
    """The line on an even grid over each model's range, with the standard errors of the mean and of a new value."""
    grid = models.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    grid = grid.withColumn("x", F.col("x_low") + F.col("k") * (F.col("x_high") - F.col("x_low")) / (points - 1))
    lever = 1 / F.col("n") + ratio((F.col("x") - F.col("x_mean")) * (F.col("x") - F.col("x_mean")), F.col("sxx"))
    return grid.select(*by, "k", "x", (F.col("slope") * F.col("x") + F.col("intercept")).alias("y"), (F.col("s_resid") * F.sqrt(lever)).alias("se_mean"), (F.col("s_resid") * F.sqrt(1 + lever)).alias("se_new"))
