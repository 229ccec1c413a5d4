"""Statistics of replicate groups: summaries, robust flags, p-value adjustment, figures of merit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, ratio
from ..functions.dist import t_quantile, t_two_sided
from . import ranks

CONFIDENCE = 0.95
MAD_LIMIT = 3.5
#: The normal-consistency factors of the median and of the mean absolute deviation.
MAD_FACTOR, MEAN_FACTOR = 1.4826, 1.2533


def summarize(df: DataFrame, by: list[str], value: str, with_ci: bool = True, confidence: float = CONFIDENCE) -> DataFrame:
    """n, mean, sd (n - 1), sem, rsd_percent and the half width of the mean's interval, over finite values only."""
    v = F.col(value).cast("double")
    out = df.filter(finite(v)).groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.nullif(F.stddev_samp(v), F.lit(float("nan"))).alias("sd"))
    out = out.withColumn("sem", F.col("sd") / F.sqrt("n")).withColumn("rsd_percent", ratio(100 * F.col("sd"), F.col("mean")))
    return out.withColumn("half_width", t_quantile(0.5 + confidence / 2, F.col("n") - 1) * F.col("sem")) if with_ci else out


def mad_flags(df: DataFrame, by: list[str], value: str, limit: float = MAD_LIMIT, large_groups: bool = False) -> DataFrame:
    """df with median, scale, z and flagged (z > limit). Medians are of finite values; others are never flagged.

    large_groups: medians by ranks over slices, for groups whose values no task should hold; the result is the same.
    Scale is 1.4826 x the median absolute deviation or, where that is 0, 1.2533 x the mean absolute deviation.
    """
    v = F.col(value).cast("double")
    good = F.when(finite(v), v)
    if large_groups:
        middle = ranks.quantiles(df.select(*by, good.alias("__good")), by, "__good", [0.5])
        centre = _join(df.groupBy(*by).agg(F.count(good).alias("n_finite")), middle.select(*by, F.col("q0").alias("median")), by, "left")
    else:
        centre = df.groupBy(*by).agg(F.percentile(good, 0.5).alias("median"), F.count(good).alias("n_finite"))
    rows = _join(df, centre, by)
    off = F.abs(good - F.col("median"))
    if large_groups:
        middle = ranks.quantiles(rows.select(*by, off.alias("__off")), by, "__off", [0.5])
        scale = _join(rows.groupBy(*by).agg(F.avg(off).alias("mean_off")), middle.select(*by, F.col("q0").alias("mad")), by, "left")
    else:
        scale = rows.groupBy(*by).agg(F.percentile(off, 0.5).alias("mad"), F.avg(off).alias("mean_off"))
    scale = scale.withColumn("scale", F.when(F.col("mad") > 0, MAD_FACTOR * F.col("mad")).otherwise(MEAN_FACTOR * F.col("mean_off"))).drop("mad", "mean_off")
    rows = _join(rows, scale, by).withColumn("z", ratio(off, F.col("scale")))
    return rows.withColumn("flagged", F.coalesce(F.col("z") > limit, F.lit(False))).withColumn("few", F.col("n_finite") < 5)


def _join(df: DataFrame, stats: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    return df.join(stats, by, how) if by else df.crossJoin(F.broadcast(stats))  # without keys stats is one row


def _adjust_one_family(df: DataFrame, p: str, method: str) -> DataFrame:
    """adjust_pvalues() over all rows as one family: steps and their running extremes slice by slice."""
    if method not in ("holm", "bh"):
        raise ValueError(f"unknown method {method!r}")
    m = df.agg(F.count(p)).first()[0]
    step = (m - F.col("__rank")) if method == "holm" else m / (F.col("__rank") + 1)
    rows = ranks.sliced(ranks.ranked(df, p, name="__rank").withColumn("__step", step * F.col(p)), p)
    extreme, way = (F.max, F.asc) if method == "holm" else (F.min, F.desc)  # a window up to its end costs a square
    inside = Window.partitionBy("__slice").orderBy(way("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    beyond = Window.partitionBy(F.lit(0)).orderBy(way("__of")).rowsBetween(Window.unboundedPreceding, -1)  # a row per slice
    slices = rows.groupBy(F.col("__slice").alias("__of")).agg(extreme("__step").alias("__own"))
    slices = slices.select("__of", extreme("__own").over(beyond).alias("__other"))
    both = F.greatest if method == "holm" else F.least
    out = rows.withColumn("__run", extreme("__step").over(inside)).join(F.broadcast(slices), F.col("__slice").eqNullSafe(F.col("__of")))
    return out.withColumn("p_adjusted", F.least(F.lit(1.0), both("__run", "__other"))).select(*df.columns, "p_adjusted")


def adjust_pvalues(df: DataFrame, p: str, method: str, by: list[str] | None = None) -> DataFrame:
    """df with p_adjusted by bonferroni, holm or bh, within each family of `by` or over all rows as one."""
    if not by and method != "bonferroni":
        return _adjust_one_family(df, p, method)
    family = Window.partitionBy(*(by or [F.lit(0)]))
    ordered = family.orderBy(p)
    m = F.count(p).over(family)
    rank = F.row_number().over(ordered)
    if method == "bonferroni" and not by:
        return df.crossJoin(F.broadcast(df.agg(F.count(p).alias("__m")))).withColumn("p_adjusted", F.least(F.lit(1.0), F.col("__m") * F.col(p))).drop("__m")
    if method == "bonferroni":
        adjusted = m * F.col(p)
    elif method == "holm":
        df = df.withColumn("__step", (m - rank + 1) * F.col(p))
        adjusted = F.max("__step").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    elif method == "bh":
        df = df.withColumns({"__rank": rank, "__step": m * F.col(p) / rank})
        adjusted = F.min("__step").over(family.orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0))
    else:
        raise ValueError(f"unknown method {method!r}")
    return df.withColumn("p_adjusted", F.least(F.lit(1.0), adjusted)).drop("__step", "__rank")


def multiplicity(df: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """One row: hits before and after each adjustment, and a warning where adjusting loses some."""
    out = df
    for method in ("bonferroni", "holm", "bh"):
        out = adjust_pvalues(out, p, method).withColumnRenamed("p_adjusted", method)
    hits = out.agg(F.count_if(F.col(p) <= alpha).alias("raw_hits"), *[F.count_if(F.col(x) <= alpha).alias(f"{x}_hits") for x in ("bonferroni", "holm", "bh")])
    return hits.withColumn("severity", F.when(F.col("raw_hits") > F.col("bh_hits"), "WARN").otherwise("INFO"))


def spread_ratios(df: DataFrame, by: list[str], y: str, rmse: Column) -> DataFrame:
    """rpd = sd / rmse and rpiq = (q3 - q1) / rmse; infinite where rmse is not above zero, null where it is null."""
    v, e = F.col(y).cast("double"), rmse.cast("double")
    stats = df.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_samp(v).alias("sd"), F.percentile(v, 0.25).alias("q1"), F.percentile(v, 0.75).alias("q3"), F.max(e).alias("rmse"))
    over = lambda c: F.when(F.col("rmse") > 0, ratio(c, F.col("rmse"))).when(F.col("rmse").isNotNull() & c.isNotNull(), float("inf"))
    return stats.withColumn("rpd", over(F.col("sd"))).withColumn("rpiq", over(F.col("q3") - F.col("q1")))


def fit_stats(df: DataFrame, by: list[str], y: str, predicted: str) -> DataFrame:
    """n, r2 (null where y doesn't vary) and rmse (over n) of predictions; rows without either value are left out."""
    v, e = F.col(y).cast("double"), F.col(predicted).cast("double") - F.col(y).cast("double")
    out = df.filter(F.col(y).isNotNull() & F.col(predicted).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.sum(e * e).alias("__ss"), (F.var_pop(v) * F.count("*")).alias("__st"))
    return out.select(*by, "n", (1 - ratio(F.col("__ss"), F.when(F.col("__st") > 0, F.col("__st")))).alias("r2"), F.sqrt(F.col("__ss") / F.col("n")).alias("rmse"))


def class_merit(df: DataFrame, truth: Column, predicted: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fn, tn, fp, sensitivity, specificity, efficiency; null where undefined."""
    both = df.withColumns({"__t": truth, "__p": predicted})
    n = lambda t, p: F.count_if((F.col("__t") == F.lit(t)) & (F.col("__p") == F.lit(p)))
    out = both.groupBy(*(by or [])).agg(n(True, True).alias("tp"), n(True, False).alias("fn"), n(False, False).alias("tn"), n(False, True).alias("fp"))
    out = out.withColumn("sensitivity", ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("specificity", ratio(F.col("tn"), F.col("tn") + F.col("fp")))
    return out.withColumn("efficiency", F.sqrt(F.col("sensitivity") * F.col("specificity")))


def corrected_paired_t(df: DataFrame, a: str, b: str, n_train: int, n_test: int, by: list[str] | None = None) -> DataFrame:
    """Paired t over folds whose variance is widened for overlapping training sets; se 0 gives t 0 or infinity."""
    d = F.col(a).cast("double") - F.col(b).cast("double")
    out = df.groupBy(*(by or [])).agg(F.count(d).alias("k"), F.avg(d).alias("mean_difference"), F.var_samp(d).alias("variance"))
    se = F.sqrt(F.col("variance") * (1 / F.col("k") + n_test / n_train))
    out = out.withColumn("se", se)
    sure = F.when(F.col("mean_difference") == 0, 0.0).otherwise(F.signum("mean_difference") * float("inf"))
    out = out.withColumn("t", F.when(F.col("se") == 0, sure).otherwise(ratio(F.col("mean_difference"), F.col("se"))))
    return out.withColumn("p", F.when(F.col("se") == 0, F.when(F.col("mean_difference") == 0, 1.0).otherwise(0.0)).otherwise(t_two_sided(F.col("t"), F.col("k") - 1)))


def weighted_residual(df: DataFrame, by: list[str], observed: str, calculated: str, weight: str = "auto", floor: float = 1e-6) -> DataFrame:
    """Rwp = sqrt(sum w (o - c)^2 / sum w o^2). weight: unit, poisson (1 / max(o, floor)), or auto.

    auto takes poisson where the smallest observation exceeds a thousandth of the largest, else unit.
    """
    o, c = F.col(observed).cast("double"), F.col(calculated).cast("double")
    sums = lambda w, tag: [F.sum(w * (o - c) * (o - c)).alias(f"num_{tag}"), F.sum(w * o * o).alias(f"den_{tag}")]
    out = df.groupBy(*by).agg(F.min(o).alias("least"), F.max(o).alias("most"), *sums(F.lit(1.0), "unit"), *sums(1 / F.greatest(o, F.lit(floor)), "poisson"))
    chosen = F.when(F.col("least") > 1e-3 * F.col("most"), "poisson").otherwise("unit") if weight == "auto" else F.lit(weight)
    out = out.withColumn("weight", chosen)
    pick = lambda k: F.when(F.col("weight") == "poisson", F.col(f"{k}_poisson")).otherwise(F.col(f"{k}_unit"))
    return out.select(*by, "weight", F.sqrt(ratio(pick("num"), F.when(pick("den") > 0, pick("den")))).alias("rwp"))
