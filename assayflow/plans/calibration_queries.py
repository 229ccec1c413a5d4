"""Calibration and statistics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dist
from ..operators import calibration, stats
from .adapters import rounded, table
from .catalogue import register

_FIT_COLUMNS = ["n", "slope", "intercept", "r2", "s_resid", "se_slope", "se_intercept", "lod", "loq"]


def documents_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1).alias("x"), F.col("n_chars").alias("y"))


_DOCUMENTS = "SELECT lang, length(text) - length(replace(text, ' ', '')) + 1 AS x, n_chars AS y FROM documents"


def _fit_sql(rows: str, key: str) -> str:
    return f"""
    WITH r AS ({rows}), g AS (
      SELECT {key}, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx, min(x) AS x_low, max(x) AS x_high,
             regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM r GROUP BY {key}
    ), e AS (SELECT *, CASE WHEN syy - sxy * sxy / nullif(sxx, 0) > 1e-12 * syy THEN syy - sxy * sxy / nullif(sxx, 0) ELSE 0 END AS sse FROM g),
    m AS (SELECT *, CASE WHEN n > 2 THEN sqrt(sse / (n - 2)) END AS s, 1 - sse / nullif(syy, 0) AS r2 FROM e)
    """


_FIT_OUT = """n, round(b, 6) + 0.0 AS slope, round(a, 6) + 0.0 AS intercept, round(r2, 6) + 0.0 AS r2, round(s, 6) + 0.0 AS s_resid, round(s / nullif(sqrt(sxx), 0), 6) + 0.0 AS se_slope,
    round(s * sqrt(1.0 / n + mx * mx / nullif(sxx, 0)), 6) + 0.0 AS se_intercept, round(3.3 * s / nullif(abs(b), 0), 6) + 0.0 AS lod, round(10 * s / nullif(abs(b), 0), 6) + 0.0 AS loq"""


def _fitted(rows: DataFrame, key: str) -> DataFrame:
    return rounded(calibration.with_limits(calibration.fit(rows, [key], "x", "y")).select(key, *_FIT_COLUMNS))


@register(_fit_sql(_DOCUMENTS, "lang") + f"SELECT lang, {_FIT_OUT} FROM m")
def calibration_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(documents_by_lang(spark, sf_dir), "lang")


@register(_fit_sql("SELECT l_returnflag, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem", "l_returnflag") + f"SELECT l_returnflag, {_FIT_OUT} FROM m")
def calibration_fit_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return _fitted(rows, "l_returnflag")


@register(_fit_sql("SELECT lang, length(text) AS x, n_chars AS y FROM documents", "lang") + f"SELECT lang, {_FIT_OUT} FROM m")
def calibration_fit_degenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(table(spark, sf_dir, "documents").select("lang", F.length("text").alias("x"), F.col("n_chars").alias("y")), "lang")


@register(
    _fit_sql(_DOCUMENTS, "lang")
    + """, b AS (SELECT *, k, x_low + k * (x_high - x_low) / 199.0 AS x FROM m, generate_series(0, 199) AS q(k))
    SELECT lang, CAST(k AS INT) AS k, round(x, 6) AS x, round(b * x + a, 6) AS y, round(s * sqrt(1.0 / n + (x - mx) * (x - mx) / sxx), 6) AS se_mean,
           round(s * sqrt(1 + 1.0 / n + (x - mx) * (x - mx) / sxx), 6) AS se_new FROM b"""
)
def calibration_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.bands(calibration.fit(documents_by_lang(spark, sf_dir), ["lang"], "x", "y"), ["lang"]))


_PARTS = "SELECT p_partkey, p_brand, p_size AS x, p_retailprice AS y FROM part"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"))


@register(_fit_sql(_PARTS, "p_brand") + "SELECT p_brand, n, round(a, 6) AS intercept, round(a / (s * sqrt(1.0 / n + mx * mx / sxx)), 6) AS t FROM m")
def calibration_intercept_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.intercept_test(calibration.fit(parts(spark, sf_dir), ["p_brand"], "x", "y")).select("p_brand", "n", "intercept", "t"))


#: Student's quantile at 0.975: a list up to 60 degrees of freedom, beyond that the expansion in their inverse.
_T975 = f"""CASE WHEN {{0}} <= 60 THEN [{', '.join(repr(dist.t_ppf(0.975, k)) + '::DOUBLE' for k in range(1, 61))}][CAST({{0}} AS INT)]
  ELSE {' + '.join(f'{c!r}::DOUBLE / ({{0}}) ** {k}' for k, c in enumerate(dist.t_expansion(dist.norm_ppf(0.975))))} END"""


@register(
    _fit_sql(_PARTS, "p_brand")
    + f""", t AS (SELECT *, {_T975.format('(n - 2)')} AS t, s / sqrt(sxx) AS sb, s * sqrt(1.0 / n + mx * mx / sxx) AS sa FROM m)
    SELECT p_brand, round(b - t * sb, 6) AS slope_low, round(b + t * sb, 6) AS slope_high, round(a - t * sa, 5) AS intercept_low, round(a + t * sa, 5) AS intercept_high, a - t * sa > 0 OR a + t * sa < 0 AS significant FROM t"""
)
def calibration_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = calibration.intercept_test(calibration.fit(parts(spark, sf_dir), ["p_brand"], "x", "y"))
    return rounded(found.select("p_brand", "slope_low", "slope_high", F.round("intercept_low", 5).alias("intercept_low"), F.round("intercept_high", 5).alias("intercept_high"), "significant"))


@register(
    _fit_sql(_DOCUMENTS, "lang")
    + """, s AS (SELECT page_id, length(html) AS signal, regexp_extract(url, '/(en|de|fr|es)/', 1) AS lang FROM pages), v AS (SELECT page_id, s.lang, signal, (signal - a) / b AS v, x_low, x_high FROM s JOIN m ON s.lang = m.lang)
    SELECT page_id, lang, signal, CASE WHEN v BETWEEN x_low AND x_high THEN 'OK' ELSE 'REFUSED' END AS status, CASE WHEN v BETWEEN x_low AND x_high THEN round(v, 6) END AS x_predicted FROM v"""
)
def calibration_inverse_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = calibration.fit(documents_by_lang(spark, sf_dir), ["lang"], "x", "y")
    signals = table(spark, sf_dir, "pages").select("page_id", F.length("html").cast("long").alias("signal"), F.regexp_extract("url", "/(en|de|fr|es)/", 1).alias("lang"))
    return rounded(calibration.inverse(signals, models, ["lang"], "signal"))


@register(_fit_sql(_PARTS, "p_brand") + "SELECT r.p_partkey, r.p_brand, round(b * x + a, 6) AS fitted, round(y - (b * x + a), 6) + 0.0 AS residual FROM r JOIN m USING (p_brand)")
def calibration_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir)
    models = calibration.fit(rows, ["p_brand"], "x", "y")
    return rounded(calibration.residuals(rows, models, ["p_brand"], "x", "y").select("p_partkey", "p_brand", "fitted", "residual"))


@register("""
WITH v AS (SELECT 's' || s_nationkey AS grp, s_acctbal AS v FROM supplier UNION ALL SELECT o_orderpriority, o_totalprice FROM orders)
SELECT grp, count(*) AS n, round(avg(v), 6) AS mean, CASE WHEN count(*) > 1 THEN round(stddev_samp(v), 6) END AS sd,
       CASE WHEN count(*) > 1 THEN round(stddev_samp(v) / sqrt(count(*)), 6) END AS sem, CASE WHEN count(*) > 1 THEN round(100 * stddev_samp(v) / nullif(avg(v), 0), 6) END AS rsd_percent
FROM v GROUP BY grp""")
def summarize_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.summarize(_replicates(spark, sf_dir), ["grp"], "v", with_ci=False))


def _replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_nationkey")).alias("grp"), F.col("s_acctbal").alias("v"))
    return suppliers.unionByName(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("v")))


@register(f"""
WITH v AS (SELECT 's' || s_nationkey AS grp, s_acctbal AS v FROM supplier UNION ALL SELECT o_orderpriority, o_totalprice FROM orders), g AS (SELECT grp, count(*) AS n, stddev_samp(v) AS sd FROM v GROUP BY grp)
SELECT grp, n, CASE WHEN n > 1 THEN round({_T975.format('(n - 1)')} * sd / sqrt(n), 4) END AS half_width FROM g""")
def summarize_half_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.summarize(_replicates(spark, sf_dir), ["grp"], "v").select("grp", "n", F.round("half_width", 4).alias("half_width")))


@register("""
WITH c AS (SELECT *, median(s_acctbal) OVER (PARTITION BY s_nationkey) AS med, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
o AS (SELECT *, abs(s_acctbal - med) AS off FROM c),
s AS (SELECT *, median(off) OVER (PARTITION BY s_nationkey) AS mad, avg(off) OVER (PARTITION BY s_nationkey) AS mo FROM o),
z AS (SELECT *, off / nullif(CASE WHEN mad > 0 THEN 1.4826 * mad ELSE 1.2533 * mo END, 0) AS z FROM s)
SELECT s_suppkey, s_nationkey, round(med, 6) AS median, round(z, 6) AS z, coalesce(z > 3.5, false) AS flagged, n < 5 AS few FROM z""")
def mad_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return rounded(stats.mad_flags(rows, ["s_nationkey"], "s_acctbal").select("s_suppkey", "s_nationkey", "median", "z", "flagged", "few"))


_BRANDS = "SELECT row_number() OVER (ORDER BY p_brand) AS id, CAST(p_brand AS VARCHAR) AS p_brand, abs(regr_r2(p_retailprice, p_size)) AS p FROM part GROUP BY p_brand"


def _brand_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.abs(F.regr_r2("p_retailprice", "p_size")).alias("p"))


def _adjusted(method: str, step: str, frame: str) -> None:
    sql = f"WITH b AS ({_BRANDS}), r AS (SELECT p_brand, p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM b), s AS (SELECT *, {step} AS v FROM r) SELECT p_brand, round(p, 6) AS p, round(least(1.0, {frame}), 6) AS p_adjusted FROM s"

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(stats.adjust_pvalues(_brand_scores(spark, sf_dir), "p", method).select("p_brand", "p", "p_adjusted"))

    register(sql, f"pvalues_{method}")(query)


_adjusted("bonferroni", "m * p", "v")
_adjusted("holm", "(m - k + 1) * p", "max(v) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING)")
_adjusted("bh", "m * p / k", "min(v) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")


@register(f"""
WITH b AS ({_BRANDS}), r AS (SELECT p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM b),
s AS (SELECT p, least(1, m * p) AS bonf, least(1, max((m - k + 1) * p) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING)) AS holm,
      least(1, min(m * p / k) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS bh FROM r)
SELECT count(*) FILTER (p <= .05) AS raw_hits, count(*) FILTER (bonf <= .05) AS bonferroni_hits, count(*) FILTER (holm <= .05) AS holm_hits, count(*) FILTER (bh <= .05) AS bh_hits,
       CASE WHEN count(*) FILTER (p <= .05) > count(*) FILTER (bh <= .05) THEN 'WARN' ELSE 'INFO' END AS severity FROM s""")
def multiplicity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.multiplicity(_brand_scores(spark, sf_dir), "p")


@register("""
SELECT p_brand, count(*) AS n, round(stddev_samp(p_retailprice), 6) AS sd, round(stddev_samp(p_retailprice) / 10, 6) AS rpd,
       round((quantile_cont(p_retailprice, .75) - quantile_cont(p_retailprice, .25)) / 10, 6) AS rpiq FROM part GROUP BY p_brand""")
def rpd_rpiq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.spread_ratios(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", F.lit(10.0)).select("p_brand", "n", "sd", "rpd", "rpiq"))


@register("""
WITH r AS (SELECT l_returnflag, l_extendedprice AS y, 1500 * l_quantity AS f FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(1 - sum((f - y) ** 2) / (count(*) * var_pop(y)), 6) AS r2, round(sqrt(avg((f - y) ** 2)), 4) AS rmse FROM r GROUP BY 1""")
def prediction_fit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("f", 1500 * F.col("l_quantity"))
    return rounded(stats.fit_stats(rows, ["l_returnflag"], "l_extendedprice", "f").withColumn("rmse", F.round("rmse", 4)))


@register("""
WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 1 AND toxic <> 0) AS fn, count(*) FILTER (quality <> 1 AND toxic <> 0) AS tn, count(*) FILTER (quality <> 1 AND toxic = 0) AS fp FROM labels)
SELECT *, round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(sqrt(tp / nullif(tp + fn, 0) * tn / nullif(tn + fp, 0)), 6) AS efficiency FROM c""")
def class_fom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.class_merit(table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 0))


@register("""
WITH f AS (SELECT l_returnflag, l_linenumber, avg(l_discount) AS a, avg(l_tax) AS b FROM lineitem GROUP BY ALL), g AS (SELECT l_returnflag, count(*) AS k, avg(a - b) AS mean_difference, sqrt(var_samp(a - b) * (1.0 / count(*) + 10 / 90.0)) AS se FROM f GROUP BY 1)
SELECT l_returnflag, k, round(mean_difference, 6) AS mean_difference, round(se, 6) AS se, round(mean_difference / se, 4) AS t FROM g""")
def corrected_paired_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"))
    out = stats.corrected_paired_t(folds, "a", "b", 90, 10, ["l_returnflag"]).select("l_returnflag", "k", "mean_difference", "se", F.round("t", 4).alias("t"))
    return rounded(out)


@register("""
WITH o AS (SELECT l_shipmode, o, c FROM (SELECT l_linenumber AS l_shipmode, l_quantity AS o, 50 * l_discount * 10 AS c FROM lineitem)),
s AS (SELECT l_shipmode AS line, min(o) > 1e-3 * max(o) AS poisson, sum((o - c) ** 2) AS nu, sum(o * o) AS du, sum((o - c) ** 2 / greatest(o, 1e-6)) AS np, sum(o * o / greatest(o, 1e-6)) AS dp FROM o GROUP BY 1)
SELECT line, CASE WHEN poisson THEN 'poisson' ELSE 'unit' END AS weight, round(sqrt(CASE WHEN poisson THEN np / nullif(dp, 0) ELSE nu / nullif(du, 0) END), 6) AS rwp FROM s""")
def rwp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("o"), (50 * F.col("l_discount") * 10).alias("c"))
    return rounded(stats.weighted_residual(rows, ["line"], "o", "c"))
