"""Queries on traces (events by user) and spectra (embeddings)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import savgol
from ..functions.columns import dot
from ..functions.columns import transmittance as to_transmittance
from ..operators import baseline, calibration, preprocess, stats, traces
from .adapters import CHANNELS_SQL, SPECTRA_SQL, TRACES_SQL, rounded, spectra, table
from .adapters import traces as trace_table
from .catalogue import register

_T = f"WITH t AS ({TRACES_SQL})"
_S = f"WITH sp AS ({SPECTRA_SQL}), ch AS ({CHANNELS_SQL})"


@register(_T + """, d AS (SELECT trace, x, y, x - lag(x) OVER (PARTITION BY trace ORDER BY step) AS dx FROM t),
g AS (SELECT trace, count(*) AS n, bool_and(isfinite(x) AND isfinite(y)) AS all_finite, coalesce(bool_and(dx > 0), true) OR coalesce(bool_and(dx < 0), true) AS monotonic FROM d GROUP BY trace),
c AS (SELECT *, CASE WHEN n < 8 THEN 'too_few_points' WHEN NOT all_finite THEN 'not_finite' WHEN NOT monotonic THEN 'not_monotonic' ELSE 'ok' END AS code FROM g)
SELECT *, CASE WHEN code = 'ok' THEN 'INFO' ELSE 'FAIL' END AS severity FROM c""")
def trace_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.gate(trace_table(spark, sf_dir), order="step")


_RING_SQL = ", ".join(f"{'lag' if k < 0 else 'lead'}(y, {abs(k)}) OVER w" for k in traces.RING)


@register(_T + f""", r AS (SELECT trace, x, y, [{_RING_SQL}] AS ring, lag(y) OVER w AS b, lead(y) OVER w AS a, max(y) OVER v - min(y) OVER v AS ptp FROM t WINDOW w AS (PARTITION BY trace ORDER BY x), v AS (PARTITION BY trace)),
q AS (SELECT *, list_sort(ring) AS s FROM r WHERE len(list_filter(ring, lambda v: v IS NULL)) = 0), m AS (SELECT *, (s[3] + s[4]) / 2 AS base FROM q),
o AS (SELECT *, list_sort([abs(v - base) FOR v IN ring]) AS dev, y - base AS up FROM m), z AS (SELECT *, 1.4826 * (dev[3] + dev[4]) / 2 + 1e-12 AS noise FROM o),
f AS (SELECT *, CASE WHEN up > .1 * ptp AND up > 8 * noise AND greatest(a, b) - base < .25 * up THEN 'up' WHEN -up > .1 * ptp AND -up > 8 * noise AND base - least(a, b) < .25 * -up THEN 'down' END AS direction FROM z)
SELECT trace, round(x, 6) AS x, round(y, 6) AS y, round(base, 6) AS base, direction FROM f WHERE direction IS NOT NULL""")
def trace_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(traces.spikes(trace_table(spark, sf_dir)))


@register(_T + " SELECT trace, step, round(coalesce(y / nullif(max(abs(y)) OVER (PARTITION BY trace), 0), y), 6) AS y_norm FROM t")
def trace_normalize_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(traces.normalize(trace_table(spark, sf_dir), "max").select("trace", "step", "y_norm"))


@register(_T + """, p AS (SELECT *, (x - lag(x) OVER w) * (abs(y) + abs(lag(y) OVER w)) / 2 AS part FROM t WINDOW w AS (PARTITION BY trace ORDER BY x))
SELECT trace, step, round(coalesce(y / nullif(abs(sum(part) OVER (PARTITION BY trace)), 0), y), 9) AS y_norm FROM p""")
def trace_normalize_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(traces.normalize(trace_table(spark, sf_dir), "area").select("trace", "step", "y_norm"), 9)


@register(f"WITH sp AS ({SPECTRA_SQL}) SELECT sample, k - 1 AS pos, round(100 * pow(10, -spectrum[k]), 6) AS t FROM sp, unnest(range(1, 65)) AS u(k)")
def transmittance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spectra(spark, sf_dir).select("sample", F.posexplode("spectrum").alias("pos", "v"))
    return rounded(rows.select("sample", F.col("pos").cast("long").alias("pos"), to_transmittance(F.col("v")).alias("t")))


_BANDS = [(100.0, 300.0, "early"), (250.0, 500.0, "middle"), (640.0, 600.0, "late"), (1e6, 2e6, "beyond")]


def _band_sql(shared: bool) -> str:
    rows = ", ".join(f"({min(a, b)}, {max(a, b)}, '{n}')" for a, b, n in _BANDS)
    ends = "SELECT band, lo, hi, min(lo) OVER () AS l, max(hi) OVER () AS r FROM b0" if shared else "SELECT band, lo, hi, lo AS l, hi AS r FROM b0"
    anchor = lambda e: f"coalesce((SELECT avg(y) FROM t q WHERE q.trace = k.trace AND abs(q.x - k.{e}) <= 2), (SELECT arg_min(y, [abs(x - k.{e}), x]) FROM t q WHERE q.trace = k.trace))"
    return _T + f""", b0 AS (SELECT * FROM (VALUES {rows}) AS v(lo, hi, band)), b AS ({ends}),
    k AS (SELECT DISTINCT trace, b.* FROM t CROSS JOIN b), a AS (SELECT *, {anchor('l')} AS yl, {anchor('r')} AS yr FROM k),
    c AS (SELECT a.trace, band, t.x, greatest(t.y - (yl + (yr - yl) * (t.x - l) / (r - l)), 0) AS c, t.y FROM a JOIN t ON t.trace = a.trace AND t.x BETWEEN lo AND hi),
    p AS (SELECT *, (x - lag(x) OVER w) * (c + lag(c) OVER w) / 2 AS part FROM c WINDOW w AS (PARTITION BY trace, band ORDER BY x, y)),
    g AS (SELECT trace, band, count(*) AS n, sum(part) AS area, max(c) AS height FROM p GROUP BY ALL)
    SELECT a.trace, a.band, coalesce(n, 0) AS n, CASE WHEN n >= 2 THEN round(area, 4) END AS area, round(height, 4) AS height FROM a LEFT JOIN g ON a.trace = g.trace AND a.band = g.band"""


@register(_band_sql(False))
def band_area_per_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(traces.band_areas(trace_table(spark, sf_dir), _BANDS), 4)


@register(_band_sql(True))
def band_area_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(traces.band_areas(trace_table(spark, sf_dir), _BANDS, shared=True), 4)


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra(spark, sf_dir).select("sample", "grp", "y", F.posexplode("spectrum").alias("pos", "v"))


def _sg_sql(window: int, poly: int, deriv: int) -> str:
    """Weights from the same least squares, written out place by place."""
    half = window // 2
    inner = " + ".join(f"{w!r} * spectrum[k + {i - half + 1}]" for i, w in enumerate(savgol.weights(window, poly, deriv)))
    cases = "".join(f" WHEN k = {j} THEN " + " + ".join(f"{w!r} * spectrum[{i + 1}]" for i, w in enumerate(savgol.weights(window, poly, deriv, j))) for j in range(half))
    cases += "".join(f" WHEN k = {64 - half + j} THEN " + " + ".join(f"{w!r} * spectrum[{64 - window + i + 1}]" for i, w in enumerate(savgol.weights(window, poly, deriv, half + 1 + j))) for j in range(half))
    return f"WITH sp AS ({SPECTRA_SQL}) SELECT sample, k AS pos, round(CASE{cases} ELSE {inner} END, 6) + 0.0 AS v FROM sp, unnest(range(0, 64)) AS u(k)"


def _sg(name: str, window: int, poly: int, deriv: int) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spectra(spark, sf_dir).select("sample", savgol.filter_array(F.col("spectrum"), window, poly, deriv).alias("f"))
        return rounded(rows.select("sample", F.posexplode("f").alias("pos", "v")).withColumn("pos", F.col("pos").cast("long")))

    register(_sg_sql(window, poly, deriv), name)(query)


_sg("sg_smooth", 11, 3, 0)
_sg("sg_d1", 17, 3, 1)
_sg("sg_d2", 17, 3, 2)


@register(_S + """, m AS (SELECT grp, 4000 - 50 * pos AS x, avg(v) AS y FROM ch GROUP BY ALL)
SELECT grp, arg_min(x, [y, x]) FILTER (x BETWEEN 2000 - 600 AND 2000 - 120) AS left, arg_min(x, [y, x]) FILTER (x BETWEEN 2000 + 120 AND 2000 + 600) AS right FROM m GROUP BY grp""")
def find_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = _channels(spark, sf_dir).groupBy("grp", (4000 - 50 * F.col("pos")).cast("long").alias("x")).agg(F.avg("v").alias("y"))
    return traces.find_anchors(means, 2000, 120, 600, key="grp")


def _sg_value(window: int, poly: int, deriv: int, a: str) -> str:
    """The filter at place k of a list a of 64 values, in SQL."""
    return _sg_sql(window, poly, deriv).split("round(", 1)[1].split(", 6) + 0.0 AS v")[0].replace("spectrum[", f"{a}[")


#: A band at 31.5 of a grid of places 0 to 63: anchors on the smoothed mean spectrum, area and height above the line, trough.
_CENTER, _GAP, _MOST, _NEAR = 31.5, 4.0, 16.0, 8.0
_METRIC_SQL = _S + f""", re AS (SELECT list(m ORDER BY pos) AS ref FROM (SELECT pos, avg(v) AS m FROM ch GROUP BY pos)),
sm AS (SELECT k AS x, {_sg_value(13, 3, 0, 'ref')} AS v FROM re, unnest(range(0, 64)) AS u(k)),
an AS (SELECT arg_min(x, [v, x]) FILTER (x BETWEEN {_CENTER - _MOST} AND {_CENTER - _GAP}) AS lo, arg_min(x, [v, x]) FILTER (x BETWEEN {_CENTER + _GAP} AND {_CENTER + _MOST}) AS hi FROM sm),
li AS (SELECT sample, grp, y, spectrum, lo, hi, list_avg(spectrum[lo - 1 : lo + 3]) AS yl, list_avg(spectrum[hi - 1 : hi + 3]) AS yr FROM sp CROSS JOIN an),
co AS (SELECT sample, x, greatest(spectrum[x + 1] - (yl + (yr - yl) * (x - lo) / (hi - lo)), 0) AS c FROM li, unnest(range(0, 64)) AS u(x) WHERE x BETWEEN lo AND hi),
tr AS (SELECT sample, c, (c + lag(c) OVER (PARTITION BY sample ORDER BY x)) / 2 AS part FROM co), ah AS (SELECT sample, sum(part) AS area, max(c) AS height FROM tr GROUP BY sample),
d2 AS (SELECT sample, max(-({_sg_value(13, 3, 2, 'spectrum')})) AS deriv2 FROM sp, unnest(range(0, 64)) AS u(k) WHERE k BETWEEN {_CENTER - _NEAR} AND {_CENTER + _NEAR} GROUP BY sample),
m AS (SELECT sp.sample, sp.grp, sp.y, area, height, deriv2 FROM sp JOIN ah USING (sample) JOIN d2 USING (sample)),
u AS (SELECT grp, y, 'height' AS metric, height AS value FROM m UNION ALL SELECT grp, y, 'area', area FROM m UNION ALL SELECT grp, y, 'deriv2', deriv2 FROM m)"""


def _band_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, grid = spectra(spark, sf_dir), np.arange(64.0)
    anchors = traces.locked_anchors(preprocess.channel_stats(rows)[0], grid, _CENTER, _GAP, _MOST)
    return rows.select("sample", "grp", "y", *[v.alias(k) for k, v in traces.band_metrics(grid, anchors, _CENTER, window=_NEAR).items()])


def _metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _band_metrics(spark, sf_dir).unpivot(["sample", "grp", "y"], ["height", "area", "deriv2"], "metric", "value")


@register(_METRIC_SQL + " SELECT sample, round(area, 6) AS area, round(height, 6) AS height, round(deriv2, 6) AS deriv2 FROM m")
def band_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_band_metrics(spark, sf_dir).select("sample", "area", "height", "deriv2"))


@register(_METRIC_SQL + """, g AS (SELECT metric, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, 100 * stddev_samp(value) / avg(value) AS rsd FROM u GROUP BY metric)
SELECT metric, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(rsd, 6) AS rsd_percent, CASE WHEN max(rsd) OVER () / min(rsd) OVER () > 3 THEN 'WARN' ELSE 'INFO' END AS severity FROM g""")
def baseline_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.summarize(_metric_rows(spark, sf_dir), ["metric"], "value", with_ci=False).drop("sem")
    every = Window.partitionBy(F.lit(0))  # one row per metric
    worst = F.max("rsd_percent").over(every) / F.min("rsd_percent").over(every)
    return rounded(out.withColumn("severity", F.when(worst > 3, "WARN").otherwise("INFO")))


@register(_METRIC_SQL + """, g AS (SELECT metric, count(*) AS n, regr_slope(value, y) AS b, regr_intercept(value, y) AS a0, regr_r2(value, y) AS r2, regr_syy(value, y) - regr_sxy(value, y) ** 2 / regr_sxx(value, y) AS sse FROM u GROUP BY metric),
l AS (SELECT metric, grp, 100 * stddev_samp(value) / nullif(avg(value), 0) AS rsd FROM u GROUP BY ALL), a AS (SELECT metric, avg(rsd) AS mean_rsd FROM l GROUP BY 1)
SELECT metric, n, round(b, 6) AS slope, round(r2, 6) AS r2, round(3.3 * sqrt(sse / (n - 2)) / abs(b), 3) AS lod, round(10 * sqrt(sse / (n - 2)) / abs(b), 3) AS loq, round(mean_rsd, 6) AS mean_rsd,
       round(100 * (chk - a0) / b / 5, 4) AS recovery FROM g JOIN a USING (metric) JOIN (SELECT metric, avg(value) AS chk FROM u WHERE grp = 5 GROUP BY 1) USING (metric)""")
def calibration_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _metric_rows(spark, sf_dir)
    fits = calibration.with_limits(calibration.fit(rows, ["metric"], "y", "value"))
    check = rows.filter("grp = 5").groupBy("metric").agg(F.avg("value").alias("chk"))  # the true value of these is 5
    fits = fits.join(check, "metric").withColumn("recovery", 100 * (F.col("chk") - F.col("intercept")) / F.col("slope") / 5)
    fits = fits.select("metric", "n", "slope", "r2", F.round("lod", 3).alias("lod"), F.round("loq", 3).alias("loq"), F.round("recovery", 4).alias("recovery"))
    levels = stats.summarize(rows, ["metric", "grp"], "value", with_ci=False).groupBy("metric").agg(F.avg("rsd_percent").alias("mean_rsd"))
    return rounded(fits.join(levels, "metric"))


_RUNS = "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 9 <> 0 THEN 'arpls' END AS baseline, power(10e0, 4 + s_suppkey % 2) AS lam, CASE WHEN s_suppkey % 3 = 0 THEN '10-20' ELSE '10-30' END AS windows FROM supplier"


@register(f"SELECT count(*) AS n, count(DISTINCT concat(coalesce(baseline, '?'), ' ', lam, ' ', windows)) AS n_settings, CASE WHEN count(DISTINCT concat(coalesce(baseline, '?'), ' ', lam, ' ', windows)) > 1 THEN 'FAIL' ELSE 'INFO' END AS severity FROM ({_RUNS})")
def same_processing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by rule, one for each supplier."""
    table(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    return traces.same_processing(spark.sql(_RUNS), ["baseline", "lam", "windows"], "id")


def _checked_baseline(method: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(baseline.corrected(trace_table(spark, sf_dir), method))

    register(None, f"baseline_{method}")(query)


_checked_baseline("arpls")
_checked_baseline("rubberband")


@register(_T + """, h AS (SELECT p.trace, p.x, p.y, min(a.y + (b.y - a.y) * coalesce((p.x - a.x) / nullif(b.x - a.x, 0), 0)) AS baseline FROM t p JOIN t a ON a.trace = p.trace AND a.x <= p.x JOIN t b ON b.trace = p.trace AND b.x >= p.x GROUP BY ALL)
SELECT trace, round(x, 6) AS x, round(y, 6) AS y, round(baseline, 4) + 0.0 AS baseline FROM h""")
def baseline_lower_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hull is the lowest of all chords over a place."""
    rows = baseline.corrected(trace_table(spark, sf_dir), "rubberband").select("trace", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), (F.round("baseline", 4) + 0.0).alias("baseline"))
    return rows


@register(_T + """, g AS (SELECT trace, step, y, lag(y) OVER w AS b, lead(y) OVER w AS a FROM t WINDOW w AS (PARTITION BY trace ORDER BY x))
SELECT trace, step, round(CASE WHEN a IS NULL AND b IS NULL THEN NULL WHEN b IS NULL THEN a - y WHEN a IS NULL THEN y - b ELSE (a - b) / 2 END, 6) + 0.0 AS slope FROM g""")
def trace_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(traces.gradient(trace_table(spark, sf_dir)).select("trace", "step", "slope"))


@register(_T + """, s AS (SELECT trace, max(y) - min(y) AS ptp FROM t GROUP BY 1), k AS (SELECT trace, (dense_rank() OVER (ORDER BY trace) - 1) * 1.15 * max(ptp) OVER () AS shift FROM s)
SELECT trace, step, round(y + shift, 4) AS y_stacked FROM t JOIN k USING (trace)""")
def waterfall_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(traces.offset_stack(trace_table(spark, sf_dir)).select("trace", "step", "y_stacked"), 4)


_PRE_SQL = {
    "snv": ", f AS (SELECT *, avg(v) OVER (PARTITION BY sample) AS m, stddev_pop(v) OVER (PARTITION BY sample) AS s FROM ch) SELECT sample, pos, round((v - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) + 0.0 AS v FROM f",
    "center": " SELECT sample, pos, round(v - avg(v) OVER (PARTITION BY pos), 6) + 0.0 AS v FROM ch",
    "autoscale": ", f AS (SELECT *, avg(v) OVER (PARTITION BY pos) AS m, stddev_pop(v) OVER (PARTITION BY pos) AS s FROM ch) SELECT sample, pos, round((v - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) + 0.0 AS v FROM f",
    "msc": ", r AS (SELECT pos, avg(v) AS ref FROM ch GROUP BY pos), f AS (SELECT sample, regr_slope(v, ref) AS b, regr_intercept(v, ref) AS a FROM ch JOIN r USING (pos) GROUP BY sample) SELECT sample, pos, round((v - a) / CASE WHEN b = 0 THEN 1 ELSE b END, 4) + 0.0 AS v FROM ch JOIN f USING (sample)",
    "snv+center": ", f AS (SELECT *, avg(v) OVER (PARTITION BY sample) AS m, stddev_pop(v) OVER (PARTITION BY sample) AS s FROM ch), g AS (SELECT sample, pos, (v - m) / CASE WHEN s = 0 THEN 1 ELSE s END AS v FROM f) SELECT sample, pos, round(v - avg(v) OVER (PARTITION BY pos), 6) + 0.0 AS v FROM g",
}


def _pre(chain: str, sql: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spectra(spark, sf_dir)
        done = preprocess.Preprocessor(chain).fit(rows).transform(rows).select("sample", F.posexplode("spectrum").alias("pos", "v"))
        return rounded(done.withColumn("pos", F.col("pos").cast("long")), 4 if chain == "msc" else 6)

    register(_S + sql, "preprocess_" + chain.replace("+", "_"))(query)


for _chain, _sql in _PRE_SQL.items():
    _pre(_chain, _sql)


@register(_S + """, r AS (SELECT pos, avg(v) AS ref FROM ch GROUP BY pos), f AS (SELECT sample, regr_slope(v, ref) AS b, regr_intercept(v, ref) AS a FROM ch JOIN r USING (pos) GROUP BY sample)
SELECT sample, round(b, 6) AS scale, round(sum(((v - a) / b) ** 2), 3) AS total FROM ch JOIN f USING (sample) GROUP BY sample, b""")
def emsc_poly0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _emsc(spark, sf_dir, 0)


@register(_S + """, pz AS (SELECT DISTINCT pos, pos - 31.5 AS z, (pos - 31.5) ** 2 AS zz FROM ch), qq AS (SELECT pos, 1 / sqrt(64) AS q0, z / sqrt(sum(z * z) OVER ()) AS q1, (zz - avg(zz) OVER ()) AS w2 FROM pz),
q AS (SELECT pos, q0, q1, w2 / sqrt(sum(w2 * w2) OVER ()) AS q2 FROM qq), rf AS (SELECT pos, avg(v) AS ref FROM ch GROUP BY pos),
c AS (SELECT sum(ref * q0) AS c0, sum(ref * q1) AS c1, sum(ref * q2) AS c2 FROM rf JOIN q USING (pos)), rs AS (SELECT pos, q0, q1, q2, c0 * q0 + c1 * q1 + c2 * q2 AS pr, ref - (c0 * q0 + c1 * q1 + c2 * q2) AS r FROM rf JOIN q USING (pos) CROSS JOIN c),
xs AS (SELECT sample, sum(v * q0) AS a0, sum(v * q1) AS a1, sum(v * q2) AS a2, sum(v * r) / sum(r * r) AS b FROM ch JOIN rs USING (pos) GROUP BY sample)
SELECT sample, round(b, 6) + 0.0 AS scale, round(sum(((v - (a0 * q0 + a1 * q1 + a2 * q2) + b * pr) / b) ** 2), 3) + 0.0 AS total FROM ch JOIN rs USING (pos) JOIN xs USING (sample) GROUP BY sample, b""")
def emsc_poly2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _emsc(spark, sf_dir, 2)


def _emsc(spark: SparkSession, sf_dir: str, poly: int) -> DataFrame:
    rows = spectra(spark, sf_dir)
    reference = preprocess.channel_stats(rows)[0]
    out = preprocess.emsc(rows, 4000 - 50.0 * np.arange(len(reference)), reference, poly)
    return out.select("sample", (F.round(F.get("emsc", F.lit(0)), 6) + 0.0).alias("scale"), (F.round(dot(F.col("corrected"), F.col("corrected")), 3) + 0.0).alias("total"))


@register(f"""WITH sp AS ({SPECTRA_SQL}), s AS (SELECT count(*) AS n, count(DISTINCT len(spectrum)) AS lengths, count(*) FILTER (len(list_filter(spectrum, lambda v: v IS NULL OR NOT isfinite(v))) > 0) AS bad FROM sp),
c AS (SELECT 'one_length' AS code, 'FAIL' AS sev, lengths <= 1 AS ok FROM s UNION ALL SELECT 'finite', 'FAIL', bad = 0 FROM s UNION ALL SELECT 'enough_samples', 'WARN', n >= 4 FROM s UNION ALL SELECT 'components_below_samples', 'WARN', 1000 < n FROM s)
SELECT code, CASE WHEN ok THEN 'INFO' ELSE sev END AS severity, ok FROM c""")
def matrix_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole matrix, asked for a thousand components."""
    return preprocess.check_matrix(spectra(spark, sf_dir), 1000)
