"""Queries on the spectral matrix (embeddings): moments, latent-variable models, validation, outliers."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import dot
from ..operators import gram, outliers, report, validate, wide
from ..functions import dist
from ..sources.scratch import materialize, scratch_dir
from ..streaming import scoring
from .adapters import CHANNELS_SQL, SPECTRA_SQL, as_spectra, principal_sql, rounded, spectra, table
from .catalogue import register

_S = f"WITH sp AS ({SPECTRA_SQL}), ch AS ({CHANNELS_SQL})"
_LVS = 3


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@register(_S + ", c AS (SELECT sample, pos, v - avg(v) OVER (PARTITION BY pos) AS v FROM ch) SELECT a.pos AS i, b.pos AS j, round(sum(a.v * b.v), 4) + 0.0 AS v FROM c a JOIN c b ON a.sample = b.sample AND a.pos <= b.pos GROUP BY ALL")
def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = gram.moments(spectra(spark, sf_dir))[None].scatter[:-1, :-1]
    return rounded(_frame(spark, [(i, j, float(s[i, j])) for i in range(len(s)) for j in range(i, len(s))], "i long, j long, v double"), 4)


_PR = f"{_S}, {principal_sql()}"


@register(_PR + " SELECT component, CAST(pos AS BIGINT) AS pos, round(u, 6) + 0.0 AS loading, round(eigenvalue, 6) AS eigenvalue, round(eigenvalue / total, 6) AS share FROM ax JOIN ev USING (component)")
def pca_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two axes over all channels, their eigenvalues and shares."""
    values, loadings, shares = gram.principal(gram.moments(spectra(spark, sf_dir))[None], 2)
    rows = [(k + 1, i, float(v), float(values[k]), float(shares[k])) for k in range(2) for i, v in enumerate(loadings[:, k])]
    return rounded(_frame(spark, rows, "component int, pos long, loading double, eigenvalue double, share double"))


@register(_PR + " SELECT sample, round(t_1, 6) + 0.0 AS score_1, round(t_2, 6) + 0.0 AS score_2 FROM sc")
def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spectra(spark, sf_dir)
    m = gram.moments(rows)[None]
    _, loadings, _ = gram.principal(m, 2)
    centred = F.zip_with("spectrum", gram.vector(m.mean[:-1]), lambda v, c: v - c)
    return rounded(rows.select("sample", *[dot(centred, gram.vector(loadings[:, k])).alias(f"score_{k + 1}") for k in range(2)]))


_STANDARD = _S + """, z0 AS (SELECT sample, pos, (v - avg(v) OVER w) / stddev_samp(v) OVER w AS v FROM ch WINDOW w AS (PARTITION BY pos)), y0 AS (SELECT sample, (y - avg(y) OVER ()) / stddev_samp(y) OVER () AS y FROM sp)"""


def _lv(k: int) -> str:
    return f""", a{k} AS (SELECT pos, sum(v * y) AS c FROM z{k - 1} JOIN y0 USING (sample) GROUP BY pos), w{k} AS (SELECT pos, c / sqrt(sum(c * c) OVER ()) AS w FROM a{k}),
    t{k} AS (SELECT sample, sum(v * w) AS t FROM z{k - 1} JOIN w{k} USING (pos) GROUP BY sample), s{k} AS (SELECT sum(t * t) AS tt, sum(t * y) / sum(t * t) AS q FROM t{k} JOIN y0 USING (sample)),
    p{k} AS (SELECT pos, sum(v * t) / (SELECT tt FROM s{k}) AS p FROM z{k - 1} JOIN t{k} USING (sample) GROUP BY pos), z{k} AS (SELECT z.sample, z.pos, z.v - t * p AS v FROM z{k - 1} z JOIN t{k} ON t{k}.sample = z.sample JOIN p{k} ON p{k}.pos = z.pos)"""


def _fitted_sql(n: int) -> str:
    terms = " + ".join(f"t{k}.t * (SELECT q FROM s{k})" for k in range(1, n + 1))
    joins = "".join(f" JOIN t{k} ON t{k}.sample = sp.sample" for k in range(1, n + 1))
    return _STANDARD + "".join(_lv(k) for k in range(1, n + 1)) + f" SELECT sp.sample, round((SELECT avg(y) FROM sp) + (SELECT stddev_samp(y) FROM sp) * ({terms}), 6) + 0.0 AS predicted FROM sp{joins}"


def _pls_query(n: int) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spectra(spark, sf_dir)
        model = gram.pls(gram.moments(rows)[None], n)
        return rounded(rows.select("sample", model.predict(F.col("spectrum"), n).alias("predicted")))

    register(_fitted_sql(n), f"pls1_{n}lv")(query)


_pls_query(1)
_pls_query(2)


@register(_STANDARD + _lv(1) + " SELECT pos, round(sqrt(64 * w * w), 6) AS vip FROM w1")
def pls_vip(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = gram.vip(gram.pls(gram.moments(spectra(spark, sf_dir))[None], 1))
    return rounded(_frame(spark, [(i, float(v)) for i, v in enumerate(values)], "pos long, vip double"))


@register(_STANDARD + _lv(1) + _lv(2) + """, s AS (SELECT s1.q ** 2 * s1.tt AS a, s2.q ** 2 * s2.tt AS b FROM s1 CROSS JOIN s2)
SELECT pos, round(sqrt(64 * (w1.w ** 2 * a + w2.w ** 2 * b) / (a + b)), 6) AS vip FROM w1 JOIN w2 USING (pos) CROSS JOIN s""")
def pls_vip_2lv(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = gram.vip(gram.pls(gram.moments(spectra(spark, sf_dir))[None], 2))
    return rounded(_frame(spark, [(i, float(v)) for i, v in enumerate(values)], "pos long, vip double"))


@register(_PR + ", r AS (SELECT avg(y) AS m, sum(t_1 * y) / sum(t_1 * t_1) AS b1, sum(t_2 * y) / sum(t_2 * t_2) AS b2 FROM sc) SELECT sample, round(m + b1 * t_1 + b2 * t_2, 6) AS predicted FROM sc CROSS JOIN r")
def pcr_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two principal components of all channels."""
    rows = spectra(spark, sf_dir)
    model = gram.pcr(gram.moments(rows)[None], 2)
    return rounded(rows.select("sample", model.predict(F.col("spectrum"), 2).alias("predicted")))


@register(f"WITH sp AS ({SPECTRA_SQL}), l AS (SELECT DISTINCT y FROM sp), f AS (SELECT y, CAST((dense_rank() OVER (ORDER BY y) - 1) % least(5, count(*) OVER ()) AS BIGINT) AS fold FROM l) SELECT sample, y, fold FROM sp JOIN f USING (y)")
def cv_folds_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.folds(spectra(spark, sf_dir), "kfold").select("sample", "y", F.col("fold").cast("long").alias("fold"))


@register(f"WITH sp AS ({SPECTRA_SQL}) SELECT grp AS fold, count(*) AS n_test, (SELECT count(*) FROM sp) - count(*) AS n_train FROM sp GROUP BY grp")
def cv_folds_logo(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = validate.folds(spectra(spark, sf_dir), "logo").groupBy("fold").agg(F.count("*").alias("n_test"))
    return f.crossJoin(F.broadcast(f.agg(F.sum("n_test").alias("n")))).select("fold", "n_test", (F.col("n") - F.col("n_test")).alias("n_train"))


_FOLDED = f"""WITH sp AS ({SPECTRA_SQL}), ch AS ({CHANNELS_SQL}), g AS (SELECT DISTINCT grp AS f FROM sp),
m AS (SELECT f, pos, avg(v) AS m, stddev_samp(v) AS s FROM ch JOIN g ON grp <> f GROUP BY ALL), my AS (SELECT f, avg(y) AS m, stddev_samp(y) AS s FROM sp JOIN g ON grp <> f GROUP BY f),
z AS (SELECT m.f, sample, grp, m.pos, (v - m.m) / m.s AS v, (y - my.m) / my.s AS y FROM ch JOIN m USING (pos) JOIN my ON my.f = m.f),
a AS (SELECT f, pos, sum(v * y) AS c FROM z WHERE grp <> f GROUP BY ALL), w AS (SELECT f, pos, c / sqrt(sum(c * c) OVER (PARTITION BY f)) AS w FROM a),
t AS (SELECT z.f, sample, grp, y, sum(v * w) AS t FROM z JOIN w ON w.f = z.f AND w.pos = z.pos GROUP BY ALL), q AS (SELECT f, sum(t * y) / sum(t * t) AS q FROM t WHERE grp <> f GROUP BY f),
p AS (SELECT t.f, t.sample, sp.y, my.m + my.s * t * q AS predicted FROM t JOIN q ON q.f = t.f JOIN my ON my.f = t.f JOIN sp ON sp.sample = t.sample WHERE t.grp = t.f)"""


@register(_FOLDED + " SELECT count(*) AS n, round(sqrt(avg((predicted - y) ** 2)), 6) AS rmsecv, round(avg(predicted - y), 6) + 0.0 AS bias, round(1 - sum((predicted - y) ** 2) / (count(*) * var_pop(y)), 6) AS r2cv FROM p")
def cv_rmsecv_1lv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validate.folds(spectra(spark, sf_dir), "logo")
    return rounded(validate.cv_stats(validate.predictions(rows, 1), ["a"]).drop("a"))


def _scattered(columns: str) -> str:
    """_FOLDED on spectra corrected against each fold's own reference; columns: the polynomials up to a degree, made orthonormal in turn."""
    return f"""WITH sp AS ({SPECTRA_SQL}), ch AS ({CHANNELS_SQL}), g AS (SELECT DISTINCT grp AS f FROM sp), po AS (SELECT pos, 2 * pos / 63e0 - 1 AS z FROM (SELECT DISTINCT pos FROM ch)),
{columns}, rf AS (SELECT f, pos, avg(v) AS r FROM ch JOIN g ON grp <> f GROUP BY ALL), rk AS (SELECT f, k, sum(r * u) AS c FROM rf JOIN un USING (pos) GROUP BY ALL), rp AS (SELECT f, pos, sum(c * u) AS p FROM rk JOIN un USING (k) GROUP BY ALL),
rq AS (SELECT f, pos, p, r - p AS q FROM rf JOIN rp USING (f, pos)), xk AS (SELECT sample, k, sum(v * u) AS c FROM ch JOIN un USING (pos) GROUP BY ALL), xp AS (SELECT sample, pos, sum(c * u) AS p FROM xk JOIN un USING (k) GROUP BY ALL),
sl AS (SELECT f, sample, sum(v * q) / (SELECT sum(o.q * o.q) FROM rq o WHERE o.f = rq.f) AS b FROM ch JOIN rq USING (pos) GROUP BY f, sample),
cc AS MATERIALIZED (SELECT rq.f, ch.sample, ch.grp, ch.pos, (ch.v - xp.p) / sl.b + rq.p AS v FROM ch JOIN xp USING (sample, pos) JOIN rq USING (pos) JOIN sl ON sl.f = rq.f AND sl.sample = ch.sample),
m AS (SELECT f, pos, avg(v) AS m, stddev_samp(v) AS s FROM cc WHERE grp <> f GROUP BY ALL), my AS (SELECT f, avg(y) AS m, stddev_samp(y) AS s FROM sp JOIN g ON grp <> f GROUP BY f),
z AS (SELECT cc.f, cc.sample, cc.grp, cc.pos, (v - m.m) / m.s AS v, (sp.y - my.m) / my.s AS y FROM cc JOIN m USING (f, pos) JOIN my USING (f) JOIN sp USING (sample)),
a AS (SELECT f, pos, sum(v * y) AS c FROM z WHERE grp <> f GROUP BY ALL), w AS (SELECT f, pos, c / sqrt(sum(c * c) OVER (PARTITION BY f)) AS w FROM a),
t AS (SELECT z.f, sample, grp, y, sum(v * w) AS t FROM z JOIN w ON w.f = z.f AND w.pos = z.pos GROUP BY ALL), q AS (SELECT f, sum(t * y) / sum(t * t) AS q FROM t WHERE grp <> f GROUP BY f)
SELECT t.f AS fold, t.sample, round(my.m + my.s * t * q, 6) AS predicted FROM t JOIN q ON q.f = t.f JOIN my ON my.f = t.f WHERE t.grp = t.f"""


_CONSTANT = "un AS MATERIALIZED (SELECT pos, 0 AS k, 1 / 8e0 AS u FROM po)"
_QUADRATIC = """q0 AS (SELECT pos, z, 1 / 8e0 AS u FROM po), q1 AS (SELECT pos, z, z / sqrt(sum(z * z) OVER ()) AS u FROM po),
q2 AS (SELECT pos, z * z - avg(z * z) OVER () AS e FROM po), un AS MATERIALIZED (SELECT pos, 0 AS k, u FROM q0 UNION ALL SELECT pos, 1, u FROM q1 UNION ALL SELECT pos, 2, e / sqrt(sum(e * e) OVER ()) FROM q2)"""


@register(_scattered(_CONSTANT))
def cv_msc_1lv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out predictions with scatter corrected against the mean spectrum of each fold's training rows."""
    found = validate.predictions(validate.folds(spectra(spark, sf_dir), "logo"), 1, chain="msc")
    return rounded(found.select("fold", "sample", "predicted"))


@register(_scattered(_QUADRATIC))
def cv_emsc_1lv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a quadratic baseline beside the reference."""
    found = validate.predictions(validate.folds(spectra(spark, sf_dir), "logo"), 1, chain="emsc+autoscale")
    return rounded(found.select("fold", "sample", "predicted"))


def _scan_sql(most: int) -> str:
    """Held-out errors of 1 to `most` latent variables for two chains; each is deflated in turn over every fold's training rows."""
    parts = [f"sp AS ({SPECTRA_SQL})", f"raw AS ({CHANNELS_SQL})", "ch AS (SELECT 'none' AS pre, sample, y, grp, pos, v FROM raw UNION ALL SELECT 'snv', sample, y, grp, pos, (v - avg(v) OVER k) / stddev_pop(v) OVER k FROM raw WINDOW k AS (PARTITION BY sample))",
             "g AS (SELECT DISTINCT grp AS f FROM sp)", "m AS (SELECT pre, f, pos, avg(v) AS m, stddev_samp(v) AS s FROM ch JOIN g ON grp <> f GROUP BY ALL)", "my AS (SELECT f, avg(y) AS m, stddev_samp(y) AS s FROM sp JOIN g ON grp <> f GROUP BY f)",
             "e0 AS MATERIALIZED (SELECT pre, m.f, sample, grp, pos, (v - m.m) / m.s AS v, (y - my.m) / my.s AS y FROM ch JOIN m USING (pre, pos) JOIN my ON my.f = m.f)"]
    for k in range(1, most + 1):
        parts += [
            f"a{k} AS (SELECT pre, f, pos, sum(v * y) AS c FROM e{k - 1} WHERE grp <> f GROUP BY ALL)", f"w{k} AS (SELECT pre, f, pos, c / sqrt(sum(c * c) OVER (PARTITION BY pre, f)) AS w FROM a{k})",
            f"t{k} AS MATERIALIZED (SELECT pre, f, sample, grp, any_value(y) AS y, sum(v * w) AS t FROM e{k - 1} JOIN w{k} USING (pre, f, pos) GROUP BY pre, f, sample, grp)", f"q{k} AS (SELECT pre, f, sum(t * y) / sum(t * t) AS q, sum(t * t) AS tt FROM t{k} WHERE grp <> f GROUP BY ALL)",
            f"p{k} AS (SELECT e.pre, e.f, pos, sum(e.v * t) / any_value(tt) AS p FROM e{k - 1} e JOIN t{k} t USING (pre, f, sample) JOIN q{k} USING (pre, f) WHERE e.grp <> e.f GROUP BY ALL)",
            f"e{k} AS MATERIALIZED (SELECT e.pre, e.f, e.sample, e.grp, e.pos, e.v - t * p AS v, e.y - t * q AS y FROM e{k - 1} e JOIN t{k} t USING (pre, f, sample) JOIN q{k} USING (pre, f) JOIN p{k} USING (pre, f, pos))",
        ]
    parts.append("u AS (" + " UNION ALL ".join(f"SELECT {k} AS k, pre, f, sample, t * q AS v FROM t{k} JOIN q{k} USING (pre, f) WHERE grp = f" for k in range(1, most + 1)) + ")")
    parts.append("h AS (SELECT pre, k AS a, sample, my.m + my.s * sum(v) OVER (PARTITION BY pre, sample ORDER BY k) AS predicted, sp.y FROM u JOIN my USING (f) JOIN sp USING (sample))")
    return "WITH " + ", ".join(parts) + " SELECT a, count(*) AS n, round(sqrt(avg((predicted - y) ** 2)), 6) AS rmsecv, round(avg(predicted - y), 6) + 0.0 AS bias, round(1 - sum((predicted - y) ** 2) / (count(*) * var_pop(y)), 6) AS r2cv, pre FROM h GROUP BY a, pre"


@register(_scan_sql(6))
def component_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validate.component_scan(validate.folds(spectra(spark, sf_dir), "logo"), 6))


#: Two latent variables from all moments less one row's, for each row i.
_LEFT_OUT = f"""{_S}, nn AS (SELECT count(*)::DOUBLE AS n, avg(y) AS my FROM sp), d AS MATERIALIZED (SELECT sample AS i, pos, v - avg(v) OVER (PARTITION BY pos) AS d FROM ch), dy AS MATERIALIZED (SELECT sample AS i, y, y - my AS d, n, my FROM sp CROSS JOIN nn),
s AS MATERIALIZED (SELECT a.pos AS j, b.pos AS k, sum(a.d * b.d) AS s FROM d a JOIN d b USING (i) GROUP BY ALL), sy AS MATERIALIZED (SELECT pos AS j, sum(d.d * dy.d) AS s FROM d JOIN dy USING (i) GROUP BY ALL), yy AS (SELECT sum(d * d) AS s FROM dy),
sd AS MATERIALIZED (SELECT i, pos AS j, d.d, sqrt((s.s - n / (n - 1) * d.d * d.d) / (n - 2)) AS sd FROM d JOIN s ON s.j = pos AND s.k = pos JOIN dy USING (i)), dz AS MATERIALIZED (SELECT i, y, dy.d, n, my, sqrt((s - n / (n - 1) * dy.d * dy.d) / (n - 2)) AS sd FROM dy CROSS JOIN yy),
a1 AS MATERIALIZED (SELECT x.i, x.j, z.j AS k, (s - n / (n - 1) * x.d * z.d) / (x.sd * z.sd) AS a FROM sd x JOIN sd z USING (i) JOIN s ON s.j = x.j AND s.k = z.j JOIN dz USING (i)), b1 AS MATERIALIZED (SELECT x.i, x.j, (s - n / (n - 1) * x.d * y.d) / (x.sd * y.sd) AS b FROM sd x JOIN sy USING (j) JOIN dz y USING (i)),
w1 AS MATERIALIZED (SELECT i, j, b, b / sqrt(sum(b * b) OVER (PARTITION BY i)) AS w FROM b1), p1 AS (SELECT a1.i, a1.j, sum(a * w) AS aw FROM a1 JOIN w1 ON w1.i = a1.i AND w1.j = k GROUP BY ALL), t1 AS MATERIALIZED (SELECT i, sum(w * aw) AS tt, sum(b * w) / sum(w * aw) AS q FROM w1 JOIN p1 USING (i, j) GROUP BY i),
l1 AS MATERIALIZED (SELECT i, j, aw / tt AS p FROM p1 JOIN t1 USING (i)), b2 AS (SELECT i, j, b - tt * q * p AS b FROM b1 JOIN l1 USING (i, j) JOIN t1 USING (i)), w2 AS MATERIALIZED (SELECT i, j, b, b / sqrt(sum(b * b) OVER (PARTITION BY i)) AS w FROM b2),
p2 AS (SELECT a1.i, a1.j, sum(a * w) AS aw FROM a1 JOIN w2 ON w2.i = a1.i AND w2.j = k GROUP BY ALL), o2 AS MATERIALIZED (SELECT i, sum(p * w) AS pw FROM l1 JOIN w2 USING (i, j) GROUP BY i),
t2 AS MATERIALIZED (SELECT w2.i, sum(b * w) / (sum(w * aw) - any_value(tt) * any_value(pw) ** 2) AS q FROM w2 JOIN p2 USING (i, j) JOIN t1 ON t1.i = w2.i JOIN o2 ON o2.i = w2.i GROUP BY w2.i),
c AS (SELECT w1.i, w1.j, t1.q * w1.w + t2.q * (w2.w - pw * w1.w) AS c FROM w1 JOIN w2 USING (i, j) JOIN t1 ON t1.i = w1.i JOIN t2 ON t2.i = w1.i JOIN o2 ON o2.i = w1.i),
h AS (SELECT c.i, sum(c / sd.sd * (sd.d + sd.d / (n - 1))) * any_value(y.sd) + any_value(my) - any_value(y.d) / (any_value(n) - 1) AS predicted, any_value(y.y) AS y FROM c JOIN sd USING (i, j) JOIN dz y ON y.i = c.i GROUP BY c.i)"""


@register(_LEFT_OUT + " SELECT i AS sample, y, round(predicted, 6) AS predicted FROM h")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validate.leave_one_out(spectra(spark, sf_dir), 2))


@register(f"WITH scan AS ({_scan_sql(6)}) SELECT pre, a, rmsecv FROM scan WHERE rmsecv <= (SELECT min(rmsecv) FROM scan) * 1.1 ORDER BY a, rmsecv, pre LIMIT 1")
def choose_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fewest components near the best error of the scan."""
    scan = validate.component_scan(validate.folds(spectra(spark, sf_dir), "logo"), 6)
    return rounded(validate.choose_components(scan).select("pre", "a", "rmsecv"))


@register()
def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validate.permutation_test(spark, validate.folds(spectra(spark, sf_dir), "kfold"), 1))


@register(f"WITH sp AS ({SPECTRA_SQL}) SELECT 2e0 AS leverage_sum, round(2e0 * (count(*) - 1), 6) AS t2_sum, true AS proportional FROM sp")
def leverage_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leverages sum to the number of components, and T2 is (n - 1) of them."""
    rows = spectra(spark, sf_dir)
    model = outliers.fit(rows, 2)
    s = outliers.distances(rows, model)
    return rounded(s.agg(F.sum("leverage").alias("leverage_sum"), F.sum("t2").alias("t2_sum"), F.every(F.abs(F.col("t2") - (model.n - 1) * F.col("leverage")) < 1e-9).alias("proportional")))


@register(_PR + " SELECT sample, round(t2, 6) AS t2, round(q, 6) AS q, round(leverage, 6) AS leverage FROM sc")
def hotelling_t2_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances in and off a model of two components of all channels."""
    rows = spectra(spark, sf_dir)
    return rounded(outliers.distances(rows, outliers.fit(rows, 2)).select("sample", "t2", "q", "leverage"))


#: Quantiles of chi-squared at 0.95 by degrees of freedom, up to the most that two distances have together.
_CHI = ", ".join(f"({k}, {dist.chi2_ppf(0.95, k)!r}::DOUBLE)" for k in range(1, 2 * outliers.MOST_DOF + 1))
_LIMITS = f""", chi(dof, v) AS (VALUES {_CHI}), mm AS (SELECT avg(leverage) AS h0, var_samp(leverage) AS vh, avg(q) AS q0, var_samp(q) AS vq FROM sc{{where}}),
li AS (SELECT h0, q0, least(250, greatest(1, round_even(2 * h0 * h0 / vh, 0))) AS nh, least(250, greatest(1, round_even(2 * q0 * q0 / vq, 0))) AS nq FROM mm),
fu AS (SELECT sample, grp, nh * leverage / h0 + nq * q / q0 AS f, v AS critical FROM sc CROSS JOIN li JOIN chi ON dof = CAST(nh + nq AS INT))"""


@register(_PR + _LIMITS.format(where="") + " SELECT sample, round(f, 6) AS f, f <= critical AS accepted FROM fu")
def ddsimca_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of both distances give their degrees of freedom."""
    rows = spectra(spark, sf_dir)
    scored = outliers.distances(rows, outliers.fit(rows, 2))
    return rounded(outliers.accept(scored, outliers.acceptance(scored, gamma=None)).select("sample", "f", "accepted"))


@register(_PR + _LIMITS.format(where="") + " SELECT sample, round(f, 6) AS f, f <= critical AS accepted FROM fu")
def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream, scored by a model of two components and written as it comes."""
    rows = spectra(spark, sf_dir)
    model = outliers.fit(rows, 2)
    limits = outliers.acceptance(outliers.distances(rows, model), gamma=None)
    where = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf_dir, "embeddings").schema).parquet(f"{sf_dir}/embeddings.parquet*")  # a pattern, as the table may be one file
    scored = scoring.score(as_spectra(stream), model, limits).select("sample", "f", "accepted")
    return rounded(scoring.written(scored, f"{where}/rows", f"{where}/state"))


@register()
def ddsimca_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles in place of moments, over all channels."""
    rows = spectra(spark, sf_dir)
    scored = outliers.distances(rows, outliers.fit(rows, 2))
    return rounded(outliers.accept(scored, outliers.acceptance(scored, method="robust")).select("sample", "t2", "q", "leverage", "f", "kind"))


@register(f"{_S}, {principal_sql('grp = 0')}" + _LIMITS.format(where=" WHERE grp = 0") + " SELECT sample, grp, round(f, 6) AS f, f <= critical AS accepted FROM fu")
def oneclass_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of one class judges every sample."""
    rows = spectra(spark, sf_dir)
    own = rows.filter("grp = 0")
    model = outliers.fit(own, 2)
    limits = outliers.acceptance(outliers.distances(own, model), gamma=None)
    return rounded(outliers.accept(outliers.distances(rows, model), limits).select("sample", "grp", "f", "accepted"))


@register(_FOLDED + " SELECT 'logo' AS scheme, 'a new group' AS question, count(*) AS n, round(sqrt(avg((predicted - y) ** 2)), 6) AS rmsecv, 'INFO' AS severity FROM p")
def cross_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validate.cross_validate(spectra(spark, sf_dir), 1, groups="grp")
    return rounded(found.select("scheme", "question", "n", "rmsecv", "severity"))


#: Quantiles of F and beta have a closed form for two components; chi-squared's is bisected over the incomplete gamma function's series.
_INCOMPLETE = "exp(-x / 2 + a * ln(x / 2)) * list_sum(list_transform(range(0, 400), lambda k: exp(k * ln(x / 2) - lgamma(a + k + 1))))"


@register(_PR.replace("WITH ", "WITH RECURSIVE ", 1) + f""", n AS (SELECT n::DOUBLE AS n, 2e0 AS a FROM tn), f AS (SELECT *, (n - a) / 2 * (pow(.05::DOUBLE, -2 / (n - a)) - 1) AS f FROM n),
s2 AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM c3 a JOIN c3 b ON a.j = b.i GROUP BY ALL), r AS (SELECT (SELECT sum(v) FROM c3 WHERE i = j) AS t1, (SELECT sum(v) FROM s2 WHERE i = j) AS t2, (SELECT sum(s2.v * c3.v) FROM s2 JOIN c3 ON c3.i = s2.j AND c3.j = s2.i) AS t3),
h AS (SELECT *, CASE WHEN 1 - 2 * t1 * t3 / (3 * t2 * t2) > 0 THEN 1 - 2 * t1 * t3 / (3 * t2 * t2) ELSE 1e-6 END AS h FROM r),
bi AS (SELECT 0 AS step, t1 * t1 / t2 / 2 AS a, 0e0 AS lo, 10 * t1 * t1 / t2 + 50 AS hi FROM r UNION ALL SELECT step + 1, a, CASE WHEN p < .95 THEN x ELSE lo END, CASE WHEN p < .95 THEN hi ELSE x END FROM (SELECT *, {_INCOMPLETE} AS p FROM (SELECT *, (lo + hi) / 2 AS x FROM bi WHERE step < 80)))
SELECT 't2' AS distance, form, round(value, 6) AS value FROM (SELECT 'F_textbook' AS form, a * (n - 1) / (n - a) * f AS value FROM f UNION ALL SELECT 'F_n2m1', a * (n * n - 1) / (n * (n - a)) * f FROM f UNION ALL SELECT 'chi2', -2 * ln(.05::DOUBLE) UNION ALL SELECT 'beta', (n - 1) ** 2 / n * (1 - pow(.05::DOUBLE, 2 / (n - a - 1))) FROM n)
UNION ALL SELECT 'q', 'jm', round(t1 * pow(1.6448536269514722 * sqrt(2 * t2 * h * h) / t1 + 1 + t2 * h * (h - 1) / (t1 * t1), 1 / h), 6) FROM h UNION ALL SELECT 'q', 'box', round(t2 / t1 * (SELECT (lo + hi) / 2 FROM bi WHERE step = 80), 6) FROM r""")
def distance_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = outliers.fit(spectra(spark, sf_dir), 2)
    rows = [("t2", form, outliers.t2_limit(model, form=form)) for form in ("F_textbook", "F_n2m1", "chi2", "beta")] + [("q", how, outliers.q_limit(model, method=how)) for how in ("jm", "box")]
    return rounded(_frame(spark, [(a, b, float(np.real(v))) for a, b, v in rows], "distance string, form string, value double"))


# --- many channels: a nation's orders by day, as a spectrum of some thousands of days

_DAILY = "SELECT c_nationkey AS nation, CAST(date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS INT) AS day, sum(o_totalprice) / 1e6 AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation, spectrum: millions ordered on each day from the first to the last of the table."""
    day = F.datediff(F.col("o_orderdate").cast("timestamp"), F.lit("1992-01-01").cast("timestamp"))
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("nation"), day.alias("day")).agg((F.sum("o_totalprice") / 1e6).alias("v"))
    ends = table(spark, sf_dir, "orders").agg(F.min(day).alias("low"), F.max(day).alias("high"))  # one row
    some = rows.groupBy("nation").agg(F.map_from_entries(F.collect_list(F.struct("day", "v"))).alias("by_day")).crossJoin(F.broadcast(ends))
    return some.select("nation", F.transform(F.sequence("low", "high"), lambda d: F.coalesce(F.try_element_at("by_day", d), F.lit(0.0))).alias("spectrum"))


def _dual_sql(components: int = 2) -> str:
    """The same axes from products between nations: squared 14 times, scaled, and the first taken off."""
    parts = [f"d AS MATERIALIZED ({_DAILY})", "na AS (SELECT DISTINCT nation FROM d)", "nn AS (SELECT count(*) AS n FROM na)",
             "me AS (SELECT day, sum(v) / (SELECT n FROM nn) AS m FROM d GROUP BY 1)", "cz AS MATERIALIZED (SELECT nation, day, coalesce(v, 0) - m AS v FROM na CROSS JOIN me LEFT JOIN d USING (nation, day))",
             "c1 AS MATERIALIZED (SELECT a.nation AS i, b.nation AS j, sum(a.v * b.v) AS v FROM cz a JOIN cz b USING (day) GROUP BY ALL)"]
    for k in range(1, components + 1):
        parts.append(f"s{k}_0 AS (SELECT i, j, v / sum(v) FILTER (i = j) OVER () AS v FROM c{k})")
        for m in range(14):
            parts.append(f"s{k}_{m + 1} AS MATERIALIZED (SELECT i, j, v / sum(v) FILTER (i = j) OVER () AS v FROM (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM s{k}_{m} a JOIN s{k}_{m} b ON a.j = b.i GROUP BY ALL))")
        parts.append(f"u{k} AS MATERIALIZED (SELECT i, v / sqrt(sum(v * v) OVER ()) AS u FROM s{k}_14 WHERE j = (SELECT arg_max(i, v) FROM s{k}_14 WHERE i = j))")
        parts.append(f"e{k} AS MATERIALIZED (SELECT sum(c.v * a.u * b.u) AS e FROM c{k} c JOIN u{k} a ON a.i = c.i JOIN u{k} b ON b.i = c.j)")
        parts.append(f"g{k} AS (SELECT sign(arg_max(w, abs(w))) AS g FROM (SELECT day, sum(v * u) AS w FROM cz JOIN u{k} ON i = nation GROUP BY 1))")
        parts.append(f"c{k + 1} AS MATERIALIZED (SELECT c.i, c.j, c.v - (SELECT e FROM e{k}) * a.u * b.u AS v FROM c{k} c JOIN u{k} a ON a.i = c.i JOIN u{k} b ON b.i = c.j)")
    return ", ".join(parts)


@register(f"WITH {_dual_sql()} SELECT u1.i AS nation, round(u1.u * sqrt(e1.e) * g1.g, 6) + 0.0 AS score_1, round(u2.u * sqrt(e2.e) * g2.g, 6) + 0.0 AS score_2, round((u1.u ** 2 + u2.u ** 2) * (n - 1), 6) AS t2, round(c.v - u1.u ** 2 * e1.e - u2.u ** 2 * e2.e, 6) + 0.0 AS q, round((e1.e + e2.e) / (SELECT sum(v) FROM c1 WHERE i = j), 6) AS share FROM u1 JOIN u2 USING (i) JOIN c1 c ON c.i = u1.i AND c.j = u1.i CROSS JOIN e1 CROSS JOIN e2 CROSS JOIN g1 CROSS JOIN g2 CROSS JOIN nn")
def wide_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two components of thousands of channels, without a matrix of channels by channels."""
    rows = materialize(daily(spark, sf_dir), "daily")  # every pass reads it
    model = wide.principal(rows, 2)
    found = wide.scores(rows, model, key="nation")
    return rounded(found.select("nation", F.get("scores", F.lit(0)).alias("score_1"), F.get("scores", F.lit(1)).alias("score_2"), "t2", "q", F.lit(float(model.shares.sum())).alias("share")))


_THREE = "round({0}, CAST(2 - floor(log10(abs({0}))) AS INT))"


@register(_FOLDED + f""", st AS (SELECT sample, pos, (v - avg(v) OVER k) / stddev_samp(v) OVER k AS v FROM ch WINDOW k AS (PARTITION BY pos)), sy AS (SELECT avg(y) AS m, stddev_samp(y) AS s FROM sp),
wa AS (SELECT pos, sum(v * (y - m) / s) AS c FROM st JOIN sp USING (sample) CROSS JOIN sy GROUP BY pos), ww AS (SELECT pos, c / sqrt(sum(c * c) OVER ()) AS w FROM wa), ta AS (SELECT sample, sum(v * w) AS t FROM st JOIN ww USING (pos) GROUP BY 1),
qa AS (SELECT sum(t * (y - m) / s) / sum(t * t) AS q FROM ta JOIN sp USING (sample) CROSS JOIN sy), fa AS (SELECT sqrt(avg((m + s * q * t - y) ** 2)) AS rmsec, 1 - sum((m + s * q * t - y) ** 2) / (count(*) * var_pop(y)) AS r2 FROM ta JOIN sp USING (sample) CROSS JOIN sy CROSS JOIN qa),
va AS (SELECT count(*) AS n, sqrt(avg((predicted - y) ** 2)) AS rmsecv, avg(predicted - y) AS bias, 1 - sum((predicted - y) ** 2) / (count(*) * var_pop(y)) AS r2cv FROM p)
SELECT n, 64::BIGINT AS channels, {_THREE.format('rmsec')} AS rmsec, round(r2, 3) AS r2, {_THREE.format('rmsecv')} AS rmsecv, round(r2cv, 3) AS r2cv, {_THREE.format('bias')} AS bias FROM va CROSS JOIN fa""")
def methods_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers read back from the paragraph on a calibration of one latent variable."""
    rows = spectra(spark, sf_dir)
    model = gram.pls(gram.moments(rows)[None], 1)
    e = model.predict(F.col("spectrum"), 1) - F.col("y")
    fit = rows.agg(F.sqrt(F.avg(e * e)).alias("rmsec"), (1 - F.sum(e * e) / (F.count("*") * F.var_pop("y"))).alias("r2"))
    found = validate.cross_validate(rows, 1, groups="grp").crossJoin(fit).withColumns({"method": F.lit("pls"), "channels": F.lit(model.coef.shape[1]), "chain": F.lit(None).cast("string"), "components": F.lit(1)})
    text = report.methods_text(found)
    read = lambda pattern, kind="double": F.regexp_extract("text", pattern, 1).cast(kind)
    number = r"(-?[0-9.]+(?:e[-+]?[0-9]+)?)"
    return text.select(read(r"used (\d+) samples", "long").alias("n"), read(r"of (\d+) channels", "long").alias("channels"), read(f"RMSEC {number}").alias("rmsec"), read(f"RMSEC [^,]*, R2 {number};").alias("r2"), read(f"RMSECV {number}").alias("rmsecv"), read(f"RMSECV [^,]*, R2 {number},").alias("r2cv"), read(r"bias [+]?" + number + r"\.").alias("bias"))
