"""Queries on mixtures, patterns, structures, designs and parsed text. Small structures are written out in SQL."""

from __future__ import annotations

import math
import struct

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import cif_field, cif_number
from ..operators import design, graph, long_traces, mixture, pattern, review, scattering, spatial, structure, validate
from ..sources import readers, spc
from .adapters import SPECTRA_SQL, rounded, spectra, table
from .catalogue import register

def _views(spark: SparkSession, sf_dir: str) -> SparkSession:
    """spark, with the tables that make up the queries' inputs as views."""
    for name in ("part", "supplier"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark


# --- mixtures: hour-of-day profiles of event types

_PROFILE = "SELECT event_type, hour(ts) AS h, avg(value) AS v FROM events GROUP BY ALL"


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event type's profile as a product, the first two types' profiles as parents a and b."""
    p = table(spark, sf_dir, "events").groupBy("event_type", F.hour("ts").alias("h")).agg(F.avg("value").alias("v"))
    kinds = p.select("event_type").distinct().withColumn("k", F.row_number().over(Window.orderBy("event_type")))  # one row per type
    side = lambda k, name: p.join(F.broadcast(kinds.filter(F.col("k") == k)), "event_type").select("h", F.col("v").alias(name))
    return p.withColumnRenamed("v", "product").join(side(1, "a"), "h").join(side(2, "b"), "h")


_PARENTS = f"""p AS ({_PROFILE}), kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM p)),
x AS (SELECT p.event_type, p.h, p.v AS product, a.v AS a, b.v AS b FROM p JOIN p a ON a.h = p.h JOIN kinds ka ON ka.event_type = a.event_type AND ka.k = 1 JOIN p b ON b.h = p.h JOIN kinds kb ON kb.event_type = b.event_type AND kb.k = 2)"""

_UNMIXED = _PARENTS + """, s AS (SELECT event_type, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * product) AS ay, sum(b * product) AS bq FROM x GROUP BY 1),
f AS (SELECT *, (ay * bb - bq * ab) / (aa * bb - ab * ab) AS fa, (bq * aa - ay * ab) / (aa * bb - ab * ab) AS fb, greatest(0, ay / aa) AS oa, greatest(0, bq / bb) AS ob FROM s),
w AS (SELECT event_type, CASE WHEN fa >= 0 AND fb >= 0 THEN fa WHEN oa * ay >= ob * bq THEN oa ELSE 0 END AS scale_a, CASE WHEN fa >= 0 AND fb >= 0 THEN fb WHEN oa * ay >= ob * bq THEN 0 ELSE ob END AS scale_b FROM f)"""


@register(f"WITH {_UNMIXED} SELECT event_type, round(scale_a, 6) + 0.0 AS scale_a, round(scale_b, 6) + 0.0 AS scale_b, round(scale_a / (scale_a + scale_b), 6) + 0.0 AS part_a, round(scale_b / (scale_a + scale_b), 6) + 0.0 AS part_b FROM w")
def nnls_two_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mixture.unmix_two(_parents(spark, sf_dir), ["event_type"], "product", "a", "b"))


@register(f"""WITH {_UNMIXED}, e AS (SELECT event_type, h, product, product - scale_a * a - scale_b * b AS v FROM x JOIN w USING (event_type)),
m AS (SELECT event_type, .05 * max(abs(product)) AS least, min(product) > 1e-3 * max(product) AS poisson, sqrt(sum(v ** 2) / sum(product ** 2)) AS ru, sqrt(sum(v ** 2 / greatest(product, 1e-6)) / sum(product ** 2 / greatest(product, 1e-6))) AS rp FROM e GROUP BY 1),
k AS (SELECT event_type, h, v, lag(v) OVER o AS b, lead(v) OVER o AS n FROM e WINDOW o AS (PARTITION BY event_type ORDER BY h)),
c AS (SELECT k.event_type, count(*) FILTER (v > b AND v > n AND v >= least) AS n_new, count(*) FILTER (-v > -b AND -v > -n AND -v >= least) AS n_lost, max(v) FILTER (v > b AND v > n AND v >= least) AS highest FROM k JOIN m USING (event_type) GROUP BY 1)
SELECT event_type, CASE WHEN poisson THEN 'poisson' ELSE 'unit' END AS weight, round(CASE WHEN poisson THEN rp ELSE ru END, 6) AS rwp, CAST(n_new AS INT) AS n_new, CAST(n_lost AS INT) AS n_lost, round(highest, 6) AS highest,
       CASE WHEN n_new > 0 THEN 'new_signal' ELSE 'sum_of_parents' END AS verdict FROM m JOIN c USING (event_type)""")
def phase_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parents(spark, sf_dir).withColumn("h", F.col("h").cast("long"))
    found = mixture.phase_report(rows, ["event_type"], "product", "a", "b", "h")
    highest = F.get("new_peaks", F.lit(0))["height"].alias("highest")
    return rounded(found.select("event_type", "weight", "rwp", F.size("new_peaks").alias("n_new"), F.size("lost_peaks").alias("n_lost"), highest, "verdict"))


@register("""WITH s AS (SELECT sum(l_quantity * l_quantity) AS aa, sum(l_quantity * l_discount) AS ab, sum(l_quantity * l_tax) AS ac, sum(l_discount * l_discount) AS bb, sum(l_discount * l_tax) AS bc, sum(l_tax * l_tax) AS cc,
  sum(l_quantity * l_extendedprice) AS ay, sum(l_discount * l_extendedprice) AS bt, sum(l_tax * l_extendedprice) AS ct FROM lineitem),
k AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det3, aa * bb - ab * ab AS dab, aa * cc - ac * ac AS dac, bb * cc - bc * bc AS dbc FROM s),
w AS (SELECT (ay * dbc - ab * (bt * cc - bc * ct) + ac * (bt * bc - bb * ct)) / det3 AS a, (aa * (bt * cc - bc * ct) - ay * (ab * cc - bc * ac) + ac * (ab * ct - bt * ac)) / det3 AS b,
        (aa * (bb * ct - bt * bc) - ab * (ab * ct - bt * ac) + ay * (ab * bc - bb * ac)) / det3 AS c FROM k
  UNION ALL SELECT (ay * bb - bt * ab) / dab, (bt * aa - ay * ab) / dab, 0 FROM k UNION ALL SELECT (ay * cc - ct * ac) / dac, 0, (ct * aa - ay * ac) / dac FROM k UNION ALL SELECT 0, (bt * cc - ct * bc) / dbc, (ct * bb - bt * bc) / dbc FROM k
  UNION ALL SELECT ay / aa, 0, 0 FROM k UNION ALL SELECT 0, bt / bb, 0 FROM k UNION ALL SELECT 0, 0, ct / cc FROM k),
g AS (SELECT w.a, w.b, w.c, 2 * (w.a * ay + w.b * bt + w.c * ct) - (w.a ** 2 * aa + w.b ** 2 * bb + w.c ** 2 * cc + 2 * (w.a * w.b * ab + w.a * w.c * ac + w.b * w.c * bc)) AS gain FROM w CROSS JOIN s WHERE w.a >= 0 AND w.b >= 0 AND w.c >= 0)
SELECT round(arg_max(a, gain) / arg_max(a + b + c, gain), 6) AS quantity, round(arg_max(b, gain) / arg_max(a + b + c, gain), 6) AS discount, round(arg_max(c, gain) / arg_max(a + b + c, gain), 6) AS tax FROM g""")
def nnls_many_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of three parents: the best of the seven active sets."""
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    parts = mixture.unmix(rows, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return rounded(spark.createDataFrame([tuple(float(parts[f"l_{c}"]) for c in ("quantity", "discount", "tax"))], "quantity double, discount double, tax double"))


_MAXIMA = """, q AS (SELECT *, lag(v) OVER o AS b, lead(v) OVER o AS n FROM {rows} WINDOW o AS (PARTITION BY {key} ORDER BY h)) SELECT {out} FROM q WHERE v > b AND v > n AND v >= {least}"""


@register(f"WITH {_PARENTS}, m AS (SELECT event_type, .05 * max(abs(product)) AS least FROM x GROUP BY 1), y AS (SELECT event_type, h, 'new' AS kind, product - a AS v FROM x UNION ALL SELECT event_type, h, 'lost', a - product FROM x), z AS (SELECT y.*, least FROM y JOIN m USING (event_type))" + _MAXIMA.format(rows="z", key="event_type, kind", out="event_type, kind, h, round(v, 6) AS height", least="least"))
def residual_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parents(spark, sf_dir).select("event_type", F.col("h").cast("long").alias("h"), "product", "a")
    return rounded(pattern.residual_peaks(rows, "event_type", "product", "a", "h"))


@register(f"WITH p AS ({_PROFILE})" + _MAXIMA.format(rows="p", key="event_type", out="event_type, h, round(v, 6) AS v", least="0"))
def profile_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").groupBy("event_type", F.hour("ts").cast("long").alias("h")).agg(F.avg("value").alias("v"))
    return rounded(pattern.local_maxima(p, "event_type", "h", "v"))


def thinned_sql(peaks: str, distance: int, key: str, v: str) -> str:
    """CTE th over `peaks` (key, pos, v): state 1 is kept, -1 removed; each round decides about the peaks that none higher near is undecided of."""
    near = f"q.{key} = p.{key} AND abs(q.pos - p.pos) < {distance}"
    return f"""th AS (SELECT {key}, pos, {v}, 0 AS state FROM {peaks} UNION ALL SELECT {key}, pos, {v}, state FROM (
  WITH k AS (SELECT p.*, NOT EXISTS (SELECT 1 FROM th q WHERE {near} AND q.state = 0 AND (q.{v} > p.{v} OR q.{v} = p.{v} AND q.pos > p.pos)) AS top FROM th p WHERE p.state = 0)
  SELECT p.{key}, p.pos, p.{v}, CASE WHEN p.top THEN 1 WHEN EXISTS (SELECT 1 FROM k q WHERE {near} AND q.top) THEN -1 ELSE 0 END AS state FROM k p))"""


@register(f"WITH RECURSIVE p AS ({_PROFILE}), pk AS (" + _MAXIMA.format(rows="p", key="event_type", out="event_type, h AS pos, v", least="0").removeprefix(", ").replace("q AS (", "WITH q AS (", 1) + f"), {thinned_sql('pk', 4, 'event_type', 'v')} SELECT event_type, pos AS h, round(v, 6) AS v FROM th WHERE state = 1")
def pxrd_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours are samples, so peaks four hours apart and more stay."""
    p = table(spark, sf_dir, "events").groupBy("event_type", F.hour("ts").cast("long").alias("h")).agg(F.avg("value").alias("v"))
    return rounded(long_traces.thinned(pattern.local_maxima(p, "event_type", "h", "v"), 4, "event_type", "v", "h"))


#: Acids and bases by rule, a pair for each part.
_PAIRS = "SELECT p_partkey AS id, CASE WHEN p_partkey % 9 <> 0 THEN p_partkey % 71 / 10e0 END AS a, p_size / 5e0 AS b FROM part"


@register(f"SELECT id, acid, base, round(base - acid, 6) AS gap, CASE WHEN base - acid > 3 THEN 'salt' WHEN base - acid < 0 THEN 'cocrystal' WHEN base - acid IS NOT NULL THEN 'continuum' END AS zone FROM (SELECT id, a AS acid, b AS base FROM ({_PAIRS}) t)")
def ionisation_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _views(spark, sf_dir).sql(f"SELECT id, a AS acid, b AS base FROM ({_PAIRS}) t")
    gap, zone = mixture.ionisation(F.col("acid"), F.col("base"))
    return rounded(rows.withColumn("gap", gap).withColumn("zone", zone))


_SHAPES = "SELECT p_partkey AS id, CAST(p_partkey * 37 % 1000 AS DOUBLE) / 100 AS short, CAST(p_partkey * 91 % 1000 AS DOUBLE) / 100 AS middle, CAST(p_size AS DOUBLE) AS dipole FROM part"


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(n.alias("id"), ((n * 37 % 1000).cast("double") / 100).alias("short"), ((n * 91 % 1000).cast("double") / 100).alias("middle"), F.col("p_size").cast("double").alias("dipole"))


@register(f"WITH s AS ({_SHAPES}) SELECT l.id AS l_id, r.id AS r_id FROM s l JOIN s r ON l.id < r.id AND abs(l.short - r.short) <= .2::DOUBLE AND abs(l.middle - r.middle) <= .2::DOUBLE AND abs(l.dipole - r.dipole) <= 4")
def complementarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _shapes(spark, sf_dir)
    return mixture.complementary_pairs(s, s).filter("l.id < r.id").select(F.col("l.id").alias("l_id"), F.col("r.id").alias("r_id"))


@register("SELECT p_brand, count(*) AS n, round(median(p_retailprice), 6) AS price_median, round(stddev_pop(p_retailprice), 6) AS price_sd, round(median(p_size), 6) AS size_median, round(stddev_pop(p_size), 6) AS size_sd FROM part GROUP BY 1")
def conformer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand as the conformers of a molecule."""
    rows = table(spark, sf_dir, "part").select("p_brand", F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    return rounded(mixture.conformer_summary(rows, ["p_brand"], ["price", "size"]))


#: Functional groups: a supplier's part of a nation pair is a donor group, a customer an acceptor group.
_GROUPS = """d AS (SELECT s_nationkey % 5 AS pair, CAST(s_nationkey % 2 AS VARCHAR) AS molecule, s_name AS label, s_acctbal AS score FROM supplier),
a AS (SELECT c_nationkey % 5 AS pair, CAST(c_nationkey % 2 AS VARCHAR) AS molecule, c_name AS label, c_acctbal AS score FROM customer),
j AS (SELECT d.pair, d.score + a.score AS s, d.label AS dl, a.label AS al, d.molecule <> a.molecule AS hetero FROM d JOIN a USING (pair)),
bp AS (SELECT pair, max(s) AS score, arg_max(dl, s) AS donor, arg_max(al, s) AS acceptor, coalesce(max(s) FILTER (hetero) > 0 AND max(s) FILTER (hetero) >= coalesce(max(s) FILTER (NOT hetero), '-infinity'::DOUBLE), false) AS hetero_favoured FROM j GROUP BY pair)"""


def _pairings(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda name, p: table(spark, sf_dir, name).select((F.col(f"{p}_nationkey") % 5).alias("pair"), (F.col(f"{p}_nationkey") % 2).cast("string").alias("molecule"), F.col(f"{p}_name").alias("label"), F.col(f"{p}_acctbal").alias("score"))
    return mixture.best_pairing(side("supplier", "s"), side("customer", "c"), ["pair"])


@register(f"WITH {_GROUPS} SELECT pair, round(score, 6) AS score, donor, acceptor, hetero_favoured FROM bp")
def hbond_competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_pairings(spark, sf_dir))


@register(f"""WITH {_GROUPS}, s AS ({_SHAPES}), p AS (SELECT l.id AS pair, l.dipole / 5 AS acid, r.dipole / 5 AS base, abs(l.short - r.short) <= .2::DOUBLE AND abs(l.middle - r.middle) <= .2::DOUBLE AND abs(l.dipole - r.dipole) <= 4 AS complementary FROM s l JOIN s r ON r.id = l.id + 100)
SELECT p.pair, round(base - acid, 6) AS pka_gap, CASE WHEN base - acid > 3 THEN 'salt' WHEN base - acid < 0 THEN 'cocrystal' ELSE 'continuum' END AS zone, complementary, CAST(hetero_favoured AS VARCHAR) AS hetero_favoured FROM p LEFT JOIN bp ON bp.pair = p.pair""")
def predictor_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _shapes(spark, sf_dir)
    l, r = s.select(F.struct("*").alias("l")), s.select(F.struct("*").alias("r"))
    pairs = l.join(r, F.col("r.id") == F.col("l.id") + 100).select(F.col("l.id").alias("pair"), (F.col("l.dipole") / 5).alias("pka_acid"), (F.col("r.dipole") / 5).alias("pka_base"), "l", "r")
    return rounded(mixture.predictors(pairs, _pairings(spark, sf_dir)).select("pair", "pka_gap", "zone", "complementary", F.col("hetero_favoured").cast("string").alias("hetero_favoured")))


# --- patterns: a cubic cell of 5 angstrom

_CELL, _WAVE = (5.0, 5.0, 5.0, 90.0, 90.0, 90.0), 1.540598
_HKL = f"""g AS (SELECT CAST(x.h AS INT) AS h, CAST(y.h AS INT) AS k, CAST(z.h AS INT) AS l FROM generate_series(-4, 4) x(h), generate_series(-4, 4) y(h), generate_series(-4, 4) z(h)),
r AS (SELECT *, 5 / sqrt(h * h + k * k + l * l) AS d FROM g WHERE h <> 0 OR k <> 0 OR l <> 0), t AS (SELECT h, k, l, d, 2 * degrees(asin({_WAVE} / (2 * d))) AS two_theta FROM r WHERE 2 * d >= {_WAVE})"""


@register(f"WITH {_HKL} SELECT h, k, l, round(d, 6) AS d, round(two_theta, 6) AS two_theta FROM t WHERE two_theta BETWEEN 5 AND 50")
def reflections_hkl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pattern.reflections(spark, _CELL, _WAVE, 5, 50))


#: Peaks by rule, one for each part.
_PEAKS = "SELECT DISTINCT 5 + p_partkey * 7 % 4500 / 100e0 AS a, CAST(p_retailprice AS DOUBLE) AS b FROM part"


@register(f"""WITH {_HKL}, p AS (SELECT a AS peak, b AS height FROM ({_PEAKS}) ORDER BY b DESC, a LIMIT 25),
j AS (SELECT peak, height, h, k, l, row_number() OVER (PARTITION BY peak, height ORDER BY abs(h) + abs(k) + abs(l), round(abs(two_theta - peak), 6), h, k, l) AS n FROM p LEFT JOIN t ON abs(two_theta - peak) <= .10)
SELECT peak, height, CASE WHEN h IS NULL THEN '?' ELSE h || ' ' || k || ' ' || l END AS hkl FROM j WHERE n = 1""")
def peak_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest 25 peaks, which the report names."""
    peaks = _views(spark, sf_dir).sql(f"SELECT a AS two_theta, b AS height FROM ({_PEAKS}) v")
    return pattern.index_peaks(peaks, pattern.reflections(spark, _CELL, _WAVE, 5, 50))


@register(f"WITH {_HKL}, p AS (SELECT DISTINCT a AS two_theta FROM ({_PEAKS})) SELECT p.two_theta, round(min(abs(t.two_theta - p.two_theta)), 6) AS gap, min(abs(t.two_theta - p.two_theta)) <= .05 AS ok FROM p, t WHERE t.two_theta BETWEEN 5 AND 50 GROUP BY 1")
def bragg_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = _views(spark, sf_dir).sql(f"SELECT DISTINCT a AS two_theta FROM ({_PEAKS}) v")
    near = pattern.nearest(peaks, pattern.reflections(spark, _CELL, _WAVE, 5, 50))
    return rounded(near.withColumn("ok", F.col("gap") <= 0.05))


#: A line for each size of part, as strong as parts have it.
_LINES = "SELECT 21 + 3e0 * p_size AS a, CAST(count(*) AS DOUBLE) AS b FROM part GROUP BY p_size"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir).sql(f"SELECT a AS two_theta, b AS intensity FROM ({_LINES}) v")


_DOUBLET = f"""i AS (SELECT a AS two_theta, b AS intensity FROM ({_LINES})), s AS (SELECT *, sin(radians(two_theta / 2)) * 1.544426 / 1.540598 AS z FROM i),
e AS (SELECT 1 AS line, two_theta, intensity FROM i UNION ALL SELECT 2, 2 * degrees(asin(CASE WHEN z < 1 THEN z END)), intensity * .5 FROM s WHERE z < 1)"""


@register(f"WITH {_DOUBLET} SELECT line, round(two_theta, 6) AS two_theta, intensity FROM e")
def kalpha2_doublet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pattern.doublet(_lines(spark, sf_dir)))


@register("SELECT p_partkey AS id, r, round(pow(r * r * cos(p_size / 31e0) ** 2 + sin(p_size / 31e0) ** 2 / r, -1.5), 6) AS factor FROM part CROSS JOIN (SELECT CAST(unnest([.5, 1, 2]) AS DOUBLE) AS r)")
def march_dollase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three strengths of preference at an angle for each part."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 31).alias("angle"))
    one = lambda r: F.struct(F.lit(r).alias("r"), F.round(pattern.march_dollase(F.col("angle"), r), 6).alias("factor"))
    return part.select("id", F.explode(F.array(one(0.5), one(1.0), one(2.0))).alias("v")).select("id", "v.*")


@register("SELECT p_partkey AS id, x AS two_theta, round(sqrt(greatest(.01 * tan(radians(x / 2.0)) ** 2 - .005 * tan(radians(x / 2.0)) + .008, 1e-6)), 6) AS fwhm FROM (SELECT p_partkey, p_size * 3 AS x FROM part)")
def caglioti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 3).alias("two_theta"))
    return rounded(rows.withColumn("fwhm", pattern.caglioti(F.col("two_theta"))))


_GRID = "SELECT 5 + i * .05 AS x FROM generate_series(0, 900) g(i)"


@register(f"""WITH {_DOUBLET}, w AS (SELECT *, sqrt(greatest(.01 * tan(radians(two_theta / 2)) ** 2 - .005 * tan(radians(two_theta / 2)) + .008, 1e-6)) AS f FROM e),
g AS (SELECT CAST(x AS DOUBLE) AS x FROM ({_GRID})), v AS (SELECT x, sum(intensity * (.5 * (2 / (pi() * f)) / (1 + 4 * ((x - two_theta) / f) ** 2) + .5 * (2 / f) * sqrt(ln(2) / pi()) * exp(-4 * ln(2) * ((x - two_theta) / f) ** 2))) AS v
FROM g JOIN w ON x >= two_theta - 40 * f AND x < two_theta + 40 * f GROUP BY x) SELECT round(g.x, 4) AS x, round(coalesce(100 * v / max(v) OVER (), 0), 6) AS y FROM g LEFT JOIN v USING (x)""")
def simulate_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(901).select((5 + F.col("id") * 0.05).alias("x"))
    return pattern.simulate(pattern.doublet(_lines(spark, sf_dir)), grid).select(F.round("x", 4).alias("x"), F.round("y", 6).alias("y"))


@register("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'middle' ELSE 'large' END AS class FROM lineitem WHERE l_quantity >= 1 AND l_quantity < 51")
def range_join_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = spark.sql("SELECT * FROM VALUES ('small', 1D, 10D), ('middle', 10D, 30D), ('large', 30D, 51D) AS c(class, lo, hi)")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return spatial.range_join(rows, classes, "l_quantity", F.col("lo"), F.col("hi"), 10.0).select("l_orderkey", "l_linenumber", "class")


# --- structures: parts as atoms of one structure, 0.05 to a cubic angstrom, in fractions of a cell of ten; inversion symmetry

_ATOMS = """SELECT p_partkey, concat(CASE p_partkey % 8 WHEN 0 THEN 'N' WHEN 1 THEN 'C' WHEN 2 THEN 'H' WHEN 3 THEN 'O' WHEN 4 THEN 'C' WHEN 5 THEN 'H' WHEN 6 THEN 'C' ELSE 'O' END, CAST(p_partkey AS VARCHAR(20))),
 CASE p_partkey % 8 WHEN 0 THEN 'N' WHEN 1 THEN 'C' WHEN 2 THEN 'H' WHEN 3 THEN 'O' WHEN 4 THEN 'C' WHEN 5 THEN 'H' WHEN 6 THEN 'C' ELSE 'O' END,
 e * ((p_partkey * 61 + p_partkey * p_partkey) % 997 / 997e0), e * ((p_partkey * 101 + p_partkey * p_partkey * 3) % 991 / 991e0), e * ((p_partkey * 37 + p_partkey * p_partkey * 7) % 983 / 983e0),
 CASE WHEN p_partkey % 11 = 0 THEN 5e-1 ELSE 1e0 END, CASE WHEN p_partkey % 11 = 0 THEN CAST(FLOOR(p_partkey / 100e0) AS VARCHAR(20)) END, CASE WHEN p_partkey % 11 = 0 THEN CAST(p_partkey % 2 AS VARCHAR(20)) END
 FROM part CROSS JOIN (SELECT power(count(*) / 5e-2, 1 / 3e0) / 10 AS e FROM part) n"""
_BOX = (10.0, 10.0, 10.0, 90.0, 90.0, 90.0)
_ATOM_COLUMNS = "idx, label, sym, x, y, z, occ, assembly, grp"
_A = f"a AS (SELECT idx, label, sym, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, CAST(occ AS DOUBLE) AS occ, assembly, grp FROM ({_ATOMS}) v({_ATOM_COLUMNS}))"


def _atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir).sql(f"SELECT * FROM ({_ATOMS}) AS v({_ATOM_COLUMNS})")


_EXPANDED = f"""{_A}, i AS (SELECT idx, label, sym, occ, s AS op, round(x * f - floor(x * f + 1e-9), 9) AS x, round(y * f - floor(y * f + 1e-9), 9) AS y, round(z * f - floor(z * f + 1e-9), 9) AS z FROM a, (VALUES (0, 1), (1, -1)) o(s, f)),
n AS (SELECT *, row_number() OVER (PARTITION BY sym, CAST(round(100 * x) AS INT) % 100, CAST(round(100 * y) AS INT) % 100, CAST(round(100 * z) AS INT) % 100 ORDER BY idx, op) AS k FROM i), ex AS (SELECT * FROM n WHERE k = 1)"""


def _expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.expand(_atoms(spark, sf_dir), structure.symmetry_ops(spark, ["x,y,z", "-x,-y,-z"]))


@register(f"WITH {_EXPANDED} SELECT label, sym, op, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM ex")
def symmetry_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_expanded(spark, sf_dir).select("label", "sym", "op", "x", "y", "z"))


@register(f"WITH {_EXPANDED} SELECT sym, round(sum(occ), 6) AS n FROM ex GROUP BY sym")
def element_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(structure.element_counts(_expanded(spark, sf_dir)))


_MASS = "CASE sym WHEN 'H' THEN 1.008 WHEN 'C' THEN 12.011 WHEN 'N' THEN 14.007 WHEN 'O' THEN 15.999 END"


@register(f"WITH {_EXPANDED}, m AS (SELECT 1.66054 * sum(occ * {_MASS}) / 1000 AS d FROM ex) SELECT round(d, 6) AS from_cell, round(1.66042 * 90 * 2 / 1000, 6) AS from_formula, 30e-2 AS declared, CASE WHEN abs(d / (1.66042 * .18) - 1) <= .03 THEN CASE WHEN abs(1.66042 * .18 / .3 - 1) <= .03 THEN 'agree' ELSE 'declared is off' END WHEN abs(d / .3 - 1) <= .03 THEN 'formula is off' WHEN abs(1.66042 * .18 / .3 - 1) <= .03 THEN 'atoms are missing or too many' ELSE 'none agree' END AS verdict FROM m")
def density_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(structure.density_check(_expanded(spark, sf_dir), 1000.0, 90.0, 2, 0.30))


_CELL_OF = "SELECT s_suppkey AS id, 5 + s_suppkey % 40 / 10e0 AS a, 6 + s_suppkey % 30 / 10e0 AS b, 7 + s_suppkey % 20 / 10e0 AS c, 70 + s_suppkey % 31 * 1e0 AS al, 75 + s_suppkey % 29 * 1e0 AS be, 80 + s_suppkey % 37 * 1e0 AS ga FROM supplier"


@register(f"SELECT id, round(a * b * c * sqrt(1 - cos(radians(al)) ** 2 - cos(radians(be)) ** 2 - cos(radians(ga)) ** 2 + 2 * cos(radians(al)) * cos(radians(be)) * cos(radians(ga))), 6) AS volume FROM ({_CELL_OF})")
def cell_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell for each supplier."""
    rows = _views(spark, sf_dir).sql(_CELL_OF)
    return rounded(rows.select("id", structure.cell_volume(*[F.col(c) for c in ("a", "b", "c", "al", "be", "ga")]).alias("volume")))


_COV = "CASE {0}.sym WHEN 'H' THEN .31 WHEN 'C' THEN .76 WHEN 'N' THEN .71 WHEN 'O' THEN .66 END"
_BONDS = f"""{_A}, p AS (SELECT i.idx AS i, j.idx AS j, i.label AS label_i, j.label AS label_j, i.sym AS si, j.sym AS sj, 10 * sqrt((i.x - j.x) ** 2 + (i.y - j.y) ** 2 + (i.z - j.z) ** 2) AS d, {_COV.format('i')} + {_COV.format('j')} AS e, i.occ AS oi, j.occ AS oj,
i.assembly = j.assembly AND i.grp <> j.grp AS alt FROM a i JOIN a j ON i.idx < j.idx), b AS (SELECT * FROM p WHERE d > .4 AND d <= e + .40 AND NOT (oi < 1 AND oj < 1 AND d < .90) AND NOT coalesce(alt, false))"""


def _bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = structure.to_cartesian(_atoms(spark, sf_dir), _BOX)
    return structure.bonds(atoms, structure.alternatives(atoms))


@register(f"WITH {_BONDS} SELECT label_i, label_j, round(d, 6) AS d, abs(d - e) > .25 AS outlying FROM b")
def bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_bonds(spark, sf_dir).select("label_i", "label_j", "d", "outlying"))


@register(f"""WITH RECURSIVE {_BONDS}, e AS (SELECT i AS u, j AS v FROM b UNION SELECT j, i FROM b), r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT a.label, CAST(least(a.idx, coalesce(min(r.v), a.idx)) AS INT) AS molecule FROM a LEFT JOIN r ON r.u = a.idx GROUP BY a.label, a.idx""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.components(_bonds(spark, sf_dir).select(F.col("i").alias("src"), F.col("j").alias("dst")))
    found = found.withColumnRenamed("label", "least")
    return _atoms(spark, sf_dir).join(found, F.col("idx") == F.col("node"), "left").select("label", F.coalesce("least", "idx").cast("int").alias("molecule"))


@register("""WITH RECURSIVE l AS (SELECT s_suppkey AS u, s_suppkey + 1 AS v FROM supplier WHERE s_suppkey % 4 <> 3), e AS (SELECT u, v FROM l UNION SELECT v, u FROM l), r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u) SELECT u AS src, v AS dst FROM r WHERE u <> v""")
def disorder_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of up to four suppliers, each linked to the next."""
    n = F.col("s_suppkey")
    return graph.closure(table(spark, sf_dir, "supplier").filter("s_suppkey % 4 <> 3").select(n.alias("src"), (n + 1).alias("dst")))


@register("""WITH e AS (SELECT o_custkey AS u, -(o_orderkey % 40) - 1 AS v FROM orders), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
s0 AS (SELECT min(u) AS node FROM e), s1 AS (SELECT DISTINCT v AS node FROM b JOIN s0 ON u = node WHERE v NOT IN (SELECT node FROM s0)),
s2 AS (SELECT DISTINCT v AS node FROM b JOIN s1 ON u = node WHERE v NOT IN (SELECT node FROM s0 UNION ALL SELECT node FROM s1))
SELECT node, 0 AS shell FROM s0 UNION ALL SELECT node, 1 FROM s1 UNION ALL SELECT node, 2 FROM s2""")
def growth_shells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and groups of their orders as a graph, grown two steps from the first customer."""
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), (-(F.col("o_orderkey") % 40) - 1).alias("dst"))
    return graph.shells(edges, edges.agg(F.min("src").alias("node")), 2)


_NEUTRON = "CASE s WHEN 'N' THEN 1.009 WHEN 'O' THEN .983 END"


@register(f"""WITH {_A}, c AS MATERIALIZED (SELECT idx, label, sym, 10 * x AS x, 10 * y AS y, 10 * z AS z FROM a),
n AS (SELECT h.idx AS h, h.label AS hydrogen, d.idx AS d_idx, d.label AS donor, d.sym AS s, d.x, d.y, d.z, h.x - d.x AS ux, h.y - d.y AS uy, h.z - d.z AS uz, sqrt((h.x - d.x) ** 2 + (h.y - d.y) ** 2 + (h.z - d.z) ** 2) AS dh FROM c h JOIN c d ON h.sym = 'H' AND d.sym <> 'H' AND abs(h.x - d.x) <= 2),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY dh, d_idx) AS k FROM n WHERE dh <= 2) WHERE k = 1 AND s IN ('N', 'O') AND dh > .4 AND dh <= CASE s WHEN 'N' THEN .71 ELSE .66 END + .31 + .4),
p AS (SELECT o.*, r.label AS acceptor, r.sym AS t, r.x - o.x AS ax, r.y - o.y AS ay, r.z - o.z AS az, sqrt((r.x - o.x) ** 2 + (r.y - o.y) ** 2 + (r.z - o.z) ** 2) AS da, {_NEUTRON} / dh AS g FROM o JOIN c r ON r.sym IN ('N', 'O') AND r.idx <> o.d_idx AND abs(r.x - o.x) <= 4),
q AS (SELECT *, sqrt((ax - g * ux) ** 2 + (ay - g * uy) ** 2 + (az - g * uz) ** 2) AS ha FROM p WHERE da >= .4 AND da <= 4),
w AS (SELECT *, degrees(acos(greatest(-1, least(1, -(g * ux * (ax - g * ux) + g * uy * (ay - g * uy) + g * uz * (az - g * uz)) / (g * dh * ha))))) AS angle FROM q)
SELECT donor, hydrogen, acceptor, CASE WHEN ha > CASE t WHEN 'N' THEN 1.55 ELSE 1.52 END + 1.2 THEN 'far' WHEN angle >= 120 THEN 'hbond' WHEN angle >= 90 THEN 'contact' ELSE 'bent' END AS kind, CASE WHEN da < 2.2 THEN 'long' WHEN da < 2.5 THEN 'strong' WHEN da < 3.2 THEN 'moderate' WHEN da < 4 THEN 'weak' ELSE 'long' END AS strength FROM w""")
def hbonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = structure.to_cartesian(_atoms(spark, sf_dir), _BOX)
    return structure.hydrogen_bonds(atoms).select("donor", "hydrogen", "acceptor", "kind", "strength")


@register("SELECT p_partkey, p_retailprice AS d FROM part WHERE EXISTS (SELECT 1 FROM supplier WHERE abs(s_acctbal - p_retailprice) < .03::DOUBLE)")
def xref_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices with a balance within three hundredths."""
    found = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("d"))
    return structure.matching(found, table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("d")), "d")


@register(f"WITH {_A} SELECT DISTINCT sym FROM a WHERE sym NOT IN ('H', 'C', 'O')")
def missing_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.missing_elements(_atoms(spark, sf_dir), spark.sql("SELECT * FROM VALUES ('H'), ('C'), ('O') AS k(sym)"))


# --- designs, parsing, lint

_REPS, _WHO = 3, ["ann", "bob"]
_PLAN = "d AS (SELECT DISTINCT l_discount AS level FROM lineitem), l AS (SELECT level, row_number() OVER (ORDER BY level) - 1 AS i, count(*) OVER () AS n FROM d), p AS (SELECT l.i, level, n, r, CASE (r + l.i) % 2 WHEN 0 THEN 'ann' ELSE 'bob' END AS operator FROM l CROSS JOIN generate_series(0, 2) g(r))"


def _plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Runs at the discounts in use, some ten levels, and their number."""
    levels = sorted(r["l_discount"] for r in table(spark, sf_dir, "lineitem").select("l_discount").distinct().collect())
    return design.schedule(spark, levels, _REPS, _WHO, ["i1"]), _REPS * len(levels)


@register(f"WITH {_PLAN} SELECT CAST(r * n + i AS INT) AS place, level, CAST(r + 1 AS INT) AS rep, operator, 'i1' AS instrument FROM p")
def run_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)[0]


@register(f"WITH {_PLAN} SELECT operator, level, count(*) AS n FROM p GROUP BY ALL")
def run_order_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design.balance(_plan(spark, sf_dir)[0])


@register(f"WITH {_PLAN} SELECT CAST(count(*) AS INT) AS n, CAST(count(*) AS INT) AS different, 1 AS first, CAST(count(*) AS INT) AS last FROM p")
def run_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, n = _plan(spark, sf_dir)
    plan = design.run_order(spark, plan, n, seed=7)
    return plan.agg(F.count("*").cast("int").alias("n"), F.count_distinct("run").cast("int").alias("different"), F.min("run").alias("first"), F.max("run").alias("last"))


@register("SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', lang, source, text)), 'public license')")
def identity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("name"), F.col("source").alias("title"), F.col("text").alias("moiety"))
    return docs.filter(readers.identity_matches("Public License")).select("doc_id")


#: Figures of merit followed by a number, or a number after plus or minus.
MERIT = r"(?i)(?:version|slope|r2|rmse|lod|loq|token)[^\n0-9]{0,12}?[=:~ ]\s*\"?[0-9]+(?:\.[0-9]+)?"


@register(f"SELECT * FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '{MERIT}')) AS INT) AS hits FROM documents) WHERE hits > 0")
def fom_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.size(F.regexp_extract_all("text", F.lit(MERIT), F.lit(0)))
    return table(spark, sf_dir, "documents").select("doc_id", hits.alias("hits")).filter("hits > 0")


@register("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@register("SELECT s_suppkey AS id, CAST(s_suppkey AS VARCHAR) AS file, concat('C', 2 + s_suppkey % 5, ' H', 1 + s_suppkey % 9, ' O') AS formula, CAST(4 + s_suppkey % 5 + s_suppkey % 9 AS DOUBLE) AS atoms FROM supplier UNION ALL SELECT s_suppkey, 'b', 'Fe2 O3', 5 FROM supplier WHERE s_suppkey % 3 = 0")
def json_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results as text, one for each supplier: a list or a list in an object, with a record that has no file."""
    n = F.col("s_suppkey")
    record = F.concat(F.lit('{"file": "'), n, F.lit('", "formula": "- C'), 2 + n % 5, F.lit(" H"), 1 + n % 9, F.lit(' O -"}, {"formula": "x"}'), F.when(n % 3 == 0, ', {"file": "b", "formula": "Fe2 O3"}').otherwise(""))
    text = F.when(n % 2 == 0, F.concat(F.lit("["), record, F.lit("]"))).otherwise(F.concat(F.when(n % 3 == 0, '{"data": [').otherwise('{"result": ['), record, F.lit("]}")))
    rows = readers.json_records(table(spark, sf_dir, "supplier").select(n.alias("id"), text.alias("text")), "text", "file:string,formula:string", "file")
    rows = rows.withColumn("formula", F.trim(F.regexp_replace("formula", r"^\s*-|-\s*$", "")))
    return rows.withColumn("atoms", F.aggregate(F.map_values(readers.formula_counts(F.col("formula"))), F.lit(0.0), lambda s, v: s + v))


@register("SELECT s_suppkey AS id, 'Form ' || s_name AS name, 'A long title of ' || s_suppkey AS title, '' AS note, CAST(5 + s_suppkey % 1000 / 1e3 AS DOUBLE) AS a FROM supplier")
def cif_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each supplier: a number with its error, a quoted value, a block of lines and an unknown one."""
    n = F.col("s_suppkey")
    text = F.concat(F.lit("data_x\n_cell_length_a "), F.format_string("%.3f(4)", 5 + n % 1000 / 1e3), F.lit("\n_chemical_name_common 'Form "), "s_name", F.lit("'\n_publ_section_title\n;\nA long\n title of "), n, F.lit("\n;\n_note ?\n"))
    t = table(spark, sf_dir, "supplier").select(n.alias("id"), text.alias("text"))
    f = lambda k: cif_field(F.col("text"), k)
    return t.select("id", f("_chemical_name_common").alias("name"), f("_publ_section_title").alias("title"), f("_note").alias("note"), cif_number(f("_cell_length_a")).alias("a"))


@register(f"WITH sp AS ({SPECTRA_SQL}) SELECT s.sample FROM sp s WHERE NOT EXISTS (SELECT 1 FROM sp t WHERE t.sample = s.sample AND t.grp IN (0, 1))")
def fold_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validate.folds(spectra(spark, sf_dir), "logo")
    return rows.join(rows.filter("fold in (0, 1)").select("sample"), "sample", "left_anti").select("sample")


_FINDING = "CASE WHEN l_discount > .09 AND l_tax > .07 THEN 'FAIL' WHEN l_discount > .08 THEN 'WARN' ELSE 'INFO' END"


@register(f"WITH f AS (SELECT l_suppkey, {_FINDING} AS s FROM lineitem) SELECT l_suppkey, CASE WHEN bool_or(s = 'FAIL') THEN 'FAIL' WHEN bool_or(s = 'WARN') THEN 'WARN' ELSE 'INFO' END AS severity, count(*) AS n FROM f GROUP BY 1")
def gate_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst severity of each supplier's findings."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.expr(_FINDING).alias("severity"))
    return review.worst(rows, ["l_suppkey"])


_CELLS = """SELECT p_partkey, 500.0 + p_partkey % 300 AS volume, 300.0 + p_partkey % 97 AS mass, 150.0 + p_partkey % 50 AS electrons, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 2.0 + p_partkey % 3 END AS z,
 CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 90.0 + p_partkey % 41 END AS weight, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(1.66 AS DOUBLE) * (300.0 + p_partkey % 97 + p_partkey % 4 * 12) / (500.0 + p_partkey % 300) END AS density,
 CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 150.0 + p_partkey % 61 END AS f000, 8.0 + p_partkey % 5 AS c, 4.0 + p_partkey % 7 AS o, p_partkey % 8 <> 0 AS has_formula FROM part"""
_CLOSE = "coalesce(abs(({0} - density) / nullif(density, 0)) < .03, false)"


@register(f"""WITH s AS ({_CELLS}), d AS (SELECT *, 1.66054 * mass / volume AS d1, 1.66042 * weight * z / volume AS d2, CASE WHEN has_formula THEN 12.011 * 4 + 15.999 * 2 END AS fw FROM s),
k AS (SELECT *, {_CLOSE.format('d1')} AS ok1, {_CLOSE.format('d2')} AS ok2, coalesce(fw > 0 AND abs(fw - weight) / weight > .01, false) AS off,
 coalesce(has_formula AND z > 0 AND abs(c - 4 * z) <= greatest(.05 * 4 * z, .15) AND abs(o - 2 * z) <= greatest(.05 * 2 * z, .15), false) AS match, coalesce(has_formula AND z > 0 AND c + o < 6 * z - .5, false) AS short FROM d),
b AS (SELECT *, CASE WHEN density IS NULL THEN 'not_declared' WHEN ok1 AND (ok2 OR d2 IS NULL) THEN 'consistent' WHEN d2 IS NOT NULL AND ok1 AND NOT ok2 THEN 'declared_off' WHEN NOT ok1 AND off AND match THEN 'weight_off'
 WHEN NOT ok1 AND short THEN 'atoms_missing' WHEN NOT ok1 AND match AND d2 IS NOT NULL AND ok2 THEN 'expansion_wrong' WHEN NOT ok1 THEN 'cell_off' ELSE 'pass' END AS branch, density / d2 AS r, coalesce(abs(electrons - f000) / f000 > .05, false) AS f000_off FROM k),
a AS (SELECT *, CASE WHEN r IS NULL THEN NULL WHEN r < .9 OR r > 1.1 THEN 'A' WHEN r < .95 OR r > 1.05 THEN 'B' WHEN r < .99 OR r > 1.01 THEN 'C' END AS alert FROM b)
SELECT p_partkey, round(d1, 6) AS density_cell, round(d2, 6) AS density_formula, branch, alert, f000_off, CASE WHEN branch = 'expansion_wrong' THEN 'FAIL' WHEN branch IN ('declared_off', 'weight_off', 'atoms_missing', 'cell_off') OR coalesce(alert IN ('A', 'B'), false) OR f000_off THEN 'WARN' ELSE 'INFO' END AS severity FROM a""")
def density_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up cells of carbon and oxygen, one for each part, of which some lack what is declared."""
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    s = spark.sql(_CELLS)
    s = s.select(*[F.col(c).cast("double").alias(c) if c != "p_partkey" else F.col(c) for c in ("p_partkey", "volume", "mass", "electrons", "z", "weight", "density", "f000", "c", "o")], "has_formula")
    s = s.withColumn("counts", F.create_map(F.lit("C"), "c", F.lit("O"), "o")).withColumn("formula", F.when(F.col("has_formula"), F.create_map(F.lit("C"), F.lit(4.0), F.lit("O"), F.lit(2.0))))
    return rounded(structure.density_review(s).select("p_partkey", "density_cell", "density_formula", "branch", "alert", "f000_off", "severity"))


# --- calculated intensities and binary spectra

_FACTORS = ", ".join(f"('{sym}', {', '.join(f'{v!r}::DOUBLE' for v in f)})" for sym, f in scattering.FORM_FACTORS.items())
_AMPLITUDES = f"""WITH {_HKL}, {_EXPANDED}, ff(sym, a1, b1, a2, b2, a3, b3, a4, b4, c) AS (VALUES {_FACTORS}),
s AS (SELECT *, 1 / (4 * d * d) AS s2 FROM t WHERE two_theta BETWEEN 5 AND 50),
w AS (SELECT h, k, l, two_theta, 2 * pi() * (h * x + k * y + l * z) AS p, occ * (a1 * exp(-b1 * s2) + a2 * exp(-b2 * s2) + a3 * exp(-b3 * s2) + a4 * exp(-b4 * s2) + c) AS v FROM s CROSS JOIN (SELECT sym, occ, x, y, z FROM ex) q JOIN ff USING (sym)),
f AS (SELECT h, k, l, two_theta, sqrt(sum(v * cos(p)) ** 2 + sum(v * sin(p)) ** 2) AS amplitude FROM w GROUP BY ALL),
y AS (SELECT *, amplitude ** 2 * (1 + cos(radians(two_theta)) ** 2) / (sin(radians(two_theta / 2)) ** 2 * cos(radians(two_theta / 2))) AS v FROM f)"""


def _amplitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scattering.with_amplitudes(pattern.reflections(spark, _CELL, _WAVE, 5, 50), _expanded(spark, sf_dir))


@register(_AMPLITUDES + " SELECT h, k, l, round(amplitude, 6) AS amplitude FROM y")
def structure_amplitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_amplitudes(spark, sf_dir).select("h", "k", "l", "amplitude"))


@register(_AMPLITUDES + ", m AS (SELECT round(two_theta, 4) AS two_theta, sum(v) AS v, count(*) AS reflections FROM y GROUP BY 1) SELECT two_theta, round(100 * v / max(v) OVER (), 6) AS intensity, reflections FROM m")
def powder_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scattering.powder_lines(_amplitudes(spark, sf_dir)))


@register("SELECT * FROM (VALUES ('even', 1e0, 5e-1, NULL), ('even', 2e0, -25e-2, NULL), ('even', 3e0, 1e0, NULL), ('text', NULL, NULL, 'not an SPC file of version 0x4B')) t(file, x, y, problem)")
def spc_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of three points, descending in x, with y as integers of 2^-30; and one that is no spectrum."""
    head = struct.pack("<BBBbiddi", 0, spc.VERSION, 0, 2, 3, 3.0, 1.0, 1).ljust(spc.HEADER, b"\0")
    raw = head + bytes(spc.TRACE_HEADER) + struct.pack("<3i", 1 << 30, -(1 << 28), 1 << 29)
    files = spark.createDataFrame([("even", bytearray(raw)), ("text", bytearray(b"1 2"))], "file string, content binary")
    return spc.parse_spc(files)
