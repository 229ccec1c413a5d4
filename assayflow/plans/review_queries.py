"""Queries that review structures and write reports. Small structures are written out in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration, review, structure
from .adapters import rounded, table
from .calibration_queries import _DOCUMENTS, _fit_sql, documents_by_lang
from .catalogue import register
from .structure_queries import _views

#: Wavelengths by rule, one for each supplier: near and off the standards, none, or from another source.
_WAVES = "SELECT s_suppkey AS id, CASE s_suppkey % 7 WHEN 1 THEN 154178e-5 WHEN 2 THEN 15406e-4 WHEN 3 THEN 8e-1 WHEN 4 THEN 7107e-4 WHEN 5 THEN 5605e-4 WHEN 6 THEN 9e-1 END AS v, CASE s_suppkey % 5 WHEN 1 THEN 'x-ray' WHEN 2 THEN 'Synchrotron' WHEN 3 THEN '' WHEN 4 THEN 'neutrons' END AS r FROM supplier"


@register(f"""WITH w AS (SELECT id, v, lower(coalesce(r, '')) AS r FROM ({_WAVES})), s(name, s) AS (VALUES ('Cu-Ka', 1.5418), ('Cu-Ka1', 1.5406), ('Mo', .71073), ('Ag', .56086), ('Ga', 1.3414), ('In', .51359)),
n AS (SELECT w.*, (SELECT arg_min(name, abs(w.v - s)) FROM s WHERE abs(w.v - s) < 5e-4) AS near FROM w), c AS (SELECT *, CASE WHEN v IS NULL THEN 'not_declared' WHEN regexp_matches(r, 'neutron|synchrotron|electron') THEN 'other_source' WHEN near IS NOT NULL THEN 'standard' ELSE 'unusual' END AS code FROM n)
SELECT id, code, CASE WHEN code = 'standard' THEN near END AS source, CASE WHEN code = 'unusual' THEN 'WARN' ELSE 'INFO' END AS severity FROM c""")
def wavelength_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _views(spark, sf_dir).sql(_WAVES)
    return review.wavelength_review(rows, "v", "r").select("id", "code", "source", "severity")


_GROUP = "CASE s_suppkey % 5 WHEN 0 THEN 'P 21/c' WHEN 1 THEN 'C 2/c' WHEN 2 THEN 'P 6' WHEN 3 THEN 'P-1' ELSE 'P n m a' END"


@register(f"""WITH s AS (SELECT s_suppkey AS id, {_GROUP} AS name, CAST(pow(2, s_suppkey % 4) AS INT) AS n FROM supplier), o(name, n) AS (VALUES ('P 21/c', 4), ('C 2/c', 8), ('P-1', 2))
SELECT s.id, CASE WHEN o.name IS NULL AND s.name <> 'P n m a' THEN 'not_listed' WHEN s.n = coalesce(o.n, 8) THEN 'consistent' ELSE 'incomplete' END AS code, CASE WHEN (o.name IS NOT NULL OR s.name = 'P n m a') AND s.n <> coalesce(o.n, 8) THEN 'WARN' ELSE 'INFO' END AS severity FROM s LEFT JOIN o USING (name)""")
def group_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.expr(_GROUP).alias("name"), F.pow(F.lit(2), F.col("s_suppkey") % 4).cast("int").alias("n"))
    return review.group_review(rows, "name", "n").select("id", "code", "severity")


def _ops(spark: SparkSession) -> DataFrame:
    return structure.symmetry_ops(spark, ["x,y,z", "-x,-y,-z", "-x,y+1/2,-z+1/2", "x,-y+1/2,z+1/2"])


_SITES = "VALUES (0, 'A', 'C', .1, .2, .3), (1, 'B', 'Fe', 0.0, 0.0, 0.0), (2, 'D', 'O', .5, .5, .0)"


def _sites(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT idx, label, sym, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM {_SITES} AS t(idx, label, sym, x, y, z)")


_QUARTERS = "SELECT p_partkey AS idx, 'P' || p_partkey AS label, 'C' AS sym, (p_partkey % 8) / 8e0 AS x, (p_partkey % 3) / 4e0 AS y, (p_partkey % 4) / 4e0 AS z FROM part"


@register(f"""WITH a AS ({_QUARTERS}), i AS (SELECT label, sym, x, y, z FROM a UNION ALL SELECT label, sym, -x, -y, -z FROM a UNION ALL SELECT label, sym, -x, y + .5, -z + .5 FROM a UNION ALL SELECT label, sym, x, -y + .5, z + .5 FROM a)
SELECT label, sym, CAST(count(DISTINCT [round((x + 8) * 8) % 8, round((y + 8) * 8) % 8, round((z + 8) * 8) % 8]) AS INT) AS orbit, 4 AS n_ops FROM i GROUP BY ALL HAVING count(DISTINCT [round((x + 8) * 8) % 8, round((y + 8) * 8) % 8, round((z + 8) * 8) % 8]) < 4""")
def special_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites at eighths of a cell, one for each part."""
    k = F.col("p_partkey")
    sites = table(spark, sf_dir, "part").select(k.alias("idx"), F.concat(F.lit("P"), k).alias("label"), F.lit("C").alias("sym"), (k % 8 / 8).alias("x"), (k % 3 / 4).alias("y"), (k % 4 / 4).alias("z"))
    return review.special_positions(sites, _ops(spark))


#: An image of each part's atom by rule; some lie beside every image.
_IMAGES = """SELECT concat('P', CAST(p_partkey AS VARCHAR(20))) AS label, p_partkey AS idx, (1 + p_partkey % 96) / 97e0 AS x, (1 + p_partkey * 5 % 96) / 97e0 AS y, (1 + p_partkey * 7 % 96) / 97e0 AS z, p_partkey % 4 AS op,
 p_partkey % 3 - 1 AS sx, p_partkey % 5 - 2 AS sy, p_partkey % 2 AS sz, CASE WHEN p_partkey % 13 = 0 THEN 3e-1 ELSE 0e0 END AS off FROM part"""


@register(f"""SELECT label, CASE WHEN off > 0 THEN '?' WHEN op = 0 AND sx = 0 AND sy = 0 AND sz = 0 THEN '.' ELSE concat(op + 1, '_', sx + 5, sy + 5, sz + 5) END AS code FROM ({_IMAGES})""")
def symmetry_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes read off images, an image of each part's atom."""
    rows = _views(spark, sf_dir).sql(_IMAGES)
    turned = {"x": F.when(F.col("op").isin(0, 3), F.col("x")).otherwise(-F.col("x")), "y": F.when(F.col("op") == 0, F.col("y")).when(F.col("op") == 1, -F.col("y")).when(F.col("op") == 2, F.col("y") + 0.5).otherwise(0.5 - F.col("y")), "z": F.when(F.col("op") == 0, F.col("z")).when(F.col("op") == 1, -F.col("z")).when(F.col("op") == 2, 0.5 - F.col("z")).otherwise(F.col("z") + 0.5)}
    images = rows.select("label", *[(v + F.col(f"s{c}") + F.col("off")).alias(c) for c, v in turned.items()])
    atoms = rows.select("idx", "label", F.lit("C").alias("sym"), "x", "y", "z")
    return review.operation_text(review.symmetry_codes(images, atoms, _ops(spark)), _ops(spark)).select("label", "code")


@register("SELECT DISTINCT CAST(1 + p_partkey % 12 AS BIGINT) AS n, ['i','ii','iii','iv','v','vi','vii','viii','ix','x','xi','xii'][1 + p_partkey % 12] AS roman FROM part")
def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (1 + F.col("p_partkey") % 12).cast("long")
    return table(spark, sf_dir, "part").select(n.alias("n")).distinct().select("n", review.roman(F.col("n").cast("int")).alias("roman"))


#: A tensor for each part by rule; some are none of an ellipsoid.
_U = "SELECT concat('P', CAST(p_partkey AS VARCHAR(20))) AS label, CASE WHEN p_partkey % 50 = 0 THEN -1e-2 ELSE 2e-2 + p_size * 1e-3 END AS u11, 3e-2 + p_partkey % 7 * 1e-3 AS u22, 25e-3 + p_partkey % 5 * 2e-3 AS u33, (p_partkey % 11 - 5) * 1e-3 AS u12, 0e0 AS u13, 0e0 AS u23 FROM part"


@register(f"SELECT label, round((u11 + u22 + u33) / 3, 6) AS u_eq FROM ({_U})")
def u_equivalent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In a rectangular cell the tensor of the file is the cartesian one."""
    return rounded(review.displacement(_u(spark, sf_dir), (5.0, 6.0, 7.0, 90.0, 90.0, 90.0)).select("label", "u_eq"))


def _u(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir).sql(_U)


@register(f"""WITH u AS (SELECT label, u11 AS a, u22 AS b, u33 AS c, u12 AS d FROM ({_U})),
e AS (SELECT label, list_sort([(a + b) / 2 - sqrt(((a - b) / 2) ** 2 + d * d), (a + b) / 2 + sqrt(((a - b) / 2) ** 2 + d * d), c]) AS v FROM u)
SELECT label, CASE WHEN v[1] > 1e-9 THEN round(1.5381722544550522 * sqrt(greatest(v[1], 0)), 6) END AS short, CASE WHEN v[1] > 1e-9 THEN round(1.5381722544550522 * sqrt(v[3]), 6) END AS long FROM e""")
def displacement_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = review.ellipsoid_axes(review.displacement(_u(spark, sf_dir), (5.0, 6.0, 7.0, 90.0, 90.0, 90.0)))
    return rounded(axes.select("label", F.get("axes", F.lit(0)).alias("short"), F.get("axes", F.lit(2)).alias("long")))


#: Parts as atoms in a box that grows with their number, 0.05 to a cubic angstrom.
_MOL = """SELECT p_partkey AS idx, concat('A', CAST(p_partkey AS VARCHAR(20))) AS label, CASE p_partkey % 8 WHEN 0 THEN 'N' WHEN 2 THEN 'H' WHEN 3 THEN 'O' WHEN 5 THEN 'H' WHEN 7 THEN 'H' ELSE 'C' END AS sym, e * ((p_partkey * 61 + p_partkey * p_partkey) % 997 / 997e0) AS x,
 e * ((p_partkey * 101 + p_partkey * p_partkey * 3) % 991 / 991e0) AS y, e * ((p_partkey * 37 + p_partkey * p_partkey * 7) % 983 / 983e0) AS z, p_partkey % 997 AS mol FROM part CROSS JOIN (SELECT power(count(*) / 5e-2, 1 / 3e0) AS e FROM part) n"""


def _molecule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir).sql(_MOL).withColumn("occ", F.lit(1.0))


_NEAREST = f"""m AS MATERIALIZED ({_MOL}),
p AS (SELECT a.idx, a.label, a.sym, b.label AS other, b.idx AS oi, b.sym AS os, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM m a JOIN m b ON a.idx <> b.idx AND abs(a.x - b.x) < 4)"""


@register(f"WITH {_NEAREST}, h AS (SELECT idx, arg_min(os, d) AS s, min(d) AS d FROM p WHERE sym = 'H' AND os <> 'H' GROUP BY idx) SELECT label FROM m WHERE idx NOT IN (SELECT idx FROM h WHERE s = 'C' AND d > .4 AND d <= .76 + .31 + .4)")
def without_carbon_hydrogens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.without_carbon_hydrogens(_molecule(spark, sf_dir)).select("label")


@register(f"SELECT label FROM (SELECT label, avg(x) OVER w AS mx, avg(y) OVER w AS my, avg(z) OVER w AS mz FROM ({_MOL}) WINDOW w AS (PARTITION BY mol)) WHERE mx >= -1e-4 AND mx < 20 AND my >= -1e-4 AND my < 20 AND mz >= -1e-4 AND mz < 20")
def packed_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms of the groups whose centre lies in a block of twenty cells a side."""
    return review.packed(_molecule(spark, sf_dir), "mol", (20, 20, 20)).select("label")


@register(f"WITH {_NEAREST} SELECT DISTINCT label FROM p WHERE oi % 10 = 0 AND d <= 1.5 AND idx % 10 <> 0")
def surroundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies around every tenth atom."""
    m = _molecule(spark, sf_dir)
    return review.around(m, m.filter("idx % 10 = 0"), 1.5).select("label")


@register("SELECT doc_id FROM (SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50) WHERE lang = 'de'")
def verified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bound is the feature: only the first fifty hits are checked."""
    return review.verified(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"], 50, F.col("lang") == "de").select("doc_id")


@register("SELECT CAST(4 * count(*) AS INT) AS n, round(sum(4 * l), 6) AS total FROM (VALUES (5e0), (6e0), (7e0)) t(l)")
def cell_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = review.cell_edges(spark, (5.0, 6.0, 7.0, 80.0, 95.0, 110.0))
    size = F.sqrt(sum((F.col(f"{c}2") - F.col(f"{c}1")) * (F.col(f"{c}2") - F.col(f"{c}1")) for c in "xyz"))
    return rounded(e.agg(F.count("*").cast("int").alias("n"), F.sum(size).alias("total")))


@register("""WITH g AS (SELECT s_nationkey AS k, count(*) AS n, avg(s_acctbal) AS m, stddev_samp(s_acctbal) AS sd FROM supplier GROUP BY 1)
SELECT k, 'mean' AS kind, n, round(m, 6) AS value, round(sd, 6) AS sd FROM g WHERE n >= 3 UNION ALL SELECT k, 'point', n, round(s_acctbal, 6), NULL FROM g JOIN supplier ON s_nationkey = k WHERE n < 3""")
def mean_or_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), "s_acctbal")
    return rounded(review.mean_or_points(rows, ["k"], "s_acctbal"))


def _four(v: str) -> str:
    """Four significant digits."""
    return f"round({v}, CAST(3 - floor(log10(abs({v}))) AS INT))"


@register(_fit_sql(_DOCUMENTS, "lang") + f"""SELECT lang, n, {_four('b')} AS slope, {_four('r2')} AS r2, {_four('3.3 * s / abs(b)')} AS lod FROM m""")
def calibration_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers read back from the sentence, which has four significant digits."""
    models = calibration.with_limits(calibration.fit(documents_by_lang(spark, sf_dir), ["lang"], "x", "y"))
    text = review.calibration_text(models, "lang")
    read = lambda pattern: F.regexp_extract("text", pattern + r"(-?[0-9.]+)", 1).cast("double")
    return text.select("lang", F.regexp_extract("text", r"n = (\d+)", 1).cast("long").alias("n"), *[read(p).alias(c) for c, p in (("slope", "y = "), ("r2", "R2 = "), ("lod", "LOD "))])


_ASKED = "CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal / 10000 END AS asked, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal / 5000 END AS declared"


@register(f"SELECT id, coalesce(asked, declared, 1.5406::DOUBLE) AS w, CASE WHEN asked IS NOT NULL THEN 'setting' WHEN declared IS NOT NULL THEN 'file' ELSE 'default' END AS origin FROM (SELECT s_suppkey AS id, {_ASKED} FROM supplier)")
def wavelength_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), *[F.expr(e) for e in ("CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal / 10000 END AS asked", "CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal / 5000 END AS declared")])
    w, origin = review.wavelength_used(F.col("asked"), F.col("declared"))
    return rows.select("id", w.alias("w"), origin.alias("origin"))

