"""Queries on many crystal structures: suppliers are structures and parts their atoms, placed by rule; SQL makes 27 images and more.

A fifth of the parts belong to the first structure, whose cell is larger in proportion, so joins meet a heavy key.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dist
from ..operators import crystals, groups, report, shape, tensors
from ..operators.structure import ACCEPTORS, BOND_TOLERANCE, CELL_DENSITY, COVALENT, DONORS, FORMULA_DENSITY, NEUTRON, VAN_DER_WAALS, WEIGHT
from ..sources import cif
from ..sources.scratch import materialize
from .adapters import rounded, table
from .catalogue import register

#: The operations of five settings: class, operation, rotation by rows, translation.
_OPS = [
    (0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0), (1, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0), (1, 1, -1, 0, 0, 0, -1, 0, 0, 0, -1, 0, 0, 0),
    (2, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0), (2, 1, -1, 0, 0, 0, 1, 0, 0, 0, -1, 0, 0.5, 0),
    (3, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0), (3, 1, -1, 0, 0, 0, 1, 0, 0, 0, -1, 0, 0.5, 0.5), (3, 2, -1, 0, 0, 0, -1, 0, 0, 0, -1, 0, 0, 0), (3, 3, 1, 0, 0, 0, -1, 0, 0, 0, 1, 0, 0.5, 0.5),
    (4, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0), (4, 1, -1, 0, 0, 0, -1, 0, 0, 0, 1, 0.5, 0, 0.5), (4, 2, -1, 0, 0, 0, 1, 0, 0, 0, -1, 0, 0.5, 0.5), (4, 3, 1, 0, 0, 0, -1, 0, 0, 0, -1, 0.5, 0.5, 0),
]
_R = [f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]
_VALUES = ", ".join(f"({', '.join(map(str, o[:11]))}, {', '.join(f'{t!r}e0' if t else '0e0' for t in o[11:])})" for o in _OPS)

# --- what both engines make of the tables

ATOMS_SQL = """SELECT CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 1 + p_partkey % (SELECT max(s_suppkey) FROM supplier) END AS structure, p_partkey AS idx,
 concat(CASE p_partkey % 8 WHEN 0 THEN 'N' WHEN 1 THEN 'C' WHEN 2 THEN 'H' WHEN 3 THEN 'O' WHEN 4 THEN 'C' WHEN 5 THEN 'H' WHEN 6 THEN 'C' ELSE 'O' END, CAST(p_partkey AS VARCHAR(20))) AS label,
 CASE p_partkey % 8 WHEN 0 THEN 'N' WHEN 1 THEN 'C' WHEN 2 THEN 'H' WHEN 3 THEN 'O' WHEN 4 THEN 'C' WHEN 5 THEN 'H' WHEN 6 THEN 'C' ELSE 'O' END AS sym,
 (p_partkey * 61 + p_partkey * p_partkey) % 997 / 997e0 AS x, (p_partkey * 101 + p_partkey * p_partkey * 3) % 991 / 991e0 AS y, (p_partkey * 37 + p_partkey * p_partkey * 7) % 983 / 983e0 AS z,
 CASE WHEN p_partkey % 11 = 0 THEN 5e-1 ELSE 1e0 END AS occ, CASE WHEN p_partkey % 22 = 0 THEN 'A' END AS assembly, CASE WHEN p_partkey % 11 = 0 THEN CAST(1 + p_partkey % 2 + p_partkey % 3 AS VARCHAR(20)) END AS grp FROM part"""
CELLS_SQL = f"""SELECT s_suppkey AS structure, s_suppkey % 5 AS kind, f * (7 + s_suppkey % 4) AS a, f * (8 + s_suppkey % 3) AS b, f * (9 + s_suppkey % 5) AS c,
 CASE WHEN s_suppkey % 5 < 2 THEN 80e0 + s_suppkey % 20 ELSE 90e0 END AS alpha, CASE WHEN s_suppkey % 5 < 4 THEN 95e0 + s_suppkey % 15 ELSE 90e0 END AS beta, CASE WHEN s_suppkey % 5 < 2 THEN 85e0 + s_suppkey % 10 ELSE 90e0 END AS gamma
 FROM supplier JOIN (SELECT structure, power(count(*) / 20e0, 1 / 3e0) AS f FROM ({ATOMS_SQL}) q GROUP BY structure) n ON s_suppkey = n.structure"""
OPS_SQL = f"SELECT s_suppkey AS structure, o.* FROM supplier JOIN (SELECT * FROM (VALUES {_VALUES}) AS v(kind, op, {', '.join(_R)}, t1, t2, t3)) o ON o.kind = s_suppkey % 5"


def _views(spark: SparkSession, sf_dir: str) -> None:
    for name in ("part", "supplier"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def structures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """atoms, operations and cells."""
    _views(spark, sf_dir)
    return spark.sql(ATOMS_SQL), spark.sql(OPS_SQL).drop("kind"), spark.sql(CELLS_SQL).drop("kind")


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of all structures with the cluster of labels that exclude each other."""
    found = materialize(crystals.sites(*structures(spark, sf_dir)), "sites")
    return materialize(crystals.with_clusters(found, crystals.disorder_clusters(found)), "sites")


def _radii(sym: str, values: dict[str, float]) -> str:
    return f"CASE {sym} " + " ".join(f"WHEN '{s}' THEN {values[s]!r}e0" for s in ("H", "C", "N", "O") if s in values) + " END"


_AXIS = ", ".join(f"r{i}1 * x + r{i}2 * y + r{i}3 * z + t{i} AS v{i}" for i in (1, 2, 3))
#: st: cells with their vectors; im: all sites; mv: 27 offsets; g: pairs over all 27 images of each site.
SITES_SQL = f"""st AS MATERIALIZED (SELECT *, b * cos(radians(gamma)) AS m12, c * cos(radians(beta)) AS m13, b * sin(radians(gamma)) AS m22,
  c * (cos(radians(alpha)) - cos(radians(beta)) * cos(radians(gamma))) / sin(radians(gamma)) AS m23 FROM ({CELLS_SQL})),
cl AS MATERIALIZED (SELECT *, sqrt(c * c - m13 * m13 - m23 * m23) AS m33 FROM st),
im0 AS (SELECT a.structure, idx, label, sym, occ, assembly, grp, op, {_AXIS} FROM ({ATOMS_SQL}) a JOIN ({OPS_SQL}) o ON a.structure = o.structure),
im1 AS (SELECT *, {', '.join(f'round(v{i} - floor(v{i} + 1e-9), 9) AS {c}, CAST(-floor(v{i} + 1e-9) AS INT) AS s{u}' for i, c, u in ((1, 'x', 'u'), (2, 'y', 'v'), (3, 'z', 'w')))} FROM im0),
im2 AS (SELECT *, row_number() OVER (PARTITION BY structure, sym, CAST(round(100 * x) AS INT) % 100, CAST(round(100 * y) AS INT) % 100, CAST(round(100 * z) AS INT) % 100 ORDER BY idx, op) AS k FROM im1),
im AS MATERIALIZED (SELECT im2.* EXCLUDE (v1, v2, v3, k), idx * 200 + op AS site FROM im2 WHERE k = 1),
mv AS (SELECT CAST(u AS INT) AS du, CAST(v AS INT) AS dv, CAST(w AS INT) AS dw FROM range(-1, 2) q(u), range(-1, 2) r(v), range(-1, 2) s(w))"""
_D2 = "(a * {0} + m12 * {1} + m13 * {2}) ** 2 + (m22 * {1} + m23 * {2}) ** 2 + (m33 * {2}) ** 2"


def _pairs(left: str, right: str, keep: str, within: str) -> str:
    d = _D2.format(*[f"(r.{c} + {o} - l.{c})" for c, o in zip("xyz", ("du", "dv", "dw"))])
    return f"SELECT * FROM (SELECT l.structure, {keep}, du, dv, dw, sqrt({d}) AS d FROM {left} l JOIN {right} r ON l.structure = r.structure JOIN cl ON cl.structure = l.structure CROSS JOIN mv) WHERE d <= {within}"


_ONCE = "(i < j OR i = j AND (du > 0 OR du = 0 AND (dv > 0 OR dv = 0 AND dw > 0)))"
#: x: pairs of labels that exclude each other, by all chains of links.
CLUSTER_SQL = f"""pt AS (SELECT * FROM im WHERE occ < .999),
ln AS (SELECT structure, a, b FROM ({_pairs('pt', 'pt', 'l.site AS i, r.site AS j, l.label AS a, r.label AS b, l.sym AS s, r.sym AS t', '.9')}) WHERE {_ONCE} AND s = t AND a <> b AND d < .9
  UNION SELECT p.structure, p.label, q.label FROM im p JOIN im q ON p.structure = q.structure AND coalesce(p.assembly, '.') = coalesce(q.assembly, '.') AND p.grp <> q.grp WHERE p.label <> q.label),
xc AS (SELECT structure, a, b FROM ln UNION SELECT structure, b, a FROM ln UNION SELECT c.structure, c.a, CASE WHEN l.a = c.b THEN l.b ELSE l.a END FROM xc c JOIN ln l ON l.structure = c.structure AND (l.a = c.b OR l.b = c.b)),
x AS MATERIALIZED (SELECT * FROM xc WHERE a <> b)"""
_MAX_REACH = 2 * COVALENT["C"] + BOND_TOLERANCE
BONDS_SQL = f"""bd AS MATERIALIZED (SELECT * FROM (SELECT *, {_radii('s', COVALENT)} + {_radii('t', COVALENT)} AS expected FROM ({_pairs('im', 'im', 'l.site AS i, r.site AS j, l.label AS label_i, r.label AS label_j, l.sym AS s, r.sym AS t, l.occ AS o, r.occ AS p', str(_MAX_REACH))}))
  WHERE {_ONCE} AND d > .4 AND d <= expected + .4::DOUBLE AND NOT (o < 1 AND p < 1 AND d < .9) AND NOT EXISTS (SELECT 1 FROM x WHERE x.structure = structure AND x.a = label_i AND x.b = label_j))"""
BONDS_SQL = BONDS_SQL.replace("SELECT * FROM (SELECT *,", "SELECT e.* FROM (SELECT *,", 1).replace("))\n  WHERE", ")) e\n  WHERE", 1).replace("x.structure = structure", "x.structure = e.structure").replace("x.a = label_i AND x.b = label_j", "x.a = e.label_i AND x.b = e.label_j")


@register(f"WITH RECURSIVE {SITES_SQL}, {CLUSTER_SQL}, {BONDS_SQL} SELECT structure, i, j, label_i, label_j, du, dv, dw, round(d, 6) AS d, round(expected, 6) AS expected, abs(d - expected) > .25 AS outlying FROM bd")
def periodic_bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(crystals.periodic_bonds(placed(spark, sf_dir)))


#: ed: bonds both ways; rc, ro: all pairs of a component, its smallest site; gw: all images reached from that site within four cells; mo: dimension.
MOLECULES_SQL = f"""ed AS MATERIALIZED (SELECT structure, i AS a, j AS b, du, dv, dw FROM bd UNION SELECT structure, j, i, -du, -dv, -dw FROM bd),
rc AS (SELECT structure, site AS a, site AS b FROM im UNION SELECT r.structure, r.a, e.b FROM rc r JOIN ed e ON e.structure = r.structure AND e.a = r.b),
ro AS MATERIALIZED (SELECT structure, a AS site, min(b) AS molecule FROM rc GROUP BY ALL),
gw AS (SELECT DISTINCT structure, molecule, molecule AS site, 0 AS du, 0 AS dv, 0 AS dw FROM ro
  UNION SELECT g.structure, molecule, b, g.du + e.du, g.dv + e.dv, g.dw + e.dw FROM gw g JOIN ed e ON e.structure = g.structure AND e.a = g.site
  WHERE greatest(abs(g.du + e.du), abs(g.dv + e.dv), abs(g.dw + e.dw)) <= 4),
pe AS MATERIALIZED (SELECT structure, molecule, du, dv, dw FROM gw WHERE site = molecule),
p1 AS (SELECT structure, molecule, min(struct_pack(du, dv, dw)) AS f FROM pe WHERE du <> 0 OR dv <> 0 OR dw <> 0 GROUP BY ALL),
cr AS (SELECT pe.structure, pe.molecule, pe.du, pe.dv, pe.dw, f.dv * dw - f.dw * dv AS cx, f.dw * du - f.du * dw AS cy, f.du * dv - f.dv * du AS cz FROM pe JOIN p1 ON p1.structure = pe.structure AND p1.molecule = pe.molecule),
p2 AS (SELECT structure, molecule, min(struct_pack(cx, cy, cz)) AS n FROM cr WHERE cx <> 0 OR cy <> 0 OR cz <> 0 GROUP BY ALL),
p3 AS (SELECT DISTINCT cr.structure, cr.molecule FROM cr JOIN p2 ON p2.structure = cr.structure AND p2.molecule = cr.molecule WHERE n.cx * du + n.cy * dv + n.cz * dw <> 0),
mo AS MATERIALIZED (SELECT structure, molecule, CASE WHEN f IS NULL THEN 0 ELSE 1 END + CASE WHEN n IS NULL THEN 0 ELSE 1 END + CASE WHEN three IS NULL THEN 0 ELSE 1 END AS dimension
  FROM (SELECT DISTINCT structure, molecule FROM ro) LEFT JOIN p1 USING (structure, molecule) LEFT JOIN p2 USING (structure, molecule) LEFT JOIN (SELECT *, true AS three FROM p3) USING (structure, molecule))"""
_UP_TO_MOLECULES = f"WITH RECURSIVE {SITES_SQL}, {CLUSTER_SQL}, {BONDS_SQL}, {MOLECULES_SQL}"


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    where = placed(spark, sf_dir)
    return where, crystals.molecules(where, crystals.periodic_bonds(where))


@register(f"{_UP_TO_MOLECULES} SELECT structure, molecule, dimension, count(*) AS n FROM ro JOIN mo USING (structure, molecule) GROUP BY ALL")
def molecule_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every molecule, chain, layer and framework, with its number of sites in the cell."""
    return _found(spark, sf_dir)[1].groupBy("structure", "molecule", "dimension").agg(F.count("*").alias("n"))


@register(f"""{_UP_TO_MOLECULES}, gm AS (SELECT s.structure, s.site AS seed, s.site, 0 AS du, 0 AS dv, 0 AS dw FROM im s JOIN ro USING (structure, site) JOIN mo USING (structure, molecule) WHERE op = 0 AND dimension = 0
  UNION SELECT g.structure, seed, b, g.du + e.du, g.dv + e.dv, g.dw + e.dw FROM gm g JOIN ed e ON e.structure = g.structure AND e.a = g.site)
SELECT DISTINCT structure, site, du, dv, dw, molecule FROM gm JOIN ro USING (structure, site)""")
def grown_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole molecules around the atoms as listed."""
    where, found = _found(spark, sf_dir)
    seeds = where.filter("op = 0").select("structure", "site", F.col("su").alias("du"), F.col("sv").alias("dv"), F.col("sw").alias("dw"))
    return crystals.complete(seeds, found)


_IN = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _xyz(f: tuple[str, str, str], out: str) -> str:
    return f"a * {f[0]} + m12 * {f[1]} + m13 * {f[2]} AS {out}x, m22 * {f[1]} + m23 * {f[2]} AS {out}y, m33 * {f[2]} AS {out}z"


#: ff: donor, hydrogen and acceptor triples over 27 and more images; k = 1 once each.
HYDROGEN_SQL = f"""nh AS ({_pairs("(SELECT * FROM im WHERE sym = 'H')", "(SELECT * FROM im WHERE sym <> 'H')", "l.site AS h, l.label AS hydrogen, l.x AS hx, l.y AS hy, l.z AS hz, r.site AS dsite, r.label AS donor, r.sym AS s, r.x + du AS qx, r.y + dv AS qy, r.z + dw AS qz", "1.5")}),
ow AS (SELECT *, row_number() OVER (PARTITION BY structure, h ORDER BY d, dsite, du, dv, dw) AS k FROM nh),
dn AS MATERIALIZED (SELECT structure, h, hydrogen, dsite, donor, s, d AS dh, qx AS x, qy AS y, qz AS z, {_xyz(("(hx - qx)", "(hy - qy)", "(hz - qz)"), "h")} FROM ow JOIN cl USING (structure)
  WHERE k = 1 AND s IN {_IN(DONORS)} AND d > .4 AND d <= {_radii('s', COVALENT)} + .31::DOUBLE + .4::DOUBLE),
wd AS (SELECT CAST(u AS INT) AS du, CAST(v AS INT) AS dv, CAST(w AS INT) AS dw FROM range(-2, 3) q(u), range(-2, 3) r(v), range(-2, 3) s(w)),
ac AS (SELECT l.*, r.site AS asite, r.label AS acceptor, r.sym AS t, r.op, r.su, r.sv, r.sw, du, dv, dw, {_xyz(("(r.x + du - l.x)", "(r.y + dv - l.y)", "(r.z + dw - l.z)"), "a")} FROM dn l JOIN im r ON l.structure = r.structure AND r.sym IN {_IN(ACCEPTORS)} JOIN cl ON cl.structure = l.structure CROSS JOIN wd
  WHERE {_D2.format("(r.x + du - l.x)", "(r.y + dv - l.y)", "(r.z + dw - l.z)")} <= 16),
mv2 AS (SELECT *, sqrt(ax ** 2 + ay ** 2 + az ** 2) AS da, {', '.join(f"{_radii('s', NEUTRON)} / dh * h{c} AS n{c}" for c in 'xyz')} FROM ac),
an AS (SELECT *, sqrt((ax - nx) ** 2 + (ay - ny) ** 2 + (az - nz) ** 2) AS ha FROM mv2 WHERE da >= .4),
kd AS (SELECT *, degrees(acos(greatest(-1, least(1, (-nx * (ax - nx) - ny * (ay - ny) - nz * (az - nz)) / (sqrt(nx ** 2 + ny ** 2 + nz ** 2) * ha))))) AS angle,
  EXISTS (SELECT 1 FROM x WHERE x.structure = an.structure AND x.a = an.donor AND x.b = an.acceptor) AS apart FROM an),
kk AS (SELECT *, CASE WHEN apart THEN 'disorder' WHEN ha > {_radii('t', VAN_DER_WAALS)} + 1.2::DOUBLE THEN 'far' WHEN angle >= 120 THEN 'hbond' WHEN angle >= 90 THEN 'contact' ELSE 'bent' END AS kind FROM kd),
ff AS (SELECT *, row_number() OVER (PARTITION BY structure, donor, hydrogen, acceptor, kind, round(da, 2) ORDER BY h, asite, du, dv, dw) AS k FROM kk)"""


@register(f"""WITH RECURSIVE {SITES_SQL}, {CLUSTER_SQL}, {HYDROGEN_SQL}
SELECT structure, donor, hydrogen, acceptor, round(da, 6) AS da, CASE WHEN kind <> 'disorder' THEN round(ha, 6) END AS ha, CASE WHEN kind <> 'disorder' THEN round(angle, 6) END AS angle, kind,
 CASE WHEN da < 2.2 THEN 'long' WHEN da < 2.5 THEN 'strong' WHEN da < 3.2 THEN 'moderate' WHEN da < 4 THEN 'weak' ELSE 'long' END AS strength,
 CASE WHEN op = 0 AND su + du = 0 AND sv + dv = 0 AND sw + dw = 0 THEN '.' ELSE concat(op + 1, '_', su + du + 5, sv + dv + 5, sw + dw + 5) END AS code FROM ff WHERE k = 1""")
def hydrogen_bond_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(crystals.hydrogen_bond_images(placed(spark, sf_dir)))


# --- groups from operations: each supplier has those of a listed setting, in another order and about another origin

_SETTINGS = "(VALUES " + ", ".join(f"({k}, '{name}', {len(groups.hall_operations(hall))})" for k, (name, hall) in enumerate(groups.HALL.items())) + ") AS v(k, name, n)"
_OF = len(groups.HALL)


@register(f"""WITH g AS (SELECT * FROM {_SETTINGS}),
s AS (SELECT s_suppkey AS structure, g.name, g.n, CASE WHEN s_suppkey % 17 = 0 AND g.n > 1 THEN g.n - 1 ELSE g.n END AS n_ops, CASE WHEN s_suppkey % 29 = 0 THEN 'Q 1' WHEN s_suppkey % 13 = 0 THEN h.name ELSE g.name END AS declared
  FROM supplier JOIN g ON g.k = s_suppkey % {_OF} JOIN g h ON h.k = (s_suppkey + 1) % {_OF}),
f AS (SELECT *, CASE WHEN n_ops = 1 THEN 'P 1' WHEN n_ops = n THEN name END AS found FROM s)
SELECT f.structure, f.declared, CAST(f.n_ops AS INT) AS n_ops, f.found AS name, CAST(d.n AS INT) AS "order", CASE WHEN d.n IS NULL THEN 'not_listed' WHEN f.n_ops <> d.n THEN 'incomplete' WHEN f.found <> f.declared THEN 'other_name' ELSE 'consistent' END AS code,
 CASE WHEN f.n_ops <> d.n THEN 'WARN' ELSE 'INFO' END AS severity FROM f LEFT JOIN g d ON d.name = f.declared""")
def group_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings told from shuffled operations about shifted origins; some lack an operation or declare another name."""
    rows = [(k, name, len(found), op, *r, *[v / groups.PARTS for v in t]) for k, (name, hall) in enumerate(groups.HALL.items()) for found in [groups.hall_operations(hall)] for op, (r, t) in enumerate(found)]
    kinds = ", ".join(f"{c} int" for c in groups.ROTATION) + ", " + ", ".join(f"{c} double" for c in groups.SHIFT)
    every = spark.createDataFrame(rows, f"k int, name string, n int, op int, {kinds}")  # the listed settings' operations
    names = every.filter("op = 0").select("k", "name")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("structure"), (F.col("s_suppkey") % _OF).cast("int").alias("k"))
    origin = [(F.col("structure") * m % 97) / 97 for m in (1, 5, 11)]
    made = s.join(F.broadcast(every), "k").filter(~((F.col("structure") % 17 == 0) & (F.col("n") > 1) & (F.col("op") == F.col("n") - 1)))
    moved = [(F.col(f"t{i}") + origin[i - 1] - sum(F.col(f"r{i}{j}") * origin[j - 1] for j in (1, 2, 3)) + F.col("op") % 3 - 1).alias(f"t{i}") for i in (1, 2, 3)]
    ops = made.select("structure", *groups.ROTATION, *moved).repartition("t1")  # in no order
    after = F.broadcast(names.select(((F.col("k") + _OF - 1) % _OF).alias("k"), F.col("name").alias("next")))
    declared = F.when(F.col("structure") % 29 == 0, "Q 1").when(F.col("structure") % 13 == 0, F.col("next")).otherwise(F.col("name"))
    asked = s.join(F.broadcast(names), "k").join(after, "k").select("structure", declared.alias("declared"))
    return groups.check(asked, ops).select("structure", "declared", "n_ops", "name", "order", "code", "severity")


# --- files: each structure written out as text, its symmetry given in one of six ways, and read back

_WRITTEN = {0: ("P 1", "P 1"), 1: ("P -1", "-P 1"), 2: ("P 1 21 1", "P 2yb"), 3: ("P 1 21/c 1", "-P 2ybc"), 4: ("P 21 21 21", "P 2ac 2ab")}


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """structure, text. By the structure's number modulo 6: a loop of either tag, a name, a Hall symbol, nothing, two blocks."""
    atoms, ops, cells = structures(spark, sf_dir)
    n, way, kind = F.col("idx"), F.col("structure") % 6, (F.col("structure") % 5).cast("int")
    place = lambda c: F.format_string("%.9f(4)", F.col(c))
    label = F.when(n % 3 == 0, F.concat(F.lit("'"), "label", F.lit("'"))).otherwise(F.col("label"))
    symbol = F.when(n % 5 == 0, "?").when((n % 4 == 3) & (F.col("sym") == "O"), "O2-").otherwise(F.col("sym"))
    occ = F.when(F.col("occ") < 1, F.format_string("%.2f", F.col("occ"))).when(n % 2 == 0, ".").otherwise("1")
    line = F.concat_ws(" ", label, symbol, place("x"), place("y"), place("z"), occ, F.coalesce("assembly", F.lit(".")), F.coalesce("grp", F.lit(".")))
    text = lambda part, at: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), part.alias("line")))), lambda p: p["line"]), "\n")
    listed = atoms.groupBy("structure").agg(text(line, "idx").alias("atoms"))
    axis = lambda i: F.concat(*[F.when(F.col(f"r{i}{j}") == 1, f"+{v}").when(F.col(f"r{i}{j}") == -1, f"-{v}").otherwise("") for j, v in enumerate("xyz", 1)], F.when(F.col(f"t{i}") != 0, "+1/2").otherwise(""))
    written = ops.groupBy("structure").agg(text(F.concat(F.lit("'"), axis(1), F.lit(", "), axis(2), F.lit(", "), axis(3), F.lit("'")), "op").alias("ops"))
    chosen = lambda k: F.element_at(F.array(*[F.lit(v[k]) for v in _WRITTEN.values()]), kind + 1)
    loop = lambda tag: F.concat(F.lit(f"loop_\n  {tag}\n"), "ops", F.lit("\n"))
    symmetry = (
        F.when(way == 0, loop("_symmetry_equiv_pos_as_xyz")).when((way == 1) | (way == 5), loop("_space_group_symop_operation_xyz"))
        .when(way == 2, F.concat(F.lit("_symmetry_space_group_name_H-M '"), chosen(0), F.lit("'\n"))).when(way == 3, F.concat(F.lit("_space_group_name_H-M_alt ?\n_symmetry_space_group_name_Hall '"), chosen(1), F.lit("'\n")))
        .otherwise("# no symmetry\n")
    )
    cell = F.concat(*[F.concat(F.lit(f"{tag}  "), F.format_string("%.12f", F.col(c)), F.lit("\n")) for c, tag in (("a", "_cell_length_a"), ("b", "_cell_length_b"), ("c", "_cell_length_c"), ("alpha", "_cell_angle_alpha"), ("beta", "_cell_angle_beta"), ("gamma", "_cell_angle_gamma"))])
    title = F.lit("_publ_section_title\n;\nA text with a loop_ and\n_cell_length_a 1.0 in it\n;\n")
    sites = "loop_\n" + "".join(f"_atom_site_{t}\n" for t in ("label", "type_symbol", "fract_x", "fract_y", "fract_z", "occupancy", "disorder_assembly", "disorder_group"))
    head = F.concat(F.lit("# a file\ndata_s"), F.col("structure").cast("string"), F.lit("\n"))
    whole = F.concat(head, title, symmetry, cell, F.lit(sites), "atoms", F.lit("\n"), F.when(way == 5, F.concat(F.lit("data_more\n_cell_length_a 1\n"))).otherwise(""))
    return cells.join(listed, "structure").join(written, "structure").select("structure", whole.alias("text"))


def _read(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts' structures, operations and atoms."""
    texts = _texts(spark, sf_dir)
    found = materialize(cif.items(texts, "structure"), "cif-items")
    one = cif.chosen(found, key="structure")
    made = materialize(cif.structures(texts, found, key="structure"), "cif-structures")
    return made, cif.operations(made, one, "structure"), cif.atoms(one, "structure")


_CIF_OPS = f"SELECT * FROM ({OPS_SQL}) q WHERE structure % 6 <> 4 OR op = 0"


@register(f"""WITH n AS (SELECT structure, count(*) AS n_atoms FROM ({ATOMS_SQL}) GROUP BY 1), o AS (SELECT structure, count(*) AS n_ops FROM ({_CIF_OPS}) GROUP BY 1)
SELECT structure, concat('s', structure) AS block, CAST(CASE WHEN structure % 6 = 5 THEN 2 ELSE 1 END AS INT) AS blocks, n_atoms, n_ops, CASE structure % 6 WHEN 2 THEN 'name' WHEN 3 THEN 'hall' WHEN 4 THEN 'none' ELSE 'loop' END AS source,
 round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, alpha, beta, gamma, CASE structure % 6 WHEN 4 THEN 'no_symmetry' WHEN 5 THEN 'many_blocks' ELSE '' END AS codes
FROM ({CELLS_SQL}) JOIN n USING (structure) JOIN o USING (structure)""")
def cif_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, ops, _ = _read(spark, sf_dir)
    n = ops.groupBy("structure", "source").agg(F.count("*").alias("n_ops"))
    codes = F.array_join(F.transform("findings", lambda f: f["code"]), ",")
    return rounded(made.join(n, "structure").select("structure", "block", "blocks", "n_atoms", "n_ops", "source", "a", "b", "c", "alpha", "beta", "gamma", codes.alias("codes")))


@register(f"SELECT structure, row_number() OVER (PARTITION BY structure ORDER BY idx) - 1 AS idx, label, sym, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z, occ, assembly, grp FROM ({ATOMS_SQL}) WHERE structure IN (SELECT s_suppkey FROM supplier)")
def cif_atoms_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir)[2].select("structure", "idx", "label", "sym", "x", "y", "z", "occ", "assembly", "grp")


@register(f"""WITH RECURSIVE {SITES_SQL.replace(OPS_SQL, _CIF_OPS)}, {CLUSTER_SQL}, {BONDS_SQL}
SELECT structure, least(label_i, label_j) AS label_i, greatest(label_i, label_j) AS label_j, round(d, 4) AS d, count(*) AS n FROM bd GROUP BY ALL""")
def cif_bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From texts to atoms, operations, sites and bonds."""
    made, ops, atoms = _read(spark, sf_dir)
    found = materialize(crystals.sites(atoms.drop("u_iso"), ops.drop("source"), made.select("structure", "a", "b", "c", "alpha", "beta", "gamma")), "sites")
    where = materialize(crystals.with_clusters(found, crystals.disorder_clusters(found)), "sites")
    pair = [f("label_i", "label_j").alias(c) for f, c in ((F.least, "label_i"), (F.greatest, "label_j"))]
    return rounded(crystals.periodic_bonds(where).select("structure", *pair, F.round("d", 4).alias("d"))).groupBy("structure", "label_i", "label_j", "d").agg(F.count("*").alias("n"))


# --- displacement tensors of each part's images, and the structures seen along their own axes

_CELLS_ONLY = SITES_SQL.split(",\nim0 AS")[0]
_U = ["u11", "u22", "u33", "u12", "u13", "u23"]
TENSORS_SQL = f"""SELECT structure, idx, 2e-2 + idx % 13 * 1e-3 AS u11, 3e-2 + idx % 7 * 1e-3 AS u22, CASE WHEN idx % 50 = 0 THEN -1e-2 ELSE 25e-3 + idx % 5 * 2e-3 END AS u33,
 (idx * 7 % 11 - 5) * 1e-3 AS u12, (idx * 5 % 9 - 4) * 1e-3 AS u13, (idx * 3 % 7 - 3) * 1e-3 AS u23 FROM ({ATOMS_SQL}) z"""
_H = {1: "(m22 * m33 * a / sqrt((m22 * m33) ** 2 + (m12 * m33) ** 2 + (m12 * m23 - m13 * m22) ** 2))", 2: "(m22 * m33 / sqrt(m33 ** 2 + m23 ** 2))", 3: "m33"}
_M = {(1, 1): "a", (1, 2): "m12", (1, 3): "m13", (2, 2): "m22", (2, 3): "m23", (3, 3): "m33"}
_B = ", ".join(f"({' + '.join(f'{_M[i, k]} * r{k}{j}' for k in range(i, 4))}) / {_H[j]} AS b{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))
_C = ", ".join(f"{' + '.join(f'b{i}{p} * b{j}{q} * u{min(p, q)}{max(p, q)}' for p in (1, 2, 3) for q in (1, 2, 3))} AS c{i}{j}" for i, j in tensors.PLACES)
_ROOTS = """(c11 + c22 + c33) / 3 AS q, sqrt(((c11 - q) ** 2 + (c22 - q) ** 2 + (c33 - q) ** 2 + 2 * (c12 ** 2 + c13 ** 2 + c23 ** 2)) / 6) AS p,
 acos(greatest(-1, least(1, ((c11 - q) * ((c22 - q) * (c33 - q) - c23 ** 2) - c12 * (c12 * (c33 - q) - c23 * c13) + c13 * (c12 * c23 - (c22 - q) * c13)) / (2 * p ** 3)))) / 3 AS f,
 q + 2 * p * cos(f + 2 * pi() / 3) AS e1, q + 2 * p * cos(f) AS e3, 3 * q - e1 - e3 AS e2"""


@register(f"""WITH {_CELLS_ONLY}, t AS ({TENSORS_SQL}), o AS ({OPS_SQL}), b AS (SELECT t.structure, idx, op, {', '.join(_U)}, {_B} FROM t JOIN o ON o.structure = t.structure JOIN cl ON cl.structure = t.structure),
c AS (SELECT structure, idx, op, {_C} FROM b), e AS (SELECT *, {_ROOTS} FROM c)
SELECT structure, idx, op, {', '.join(f'round({n}, 6) + 0.0 AS {n}' for n in (*tensors.NAMES, 'e1', 'e2', 'e3'))}, round(q, 6) AS u_eq, CASE WHEN e1 > 1e-9 THEN round(sqrt(e1 * {dist.chi2_ppf(0.5, 3)!r}), 6) END AS a1, CASE WHEN e1 > 1e-9 THEN round(sqrt(e3 * {dist.chi2_ppf(0.5, 3)!r}), 6) END AS a3 FROM e""")
def tensor_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms, ops, cells = structures(spark, sf_dir)
    found = tensors.displaced_images(spark.sql(TENSORS_SQL), ops, cells)
    return rounded(found.select("structure", "idx", "op", *tensors.NAMES, "e1", "e2", "e3", "u_eq", "a1", "a3"))


def _power(tensor: str, name: str, squarings: int = 22) -> str:
    """CTEs name0.. of a 3 x 3 tensor a structure (i, j, v), squared and scaled by its trace; name: its first axis, unit."""
    parts = [f"{name}0 AS (SELECT structure, i, j, v / sum(v) FILTER (i = j) OVER (PARTITION BY structure) AS v FROM {tensor})"]
    for k in range(squarings):
        parts.append(f"{name}{k + 1} AS MATERIALIZED (SELECT structure, i, j, v / sum(v) FILTER (i = j) OVER (PARTITION BY structure) AS v FROM (SELECT a.structure, a.i, b.j, sum(a.v * b.v) AS v FROM {name}{k} a JOIN {name}{k} b ON a.structure = b.structure AND a.j = b.i GROUP BY ALL))")
    last = f"{name}{squarings}"
    parts.append(f"{name} AS (SELECT structure, i, v / sqrt(sum(v * v) OVER (PARTITION BY structure)) AS u FROM {last} JOIN (SELECT structure, arg_max(i, v) AS j FROM {last} WHERE i = j GROUP BY 1) USING (structure, j))")
    return ", ".join(parts)


#: t, y: places of heavier atoms along the first and last axes, and across both; g: signs; ee: spreads.
_AXES_SQL = f"""h AS (SELECT q.structure, idx, cl.a * x + m12 * y + m13 * z AS x, m22 * y + m23 * z AS y, m33 * z AS z FROM ({ATOMS_SQL}) q JOIN cl ON cl.structure = q.structure WHERE sym <> 'H'),
lg AS MATERIALIZED (SELECT structure, idx, i, c - avg(c) OVER (PARTITION BY structure, i) AS d FROM (SELECT structure, idx, unnest([1, 2, 3]) AS i, unnest([x, y, z]) AS c FROM h)),
cv AS MATERIALIZED (SELECT a.structure, a.i, b.i AS j, sum(a.d * b.d) AS v FROM lg a JOIN lg b USING (structure, idx) GROUP BY ALL),
rv AS (SELECT structure, i, j, CASE WHEN i = j THEN sum(v) FILTER (i = j) OVER (PARTITION BY structure) ELSE 0 END - v AS v FROM cv), {_power('cv', 'px')}, {_power('rv', 'pz')},
t AS MATERIALIZED (SELECT lg.structure, idx, sum(d * px.u) AS x, sum(d * pz.u) AS z FROM lg JOIN px USING (structure, i) JOIN pz USING (structure, i) GROUP BY ALL),
g AS (SELECT structure, sign(sum(x ** 3)) AS gx, sign(sum(z ** 3)) AS gz FROM t GROUP BY 1),
f AS (SELECT structure, max(px.u * gx) FILTER (i = 1) AS x1, max(px.u * gx) FILTER (i = 2) AS x2, max(px.u * gx) FILTER (i = 3) AS x3, max(pz.u * gz) FILTER (i = 1) AS z1, max(pz.u * gz) FILTER (i = 2) AS z2, max(pz.u * gz) FILTER (i = 3) AS z3 FROM px JOIN pz USING (structure, i) JOIN g USING (structure) GROUP BY 1),
ee AS (SELECT structure, sum(v) FILTER (i = j) AS tr, sum(v * a.u * b.u) AS w1, sum(v * c.u * e.u) AS w3 FROM cv JOIN px a USING (structure, i) JOIN px b ON b.structure = cv.structure AND b.i = cv.j JOIN pz c ON c.structure = cv.structure AND c.i = cv.i JOIN pz e ON e.structure = cv.structure AND e.i = cv.j GROUP BY 1),
y AS (SELECT lg.structure, idx, sum(d * CASE i WHEN 1 THEN z2 * x3 - z3 * x2 WHEN 2 THEN z3 * x1 - z1 * x3 ELSE z1 * x2 - z2 * x1 END) AS v FROM lg JOIN f USING (structure) GROUP BY ALL)"""


@register(f"""WITH {_CELLS_ONLY}, {_AXES_SQL}
SELECT t.structure, t.idx, round(x * gx, 4) + 0.0 AS u, round(v, 4) + 0.0 AS v, round(z * gz, 4) + 0.0 AS w, CASE WHEN tr - w1 - w3 >= .85::DOUBLE * w1 THEN 'degenerate' ELSE 'unique' END AS code FROM t JOIN y USING (structure, idx) JOIN g USING (structure) JOIN ee USING (structure)""")
def view_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heavier atoms of each structure along its own axes."""
    where = _heavy(spark, sf_dir)
    axes = materialize(tensors.view_axes(where), "axes")
    out = tensors.seen(where, axes).join(axes.select("structure", "code"), "structure")
    return out.select("structure", "idx", *[(F.round(c, 4) + 0.0).alias(c) for c in "uvw"], "code")


def _heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """structure, idx and cartesian places of all but hydrogens."""
    atoms, _, cells = structures(spark, sf_dir)
    heavy = atoms.filter("sym <> 'H'").join(crystals.basis(cells), "structure")
    xyz = [(F.col("m11") * F.col("x") + F.col("m12") * F.col("y") + F.col("m13") * F.col("z")).alias("x"), (F.col("m22") * F.col("y") + F.col("m23") * F.col("z")).alias("y"), (F.col("m33") * F.col("z")).alias("z")]
    return materialize(heavy.select("structure", "idx", *xyz), "heavy")


@register(f"""WITH {_CELLS_ONLY}, {_AXES_SQL}, sz AS (SELECT structure, list_sort([max(x) - min(x), max(v) - min(v), max(z) - min(z)]) AS e FROM t JOIN y USING (structure, idx) GROUP BY 1)
SELECT structure, round(e[1] / e[3], 4) AS short, round(e[2] / e[3], 4) AS middle FROM sz""")
def shape_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents of each structure along its own axes, to the longest."""
    found = shape.principal_extents(_heavy(spark, sf_dir), "structure")
    return found.select("structure", F.round("short", 4).alias("short"), F.round("middle", 4).alias("middle"))


# --- the whole review of each structure; what is declared follows from the table by rule, now and then wrong

_NAMES = ["P 1", "P -1", "P 21", "P 21/c", "P 21 21 21"]
DECLARED_SQL = """SELECT s_suppkey AS structure, CASE WHEN s_suppkey % 7 = 0 THEN 'P n m a' """ + " ".join(f"WHEN s_suppkey % 5 = {k} THEN '{n}'" for k, n in enumerate(_NAMES)) + """ END AS name,
 CASE WHEN s_suppkey % 8 = 0 THEN NULL WHEN s_suppkey % 9 = 0 THEN 102e-2 ELSE 1e0 END AS by_volume, CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN s_suppkey % 4 = 0 THEN 106e-2 ELSE 1e0 END AS by_density,
 CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 5 = 1 THEN 11e-1 ELSE 1e0 END AS by_f000, CASE s_suppkey % 6 WHEN 1 THEN 71073e-5 WHEN 2 THEN 15418e-4 WHEN 3 THEN 13e-1 WHEN 4 THEN 12e-1 WHEN 5 THEN 56086e-5 END AS wavelength,
 CASE WHEN s_suppkey % 6 = 4 THEN 'Synchrotron' END AS radiation FROM supplier"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms, ops, cells = structures(spark, sf_dir)
    where = placed(spark, sf_dir)
    bonds, found = crystals.periodic_bonds(where), crystals.hydrogen_bond_images(where)
    inside = report.cell_contents(where).join(crystals.basis(cells), "structure").join(ops.groupBy("structure").agg(F.count("*").cast("double").alias("z")), "structure")
    v = F.col("m11") * F.col("m22") * F.col("m33")
    told = spark.sql(DECLARED_SQL).join(cells, "structure").join(inside, "structure").select(
        "structure", "a", "b", "c", "alpha", "beta", "gamma", "name", (v * F.col("by_volume")).alias("volume"), (CELL_DENSITY * F.col("mass") / v * F.col("by_density")).alias("density"), (F.col("mass") / F.col("z")).alias("weight"),
        "z", (F.col("electrons") * F.col("by_f000")).alias("f000"), F.transform_values("counts", lambda k, n: n / F.col("z")).alias("formula"), "wavelength", "radiation",
    )
    return report.validation(materialize(told, "declared"), atoms, ops, where, bonds, found)


_WEIGHTS = "CASE sym " + " ".join(f"WHEN '{k}' THEN {WEIGHT[k]!r}::DOUBLE" for k in ("H", "C", "N", "O")) + " END"
_ELECTRONS = "CASE sym " + " ".join(f"WHEN '{k}' THEN {report.NUMBERS[k]}" for k in ("H", "C", "N", "O")) + " END"
_SUMMED = f"""mm AS (SELECT structure, sum(occ * {_WEIGHTS}) AS mass, sum(occ * {_ELECTRONS})::DOUBLE AS electrons, string_agg(DISTINCT sym, ' ' ORDER BY sym) AS elements, count(DISTINCT sym) AS n_elements FROM im GROUP BY 1),
oo AS (SELECT structure, count(*) AS n_ops FROM ({OPS_SQL}) GROUP BY 1), sp AS (SELECT structure, count(*) AS n FROM (SELECT structure, idx, count(*) AS orbit FROM im GROUP BY ALL) JOIN oo USING (structure) WHERE orbit < n_ops GROUP BY 1),
bb AS (SELECT structure, count(*) AS n, count(*) FILTER (o) AS n_out FROM (SELECT structure, least(label_i, label_j) AS a, greatest(label_i, label_j) AS b, round(d, 2) AS d, bool_or(abs(d - expected) > .25) AS o FROM bd GROUP BY ALL) GROUP BY 1),
hh AS (SELECT structure, count(*) FILTER (kind = 'hbond') AS n_h, count(*) FILTER (kind = 'contact') AS n_c FROM ff WHERE k = 1 GROUP BY 1), su AS (SELECT structure, count(*) AS n FROM (SELECT DISTINCT structure, donor, acceptor FROM ff WHERE kind = 'disorder') GROUP BY 1),
de AS (SELECT d.*, a * m22 * m33 AS made, a * m22 * m33 * by_volume AS told, {CELL_DENSITY!r}::DOUBLE * mass / (a * m22 * m33) * by_density AS density, electrons * by_f000 AS f000, mass, electrons, elements, n_elements, n_ops, CAST(cl.kind AS INT) AS kind
  FROM ({DECLARED_SQL}) d JOIN cl USING (structure) JOIN mm USING (structure) JOIN oo USING (structure)),
dd AS (SELECT *, coalesce(told, made) AS v, {CELL_DENSITY!r}::DOUBLE * mass / v AS d1, {FORMULA_DENSITY!r}::DOUBLE * mass / v AS d2, density / d2 AS r, coalesce(abs(d1 - density) / density < .03, false) AS ok1, coalesce(abs(d2 - density) / density < .03, false) AS ok2 FROM de),
va AS (SELECT *, CASE WHEN density IS NULL THEN 'not_declared' WHEN ok1 AND ok2 THEN 'consistent' WHEN ok1 THEN 'declared_off' WHEN ok2 THEN 'expansion_wrong' ELSE 'cell_off' END AS branch,
  CASE WHEN r IS NULL THEN NULL WHEN r < .9 OR r > 1.1 THEN 'A' WHEN r < .95 OR r > 1.05 THEN 'B' WHEN r < .99 OR r > 1.01 THEN 'C' END AS alert, coalesce(abs(electrons - f000) / f000 > .05, false) AS f_off,
  CASE WHEN wavelength IS NULL THEN 'not_declared' WHEN radiation IS NOT NULL THEN 'other_source' WHEN wavelength = 1.3::DOUBLE THEN 'unusual' ELSE 'standard' END AS wave, CASE wavelength WHEN 0.71073::DOUBLE THEN ' Mo' WHEN 1.5418::DOUBLE THEN ' Cu-Ka' WHEN 0.56086::DOUBLE THEN ' Ag' ELSE '' END AS source,
  (['{"', '".join(_NAMES)}'])[kind + 1] AS own FROM dd),
re AS (SELECT structure, 1 AS place, 'A' AS block, 'volume' AS item, made AS number, CASE WHEN told IS NULL THEN 'not declared' ELSE printf('declared %.2f', told) END AS text, CASE WHEN coalesce(abs(made - told) / told > .01, false) THEN 'WARN' ELSE 'INFO' END AS severity FROM va
  UNION ALL SELECT structure, 2, 'A', 'density', d1, branch || CASE WHEN density IS NULL THEN '' ELSE printf(', declared %.4f', density) END, CASE WHEN branch = 'expansion_wrong' THEN 'FAIL' WHEN branch IN ('declared_off', 'cell_off') THEN 'WARN' ELSE 'INFO' END FROM va
  UNION ALL SELECT structure, 3, 'A', 'density ratio', r, coalesce(alert || '-alert', ''), CASE WHEN alert IN ('A', 'B') THEN 'WARN' ELSE 'INFO' END FROM va
  UNION ALL SELECT structure, 4, 'A', 'F(000)', electrons, CASE WHEN f000 IS NULL THEN 'not declared' ELSE printf('declared %.2f', f000) END, CASE WHEN f_off THEN 'WARN' ELSE 'INFO' END FROM va
  UNION ALL SELECT structure, 5, 'A', 'elements', n_elements, elements, 'INFO' FROM va
  UNION ALL SELECT structure, 6, 'A', 'wavelength', wavelength, wave || source, CASE WHEN wave = 'unusual' THEN 'WARN' ELSE 'INFO' END FROM va
  UNION ALL SELECT structure, 7, 'A', 'space group', n_ops, CASE WHEN name <> own THEN 'incomplete: ' ELSE 'consistent: ' END || name || ' / ' || own, CASE WHEN name <> own THEN 'WARN' ELSE 'INFO' END FROM va
  UNION ALL SELECT structure, 8, 'A', 'special positions', coalesce(n, 0), '', 'INFO' FROM va LEFT JOIN sp USING (structure)
  UNION ALL SELECT structure, 9, 'B', 'bonds', coalesce(n, 0), '', 'INFO' FROM va LEFT JOIN bb USING (structure)
  UNION ALL SELECT structure, 10, 'B', 'outlying bonds', coalesce(n_out, 0), '', CASE WHEN n_out > 0 THEN 'WARN' ELSE 'INFO' END FROM va LEFT JOIN bb USING (structure)
  UNION ALL SELECT structure, 11, 'C', 'hydrogen bonds', coalesce(n_h, 0), '', 'INFO' FROM va LEFT JOIN hh USING (structure) UNION ALL SELECT structure, 12, 'C', 'contacts', coalesce(n_c, 0), '', 'INFO' FROM va LEFT JOIN hh USING (structure)
  UNION ALL SELECT structure, 13, 'C', 'suppressed', coalesce(n, 0), '', 'INFO' FROM va LEFT JOIN su USING (structure))"""
_REPORT_SQL = f"WITH RECURSIVE {SITES_SQL}, {CLUSTER_SQL}, {BONDS_SQL}, {HYDROGEN_SQL}, {_SUMMED}"


@register(_REPORT_SQL + " SELECT structure, CAST(place AS INT) AS place, block, item, round(number, 6) AS number, text, severity FROM re")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirteen findings about every structure."""
    return rounded(_report(spark, sf_dir))


@register(_REPORT_SQL + """, ln AS (SELECT structure, place, severity, CASE place WHEN 1 THEN 'Crystal data' || chr(10) WHEN 9 THEN 'Geometry' || chr(10) WHEN 11 THEN 'Hydrogen bonds' || chr(10) ELSE '' END || '  ' || rpad(item, 18, ' ') || lpad(coalesce(printf('%.4f', number::DOUBLE), '-'), 14, ' ')
  || CASE WHEN text = '' THEN '' ELSE '  ' || text END || CASE WHEN severity = 'INFO' THEN '' ELSE '  [' || severity || ']' END AS line FROM re)
SELECT structure, CASE WHEN bool_or(severity = 'FAIL') THEN 'FAIL' WHEN bool_or(severity = 'WARN') THEN 'WARN' ELSE 'INFO' END AS severity, string_agg(line, chr(10) ORDER BY place) AS text FROM ln GROUP BY 1""".replace(", ln AS (", ", lx AS (").replace("FROM ln GROUP", "FROM lx GROUP"))
def validation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same written out, a text for each structure."""
    return report.table_text(_report(spark, sf_dir))
