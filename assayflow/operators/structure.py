"""Crystal structures as tables: symmetry expansion, bonds, hydrogen bonds, densities, displacement tensors.

atoms: label, sym, x, y, z (fractions of the cell), occ, assembly, grp; ops: op, and the rows of the rotation
r11..r33 and translation t1..t3. A structure has thousands of atoms at most; a table may hold many structures by key.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .spatial import near_pairs

# Fixed values, by element: standard atomic weights, covalent radii and van der Waals radii in angstrom.
WEIGHT = {"H": 1.008, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Na": 22.990, "Mg": 24.305, "Si": 28.085, "P": 30.974, "S": 32.06, "Cl": 35.45, "K": 39.098, "Ca": 40.078, "Fe": 55.845, "Cu": 63.546, "Zn": 65.38, "Br": 79.904, "I": 126.904}
COVALENT = {"H": 0.31, "C": 0.76, "N": 0.71, "O": 0.66, "F": 0.57, "Na": 1.66, "Mg": 1.41, "Si": 1.11, "P": 1.07, "S": 1.05, "Cl": 1.02, "K": 2.03, "Ca": 1.76, "Fe": 1.32, "Cu": 1.32, "Zn": 1.22, "Br": 1.20, "I": 1.39}
VAN_DER_WAALS = {"H": 1.20, "C": 1.70, "N": 1.55, "O": 1.52, "F": 1.47, "P": 1.80, "S": 1.80, "Cl": 1.75, "Br": 1.85, "I": 1.98}
OTHER_VAN_DER_WAALS = 1.70
# Bond tolerance, shortest bond, closest disordered sites, outlying bond; neutron X-H lengths.
BOND_TOLERANCE, SHORTEST, DISORDERED, OUTLYING = 0.40, 0.4, 0.90, 0.25
NEUTRON = {"C": 1.083, "N": 1.009, "O": 0.983}
DONORS, ACCEPTORS = ("N", "O"), ("N", "O", "F", "S", "Cl")
ANGLE, CONTACT_ANGLE, LONGEST_DA = 120.0, 90.0, 4.0
# Grams per cell of daltons and cubic angstrom, from the expanded cell and from the formula.
CELL_DENSITY, FORMULA_DENSITY = 1.66054, 1.66042


def lookup(sym: Column, values: dict[str, float], other: float | None = None) -> Column:
    found = F.element_at(F.create_map(*[F.lit(v) for kv in values.items() for v in kv]), sym)
    return found if other is None else F.coalesce(found, F.lit(other))


def element_of(type_symbol: Column, label: Column) -> Column:
    """Element of a type symbol such as O2- or Fe3+, else of a label; '' if neither is known."""
    def one(text: Column) -> Column:
        letters = F.regexp_extract(F.coalesce(text, F.lit("")), "^([A-Za-z]{1,2})", 1)
        two, single = F.initcap(letters), F.upper(F.substring(letters, 1, 1))
        known = lambda c: F.when(c.isin(*WEIGHT), c)
        return F.coalesce(known(two), known(single))

    return F.coalesce(one(type_symbol), one(label), F.lit(""))


def cell_volume(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    ca, cb, cg = (F.cos(F.radians(v)) for v in (alpha, beta, gamma))
    return a * b * c * F.sqrt(1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg)


def cartesian(cell: tuple[float, ...]) -> np.ndarray:
    """Columns are the cell vectors, the first along x, the second in the xy plane."""
    a, b, c, al, be, ga = cell
    ca, cb, cg, sg = math.cos(math.radians(al)), math.cos(math.radians(be)), math.cos(math.radians(ga)), math.sin(math.radians(ga))
    n = (ca - cb * cg) / sg
    return np.array([[a, b * cg, c * cb], [0, b * sg, c * n], [0, 0, c * math.sqrt(max(0.0, 1 - cb * cb - n * n))]])


def to_cartesian(atoms: DataFrame, cell: tuple[float, ...]) -> DataFrame:
    m = cartesian(cell)
    xyz = [sum(float(m[i, j]) * F.col(c) for j, c in enumerate("xyz")) for i in range(3)]
    return atoms.withColumns(dict(zip("xyz", xyz)))


def symmetry_ops(spark: SparkSession, triplets: list[str]) -> DataFrame:
    """Operations written as x,y,z triplets, parsed to rotations and translations, numbered from 0."""
    rows = spark.createDataFrame(list(enumerate(triplets)), "op int, text string").withColumn("part", F.split(F.lower(F.regexp_replace("text", r"\s", "")), ","))
    out = rows.select("op")
    for i in range(3):
        p = F.get("part", F.lit(i))
        rows = rows.withColumns({f"r{i + 1}{j + 1}": F.when(p.rlike(f"-{v}"), -1).when(p.rlike(v), 1).otherwise(0) for j, v in enumerate("xyz")})
        top, bottom = F.regexp_extract(p, r"([+-]?\d+(?:[.]\d+)?)(?:/(\d+))?", 1), F.regexp_extract(p, r"([+-]?\d+(?:[.]\d+)?)/(\d+)", 2)
        rows = rows.withColumn(f"t{i + 1}", F.coalesce(F.nullif(top, F.lit("")).cast("double"), F.lit(0.0)) / F.coalesce(F.nullif(bottom, F.lit("")).cast("double"), F.lit(1.0)))
    return rows.select(*out.columns, *[f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)], "t1", "t2", "t3")


def expand(atoms: DataFrame, ops: DataFrame) -> DataFrame:
    """All images within the cell; of images of one element at one place to two decimals the first stays."""
    images = atoms.crossJoin(F.broadcast(ops))  # at most 192 operations
    for i, c in enumerate("xyz", 1):
        v = F.col(f"r{i}1") * F.col("x") + F.col(f"r{i}2") * F.col("y") + F.col(f"r{i}3") * F.col("z") + F.col(f"t{i}")
        images = images.withColumn(f"n{c}", F.round(v - F.floor(v + 1e-9), 9))
    key = [F.pmod(F.round(100 * F.col(f"n{c}")).cast("int"), F.lit(100)).alias(f"k{c}") for c in "xyz"]
    images = images.select(*[c for c in atoms.columns if c not in "xyz"], "op", F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("nz").alias("z"), *key)
    first = F.row_number().over(Window.partitionBy("sym", "kx", "ky", "kz").orderBy("idx", "op"))
    return images.withColumn("__k", first).filter("__k = 1").drop("__k", "kx", "ky", "kz")


def lattice(atoms: DataFrame, low: int = -1, high: int = 1) -> DataFrame:
    """Atoms of all neighbouring cells, with the shift du, dv, dw."""
    out = atoms
    for d, c in zip(("du", "dv", "dw"), "xyz"):
        out = out.withColumn(d, F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn(c, F.col(c) + F.col(d))
    return out


def element_counts(atoms: DataFrame, by: list[str] | None = None) -> DataFrame:
    return atoms.groupBy(*(by or []), "sym").agg(F.sum("occ").alias("n"))


def density_check(atoms: DataFrame, volume: float, formula_weight: float, z: int, declared: float | None) -> DataFrame:
    """One row: density from the expanded cell, from the formula and as declared, and whether they agree within 3 %."""
    mass = F.sum(F.col("occ") * lookup(F.col("sym"), WEIGHT))
    out = atoms.agg((CELL_DENSITY * mass / volume).alias("from_cell")).withColumn("from_formula", F.lit(FORMULA_DENSITY * formula_weight * z / volume)).withColumn("declared", F.lit(declared).cast("double"))
    close = lambda a, b: F.abs(ratio(F.col(a) - F.col(b), F.col(b))) <= 0.03
    verdict = F.when(~close("from_cell", "from_formula"), F.when(F.col("declared").isNull(), "atoms and formula differ").when(close("from_cell", "declared"), "formula is off").when(close("from_formula", "declared"), "atoms are missing or too many").otherwise("none agree"))
    return out.withColumn("verdict", verdict.when(F.col("declared").isNull(), "agree, none declared").when(close("from_formula", "declared"), "agree").otherwise("declared is off"))


# Closeness of densities and of formula weights, shortest list of atoms, counts' tolerance, F(000)'s, alerts.
CLOSE, WEIGHT_OFF, ATOMS_SHORT, COUNTS_OFF, COUNT_LEAST, F000_OFF = 0.03, 0.01, 0.5, 0.05, 0.15, 0.05
RATIO_ALERTS = (("A", 0.10), ("B", 0.05), ("C", 0.01))


def density_review(structures: DataFrame) -> DataFrame:
    """structures with three densities, the first branch that applies, the ratio alert, F(000)'s check and severity.

    Needs volume, mass and electrons (of the expanded cell), counts (element -> atoms in the cell), formula (element ->
    atoms, or null), and as declared, any of them null: weight, z, density, f000. density_cell comes from the expanded
    cell, density_formula from weight and z. The branches, in order: not_declared, consistent, declared_off (the
    formula's density differs), weight_off, atoms_missing, expansion_wrong (FAIL), cell_off, pass.
    """
    v = F.when(F.col("volume") > 0, F.col("volume"))
    made = structures.withColumn("density_cell", ratio(CELL_DENSITY * F.col("mass"), v)).withColumn("density_formula", ratio(FORMULA_DENSITY * F.when(F.col("weight") != 0, F.col("weight")) * F.when(F.col("z") != 0, F.col("z")), v))
    near = lambda a: F.coalesce(F.abs(ratio(F.col(a) - F.col("density"), F.col("density"))) < CLOSE, F.lit(False))
    cell_ok, formula_ok, have = near("density_cell"), near("density_formula"), F.col("density_formula").isNotNull()
    elements = F.coalesce(F.map_entries("formula"), F.array().cast("array<struct<key:string,value:double>>"))
    some = (F.size(elements) > 0) & F.coalesce(F.col("z") != 0, F.lit(False))
    weigh = lambda e: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHT.items() for x in kv]), e["key"]), F.lit(0.0)) * e["value"]
    formula_weight = F.aggregate(elements, F.lit(0.0), lambda s, e: s + weigh(e))
    weight_off = F.coalesce((formula_weight > 0) & (F.abs(ratio(formula_weight - F.col("weight"), F.col("weight"))) > WEIGHT_OFF), F.lit(False))
    held = lambda e: F.coalesce(F.try_element_at("counts", e["key"]), F.lit(0.0))
    match = some & F.forall(elements, lambda e: F.abs(held(e) - e["value"] * F.col("z")) <= F.greatest(COUNTS_OFF * e["value"] * F.col("z"), F.lit(COUNT_LEAST)))
    atoms = F.aggregate(F.map_values("counts"), F.lit(0.0), lambda s, n: s + n)
    short = some & (atoms < F.aggregate(elements, F.lit(0.0), lambda s, e: s + e["value"] * F.col("z")) - ATOMS_SHORT)
    branch = (
        F.when(F.col("density").isNull(), "not_declared").when(cell_ok & (formula_ok | ~have), "consistent").when(have & cell_ok & ~formula_ok, "declared_off")
        .when(~cell_ok & weight_off & match, "weight_off").when(~cell_ok & short, "atoms_missing").when(~cell_ok & match & have & formula_ok, "expansion_wrong")
        .when(~cell_ok, "cell_off").otherwise("pass")
    )
    made = made.withColumn("branch", branch).withColumn("ratio", ratio(F.col("density"), F.col("density_formula")))
    alert = F.when(F.col("ratio").isNull(), None)
    for name, off in RATIO_ALERTS:
        alert = alert.when(~F.col("ratio").between(1 - off, 1 + off), name)
    made = made.withColumn("alert", alert).withColumn("f000_off", F.coalesce(F.abs(ratio(F.col("electrons") - F.col("f000"), F.col("f000"))) > F000_OFF, F.lit(False)))
    warn = F.col("branch").isin("declared_off", "weight_off", "atoms_missing", "cell_off") | F.coalesce(F.col("alert").isin("A", "B"), F.lit(False)) | F.col("f000_off")
    return made.withColumn("severity", F.when(F.col("branch") == "expansion_wrong", "FAIL").when(warn, "WARN").otherwise("INFO"))


def bonds_and_contacts(found: DataFrame) -> DataFrame:
    """hydrogen_bonds() as asserted bonds and then contacts, in one table with `asserted`; other kinds are left out."""
    part = lambda kind, asserted: found.filter(F.col("kind") == kind).withColumn("asserted", F.lit(asserted))
    return part("hbond", True).unionByName(part("contact", False))


def alternatives(atoms: DataFrame) -> DataFrame:
    """Pairs of labels that exclude each other: one element's part-occupied sites too close, or groups of an assembly."""
    near = near_pairs(atoms, atoms, DISORDERED)
    part = near.filter((F.col("l.idx") < F.col("r.idx")) & (F.col("l.sym") == F.col("r.sym")) & (F.col("l.occ") < 0.999) & (F.col("r.occ") < 0.999) & (F.col("d") < DISORDERED))
    named = atoms.filter("assembly is not null").select("label", "assembly", "grp")
    other = named.alias("l").join(named.alias("r"), (F.col("l.assembly") == F.col("r.assembly")) & (F.col("l.grp") != F.col("r.grp")) & (F.col("l.label") < F.col("r.label")))
    pair = lambda df: df.select(F.least("l.label", "r.label").alias("src"), F.greatest("l.label", "r.label").alias("dst"))
    return pair(part).unionByName(pair(other)).distinct()


def bonds(atoms: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Bonded pairs of atoms in cartesian coordinates: i, j (i < j), label_i, label_j, d, expected, outlying."""
    reach = 2 * max(COVALENT.values()) + BOND_TOLERANCE
    pairs = near_pairs(atoms, atoms, reach).filter(F.col("l.idx") < F.col("r.idx"))
    expected = lookup(F.col("l.sym"), COVALENT) + lookup(F.col("r.sym"), COVALENT)
    pairs = pairs.withColumn("expected", expected).filter((F.col("d") > SHORTEST) & (F.col("d") <= F.col("expected") + BOND_TOLERANCE))
    pairs = pairs.filter(~((F.col("l.occ") < 1) & (F.col("r.occ") < 1) & (F.col("d") < DISORDERED)))
    out = pairs.select(F.col("l.idx").alias("i"), F.col("r.idx").alias("j"), F.col("l.label").alias("label_i"), F.col("r.label").alias("label_j"), F.col("l.sym").alias("sym_i"), F.col("r.sym").alias("sym_j"), "d", "expected")
    out = out.withColumn("outlying", F.abs(F.col("d") - F.col("expected")) > OUTLYING)
    if excluded is not None:
        out = out.join(excluded, (F.least("label_i", "label_j") == F.col("src")) & (F.greatest("label_i", "label_j") == F.col("dst")), "left_anti")
    return out


def distance_class(d: Column) -> Column:
    return F.when((d >= 2.2) & (d < 2.5), "strong").when((d >= 2.5) & (d < 3.2), "moderate").when((d >= 3.2) & (d < 4.0), "weak").otherwise("long")


def hydrogen_bonds(atoms: DataFrame) -> DataFrame:
    """Donor, hydrogen and acceptor triples within reach: labels, da, ha, angle, kind, strength.

    A hydrogen belongs to its nearest heavier atom, if that is a bonded donor; it is moved to the neutron length
    along the bond. kind: hbond, contact, bent or far, by the moved hydrogen.
    """
    heavy, hydrogen = atoms.filter("sym <> 'H'"), atoms.filter("sym = 'H'")
    owned = near_pairs(hydrogen, heavy, 2.0).groupBy("l").agg(F.min_by(F.struct("r", "d"), F.struct("d", F.col("r.idx"))).alias("o"))
    limit = lookup(F.col("o.r.sym"), COVALENT) + COVALENT["H"] + BOND_TOLERANCE
    owned = owned.filter(F.col("o.r.sym").isin(*DONORS) & (F.col("o.d") > SHORTEST) & (F.col("o.d") <= limit))
    stretch = lookup(F.col("o.r.sym"), NEUTRON) / F.col("o.d")
    moved = {f"h{c}": F.col(f"o.r.{c}") + stretch * (F.col(f"l.{c}") - F.col(f"o.r.{c}")) for c in "xyz"}
    donors = owned.select(F.col("o.r.label").alias("donor"), F.col("o.r.idx").alias("donor_idx"), F.col("l.label").alias("hydrogen"), *[F.col(f"o.r.{c}").alias(c) for c in "xyz"], *[v.alias(k) for k, v in moved.items()])
    pairs = near_pairs(donors, heavy.filter(F.col("sym").isin(*ACCEPTORS)), LONGEST_DA).filter((F.col("l.donor_idx") != F.col("r.idx")) & (F.col("d") >= SHORTEST))
    hd = [F.col(f"l.{c}") - F.col(f"l.h{c}") for c in "xyz"]
    ha = [F.col(f"r.{c}") - F.col(f"l.h{c}") for c in "xyz"]
    size = lambda v: F.sqrt(sum(x * x for x in v))
    cosine = ratio(sum(u * v for u, v in zip(hd, ha)), size(hd) * size(ha))
    out = pairs.select(F.col("l.donor").alias("donor"), F.col("l.hydrogen").alias("hydrogen"), F.col("r.label").alias("acceptor"), F.col("d").alias("da"), size(ha).alias("ha"), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))).alias("angle"), (lookup(F.col("r.sym"), VAN_DER_WAALS, OTHER_VAN_DER_WAALS) + VAN_DER_WAALS["H"]).alias("reach"))
    kind = F.when(F.col("ha") > F.col("reach"), "far").when(F.col("angle") >= ANGLE, "hbond").when(F.col("angle") >= CONTACT_ANGLE, "contact").otherwise("bent")
    return out.withColumn("kind", kind).withColumn("strength", distance_class(F.col("da"))).drop("reach")


def matching(found: DataFrame, listed: DataFrame, column: str, within: float = 0.03) -> DataFrame:
    """Rows of found with some listed value nearer than within: a semi-join on buckets of that width."""
    put = listed.select(F.col(column).alias("__v")).withColumn("__b", F.explode(F.array(*[F.floor(F.col("__v") / within) + k for k in (-1, 0, 1)])))
    return found.withColumn("__at", F.floor(F.col(column) / within)).join(put, (F.col("__at") == F.col("__b")) & (F.abs(F.col(column) - F.col("__v")) < within), "left_semi").drop("__at")


def missing_elements(atoms: DataFrame, known: DataFrame) -> DataFrame:
    return atoms.select("sym").distinct().join(known.select("sym"), "sym", "left_anti")


def u_equivalent(u11: Column, u22: Column, u33: Column) -> Column:
    """A third of the trace of a cartesian displacement tensor."""
    return (u11 + u22 + u33) / 3
