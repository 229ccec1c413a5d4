"""Reviews of a structure: radiation, symmetry, special positions, displacement tensors, packing, and text about them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from .spatial import near_pairs
from .structure import BOND_TOLERANCE, COVALENT, SHORTEST, cartesian, lookup

# K alpha wavelengths in angstrom by source.
STANDARD = {"Cu-Ka": 1.5418, "Cu-Ka1": 1.5406, "Mo": 0.71073, "Ag": 0.56086, "Ga": 1.3414, "In": 0.51359}
WAVELENGTH_TOLERANCE, PLACE_TOLERANCE, CODE_TOLERANCE = 5e-4, 3e-3, 2e-2
# Numbers of operations of common space groups.
ORDERS = {"P1": 1, "P-1": 2, "P21": 2, "Pc": 2, "P21/m": 4, "P21/c": 4, "P21/n": 4, "C2/c": 8, "P212121": 4, "Pbca": 8, "Pnma": 8, "Pna21": 4, "I41/a": 16, "R-3": 18, "Fm-3m": 192}
#: Fewest values that a mean bar may stand for.
LEAST_FOR_MEAN = 3


def worst(findings: DataFrame, by: list[str], strict: bool = False) -> DataFrame:
    """The worst severity (INFO, WARN, FAIL) of each group's findings and their number. strict: a FAIL is an error."""
    rank = F.create_map(F.lit("INFO"), F.lit(0), F.lit("WARN"), F.lit(1), F.lit("FAIL"), F.lit(2))
    out = findings.groupBy(*by).agg(F.max_by("severity", F.element_at(rank, F.col("severity"))).alias("severity"), F.count("*").alias("n"))
    if not strict:
        return out
    context = F.concat_ws(", ", *[F.col(c).cast("string") for c in by])
    return out.withColumn("severity", F.when(F.col("severity") == "FAIL", F.raise_error(F.concat(F.lit("gate failed: "), context)).cast("string")).otherwise(F.col("severity")))


def wavelength_review(rows: DataFrame, wavelength: str, radiation: str) -> DataFrame:
    """rows with source (the nearest standard, if near enough), code and severity of the declared wavelength."""
    w, kind = F.col(wavelength).cast("double"), F.lower(F.coalesce(radiation, F.lit("")))
    gaps = F.array(*[F.struct(F.abs(w - v).alias("gap"), F.lit(k).alias("name")) for k, v in STANDARD.items()])
    near = F.array_min(F.filter(gaps, lambda g: g["gap"] < WAVELENGTH_TOLERANCE))
    code = F.when(w.isNull(), "not_declared").when(kind.rlike("neutron|synchrotron|electron"), "other_source").when(near.isNotNull(), "standard").otherwise("unusual")
    return rows.withColumn("code", code).withColumn("source", F.when(F.col("code") == "standard", near["name"])).withColumn("severity", F.when(F.col("code") == "unusual", "WARN").otherwise("INFO"))


def wavelength_used(asked: Column, declared: Column, other: float = 1.5406) -> tuple[Column, Column]:
    """The wavelength to calculate with and where it is from: asked for, declared, or copper."""
    return F.coalesce(asked, declared, F.lit(other)), F.when(asked.isNotNull(), "setting").when(declared.isNotNull(), "file").otherwise("default")


def group_review(structures: DataFrame, name: str, n_ops: str) -> DataFrame:
    """Whether the number of operations is that of the named group; a group not listed is only noted."""
    order = lookup(F.regexp_replace(name, r"\s", ""), {k: float(v) for k, v in ORDERS.items()}).cast("int")
    code = F.when(order.isNull(), "not_listed").when(order != F.col(n_ops), "incomplete").otherwise("consistent")
    return structures.withColumn("order", order).withColumn("code", code).withColumn("severity", F.when(F.col("code") == "incomplete", "WARN").otherwise("INFO"))


def _images(atoms: DataFrame, ops: DataFrame) -> DataFrame:
    rows = atoms.crossJoin(F.broadcast(ops))  # at most 192 operations
    return rows.withColumns({f"p{c}": sum(F.col(f"r{i}{j}") * F.col(v) for j, v in enumerate("xyz", 1)) + F.col(f"t{i}") for i, c in enumerate("xyz", 1)})


def special_positions(atoms: DataFrame, ops: DataFrame) -> DataFrame:
    """Atoms with fewer different images than operations: label, sym, orbit, n_ops."""
    rows = _images(atoms, ops).groupBy("idx", "label", "sym").agg(F.array_sort(F.collect_list(F.struct("op", "px", "py", "pz"))).alias("im"))

    def same(a: Column, b: Column) -> Column:
        off = lambda c: F.abs(a[c] - b[c] - F.round(a[c] - b[c]))
        return (off("px") < PLACE_TOLERANCE) & (off("py") < PLACE_TOLERANCE) & (off("pz") < PLACE_TOLERANCE)

    first = F.filter("im", lambda a: ~F.exists("im", lambda b: (b["op"] < a["op"]) & same(a, b)))
    return rows.select("label", "sym", F.size(first).alias("orbit"), F.size("im").alias("n_ops")).filter("orbit < n_ops")


def symmetry_codes(images: DataFrame, atoms: DataFrame, ops: DataFrame) -> DataFrame:
    """images (label, x, y, z) with code n_pqr: the first operation and lattice shift that give them; '.' is itself, '?' none."""
    made = _images(atoms, ops).select(F.col("label").alias("of"), "op", "px", "py", "pz")
    pairs = images.join(made, F.col("label") == F.col("of"), "left")
    shifts = {f"s{c}": F.round(F.col(c) - F.col(f"p{c}")).cast("int") for c in "xyz"}
    pairs = pairs.withColumns(shifts)
    fits = sum((F.abs(F.col(f"p{c}") + F.col(f"s{c}") - F.col(c)) <= CODE_TOLERANCE + 1e-5 * F.abs(F.col(c))).cast("int") for c in "xyz") == 3
    best = F.min(F.when(fits, F.struct("op", "sx", "sy", "sz"))).alias("b")
    out = pairs.groupBy("label", "x", "y", "z").agg(best)
    still = (F.col("b.op") == 0) & (F.col("b.sx") == 0) & (F.col("b.sy") == 0) & (F.col("b.sz") == 0)
    text = F.concat((F.col("b.op") + 1).cast("string"), F.lit("_"), *[(F.col(f"b.s{c}") + 5).cast("string") for c in "xyz"])
    return out.select("label", "x", "y", "z", F.when(F.col("b").isNull(), "?").when(still, ".").otherwise(text).alias("code"))


_FRACTIONS = {round(a / b, 4): f"{a}/{b}" for b in (2, 3, 4, 6) for a in range(1, 6 * b) if np.gcd(a, b) == 1}


def operation_text(codes: DataFrame, ops: DataFrame, code: str = "code") -> DataFrame:
    """codes with operation: the code n_pqr written out as, say, '-x+1, y+1/2, -z'; other codes stay."""
    keyed = codes.withColumn("__op", F.regexp_extract(code, r"^(\d+)_\d{3}$", 1).try_cast("int") - 1)
    rows = keyed.join(F.broadcast(ops.withColumnRenamed("op", "__of")), F.col("__op") == F.col("__of"), "left")

    def axis(i: int) -> Column:
        terms = F.concat(*[F.when(F.col(f"r{i}{j}") == 1, f"+{v}").when(F.col(f"r{i}{j}") == -1, f"-{v}").otherwise("") for j, v in enumerate("xyz", 1)])
        shift = F.substring(F.split(code, "_")[1], i, 1).try_cast("int") - 5
        whole = F.col(f"t{i}") + shift
        broken = F.element_at(F.create_map(*[F.lit(x) for kv in _FRACTIONS.items() for x in kv]), F.round(F.abs(whole), 4))
        size = F.when(whole == F.floor(whole), F.abs(whole).cast("int").cast("string")).otherwise(F.coalesce(broken, F.round(F.abs(whole), 4).cast("string")))
        return F.regexp_replace(F.concat(terms, F.when(whole > 0, F.concat(F.lit("+"), size)).when(whole < 0, F.concat(F.lit("-"), size)).otherwise("")), "^[+]", "")

    text = F.concat_ws(", ", axis(1), axis(2), axis(3))
    return rows.select(*codes.columns, F.when(F.col("__of").isNull(), F.col(code)).otherwise(text).alias("operation"))


def roman(n: Column) -> Column:
    """Small roman numerals, for numbering symmetry keys."""
    out = F.repeat(F.lit("i"), n)
    for a, b in (("iiiii", "v"), ("vv", "x"), ("iiii", "iv"), ("viv", "ix")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def displacement(atoms: DataFrame, cell: tuple[float, ...]) -> DataFrame:
    """atoms (u11 u22 u33 u12 u13 u23 of the file) with the cartesian tensor c11..c23 and u_eq, a third of its trace."""
    m = cartesian(cell)
    inverse = np.linalg.inv(m)
    a = m @ np.diag(np.linalg.norm(inverse, axis=1))
    u = lambda i, j: F.col(f"u{min(i, j)}{max(i, j)}")
    tensor = {f"c{i}{j}": sum(float(a[i - 1, p - 1] * a[j - 1, q - 1]) * u(p, q) for p in (1, 2, 3) for q in (1, 2, 3)) for i, j in ((1, 1), (2, 2), (3, 3), (1, 2), (1, 3), (2, 3))}
    return atoms.withColumns(tensor).withColumn("u_eq", (F.col("c11") + F.col("c22") + F.col("c33")) / 3)


def ellipsoid_axes(atoms: DataFrame, share: float = 0.5, key: str = "label") -> DataFrame:
    """key, semi axes (short to long) of the ellipsoid that holds a share of the density; null if it isn't one."""
    scale = dist.chi2_ppf(share, 3) ** 0.5
    names = ["c11", "c22", "c33", "c12", "c13", "c23"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = np.column_stack([b.column(n).to_numpy(zero_copy_only=False) for n in names])
            values = np.linalg.eigvalsh(c[:, [0, 3, 4, 3, 1, 5, 4, 5, 2]].reshape(-1, 3, 3))
            axes = [(scale * np.sqrt(v)).tolist() if (v > 1e-9).all() else None for v in values]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(axes, pa.list_(pa.float64()))], names=[key, "axes"])

    return atoms.select(key, *names).mapInArrow(run, f"{key} {atoms.schema[key].dataType.simpleString()}, axes array<double>")


def without_carbon_hydrogens(atoms: DataFrame) -> DataFrame:
    """atoms in cartesian coordinates without hydrogens whose nearest heavier atom is a bonded carbon."""
    reach = max(COVALENT.values()) + COVALENT["H"] + BOND_TOLERANCE
    near = near_pairs(atoms.filter("sym = 'H'"), atoms.filter("sym <> 'H'"), reach).groupBy(F.col("l.idx").alias("h")).agg(F.min(F.struct("d", F.col("r.idx").alias("i"), F.col("r.sym").alias("s"))).alias("b"))
    bonded = near.filter((F.col("b.s") == "C") & (F.col("b.d") > SHORTEST) & (F.col("b.d") <= COVALENT["C"] + COVALENT["H"] + BOND_TOLERANCE))
    return atoms.join(bonded.select("h"), F.col("idx") == F.col("h"), "left_anti")


def packed(atoms: DataFrame, molecule: str, cells: tuple[int, int, int]) -> DataFrame:
    """Atoms (fractions of the cell) of the molecules whose centre lies in a block of cells."""
    centre = atoms.groupBy(molecule).agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    inside = [(F.col(f"m{c}") >= -1e-4) & (F.col(f"m{c}") < n) for c, n in zip("xyz", cells)]
    return atoms.join(centre.filter(inside[0] & inside[1] & inside[2]).select(molecule), molecule, "left_semi")


def around(atoms: DataFrame, centre: DataFrame, radius: float) -> DataFrame:
    """Atoms within radius of centre that are not of it, told by position to two hundredths of an angstrom."""
    key = lambda: [F.round(50 * F.col(c)).cast("long").alias(f"k{c}") for c in "xyz"]
    near = near_pairs(atoms, centre, radius).select("l.*").distinct()
    keyed = near.select("*", *key())
    return keyed.join(centre.select(*key()).distinct(), ["kx", "ky", "kz"], "left_anti").drop("kx", "ky", "kz")


def verified(candidates: DataFrame, order: list[str], most: int, matches: Column) -> DataFrame:
    """The first candidates, up to `most`, that match; the bound is on what is checked, as a look-up costs a request."""
    return candidates.orderBy(*order).limit(most).filter(matches)


def cell_edges(spark, cell: tuple[float, ...]) -> DataFrame:
    """The twelve edges of a cell: start and end in cartesian coordinates."""
    m = cartesian(cell)
    corners = spark.range(8).select(*[(F.shiftright(F.col("id"), k) % 2).alias(c) for k, c in enumerate("uvw")])
    axes = F.array(*[F.struct(F.lit(c).alias("axis"), *[F.lit(int(c == d)).alias(f"d{d}") for d in "uvw"]) for c in "uvw"])
    e = corners.withColumn("e", F.explode(axes)).filter(F.when(F.col("e.axis") == "u", F.col("u")).when(F.col("e.axis") == "v", F.col("v")).otherwise(F.col("w")) == 0)
    at = lambda i, moved: sum(float(m[i, j]) * (F.col(c) + (F.col(f"e.d{c}") if moved else 0)) for j, c in enumerate("uvw"))
    return e.select(*[at(i, False).alias(f"{c}1") for i, c in enumerate("xyz")], *[at(i, True).alias(f"{c}2") for i, c in enumerate("xyz")])


def mean_or_points(df: DataFrame, by: list[str], value: str, least: int = LEAST_FOR_MEAN) -> DataFrame:
    """A mean with its deviation where a group has enough values, else the values themselves: by, kind, n, value, sd."""
    stats = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    few = df.join(stats.filter(F.col("n") < least).select(*by, "n"), by).select(*by, F.lit("point").alias("kind"), "n", F.col(value).cast("double").alias("value"), F.lit(None).cast("double").alias("sd"))
    return stats.filter(F.col("n") >= least).select(*by, F.lit("mean").alias("kind"), "n", F.col("mean").alias("value"), "sd").unionByName(few)


def calibration_text(models: DataFrame, by: str) -> DataFrame:
    """A sentence for each model, with four significant digits."""
    four = lambda c: F.format_string("%.4g", F.col(c))
    text = F.concat(F.lit("y = "), four("slope"), F.lit(" x + "), four("intercept"), F.lit("; R2 = "), four("r2"), F.lit("; n = "), F.col("n").cast("string"), F.lit("; LOD "), four("lod"), F.lit(", LOQ "), four("loq"))
    return models.select(by, text.alias("text"))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows of a small report numbered in roman numerals."""
    return df.withColumn("no", roman(F.row_number().over(Window.orderBy(*order))))
