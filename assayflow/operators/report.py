"""The review of many structures as one table of findings, and texts made from tables of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import groups, review, structure
from .crystals import basis

# Atomic numbers of the elements that have a weight here; the largest share by which a declared volume may be off.
NUMBERS = {"H": 1, "C": 6, "N": 7, "O": 8, "F": 9, "Na": 11, "Mg": 12, "Si": 14, "P": 15, "S": 16, "Cl": 17, "K": 19, "Ca": 20, "Fe": 26, "Cu": 29, "Zn": 30, "Br": 35, "I": 53}
VOLUME_OFF = 0.01
#: Items in the order of the report, with their block: crystal data, geometry, hydrogen bonds.
ITEMS = [("A", "volume"), ("A", "density"), ("A", "density ratio"), ("A", "F(000)"), ("A", "elements"), ("A", "wavelength"), ("A", "space group"), ("A", "special positions"), ("B", "bonds"), ("B", "outlying bonds"), ("C", "hydrogen bonds"), ("C", "contacts"), ("C", "suppressed")]


def cell_contents(placed: DataFrame) -> DataFrame:
    """structure, mass, electrons, counts (element -> atoms, by occupancy) of each expanded cell."""
    each = placed.groupBy("structure", "sym").agg(F.sum("occ").alias("n"))
    weigh = lambda values: F.sum(F.col("n") * F.coalesce(structure.lookup(F.col("sym"), {k: float(v) for k, v in values.items()}), F.lit(0.0)))
    return each.groupBy("structure").agg(weigh(structure.WEIGHT).alias("mass"), weigh(NUMBERS).alias("electrons"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("sym", "n")))).alias("counts"))


def special(atoms: DataFrame, placed: DataFrame, ops: DataFrame) -> DataFrame:
    """structure, idx, label, orbit, n_ops of atoms that have fewer places in the cell than there are operations."""
    n = ops.groupBy("structure").agg(F.count("*").alias("n_ops"))
    orbit = placed.groupBy("structure", "idx").agg(F.count("*").alias("orbit"))
    return atoms.select("structure", "idx", "label").join(orbit, ["structure", "idx"]).join(n, "structure").filter("orbit < n_ops")


def validation(structures: DataFrame, atoms: DataFrame, ops: DataFrame, placed: DataFrame, bonds: DataFrame, hydrogen_bonds: DataFrame) -> DataFrame:
    """structure, place, block, item, number, text, severity: all checks of every structure, in the order of ITEMS.

    structures: structure, the cell, and as declared, any of them null: name, volume, density, weight, z, f000,
    formula (element -> atoms), wavelength, radiation. placed, bonds and hydrogen_bonds are those of crystals.py.
    A structure without atoms has counts of none. Every table is summed up by structure before it is joined.
    """
    cells = basis(structures).select("structure", (F.col("m11") * F.col("m22") * F.col("m33")).alias("made"))
    rows = structures.join(cells, "structure").join(cell_contents(placed), "structure", "left")
    rows = rows.withColumns({"mass": F.coalesce("mass", F.lit(0.0)), "electrons": F.coalesce("electrons", F.lit(0.0)), "counts": F.coalesce("counts", F.create_map().cast("map<string,double>")), "told": F.col("volume")})
    rows = structure.density_review(rows.withColumn("volume", F.coalesce(F.nullif("told", F.lit(0.0)), "made")))
    rows = rows.withColumnsRenamed({"severity": "density_severity", "branch": "density_branch"})
    rows = review.wavelength_review(rows, "wavelength", "radiation").withColumnsRenamed({"code": "wave_code", "source": "wave_source", "severity": "wave_severity"})
    rows = groups.check(rows.withColumnRenamed("name", "declared"), ops).withColumnsRenamed({"code": "group_code", "severity": "group_severity"})
    pair = [F.least("label_i", "label_j").alias("a"), F.greatest("label_i", "label_j").alias("b")]
    kinds = bonds.select("structure", *pair, F.round("d", 2).alias("d"), "outlying").groupBy("structure", "a", "b", "d").agg(F.max("outlying").alias("outlying"))
    counts = [
        kinds.groupBy("structure").agg(F.count("*").alias("n_bonds"), F.count_if("outlying").alias("n_outlying")),
        hydrogen_bonds.groupBy("structure").agg(F.count_if(F.col("kind") == "hbond").alias("n_hbonds"), F.count_if(F.col("kind") == "contact").alias("n_contacts")),
        hydrogen_bonds.filter("kind = 'disorder'").select("structure", "donor", "acceptor").distinct().groupBy("structure").agg(F.count("*").alias("n_suppressed")),
        special(atoms, placed, ops).groupBy("structure").agg(F.count("*").alias("n_special")),
    ]
    for one in counts:
        rows = rows.join(one, "structure", "left")
    two, four = (lambda c: F.format_string("%.2f", F.col(c))), (lambda c: F.format_string("%.4f", F.col(c)))
    off = F.coalesce(F.abs(F.try_divide(F.col("made") - F.col("told"), F.col("told"))) > VOLUME_OFF, F.lit(False))
    elements = F.array_join(F.array_sort(F.map_keys("counts")), " ")
    missing = F.exists(F.map_keys("counts"), lambda s: ~s.isin(*structure.VAN_DER_WAALS))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    warn = lambda when: F.when(when, "WARN").otherwise("INFO")
    info, none = F.lit("INFO"), F.lit("")
    found = {
        "volume": (F.col("made"), F.when(F.col("told").isNull(), "not declared").otherwise(F.concat(F.lit("declared "), two("told"))), warn(off)),
        "density": (F.col("density_cell"), F.concat(F.col("density_branch"), F.when(F.col("density").isNull(), "").otherwise(F.concat(F.lit(", declared "), four("density")))), F.when(F.col("density_branch") == "expansion_wrong", "FAIL").otherwise(warn(F.col("density_branch").isin("declared_off", "weight_off", "atoms_missing", "cell_off")))),
        "density ratio": (F.col("ratio"), F.coalesce(F.concat("alert", F.lit("-alert")), none), warn(F.coalesce(F.col("alert").isin("A", "B"), F.lit(False)))),
        "F(000)": (F.col("electrons"), F.when(F.col("f000").isNull(), "not declared").otherwise(F.concat(F.lit("declared "), two("f000"))), warn(F.col("f000_off"))),
        "elements": (F.size("counts").cast("double"), F.concat(elements, F.when(missing, " (some without a radius of their own)").otherwise("")), info),
        "wavelength": (F.col("wavelength").cast("double"), F.concat(F.col("wave_code"), F.coalesce(F.concat(F.lit(" "), "wave_source"), none)), F.col("wave_severity")),
        "space group": (n("n_ops"), F.concat(F.col("group_code"), F.lit(": "), F.coalesce("declared", F.lit("?")), F.lit(" / "), F.coalesce("name", F.lit("?"))), F.col("group_severity")),
        "special positions": (n("n_special"), none, info), "bonds": (n("n_bonds"), none, info), "outlying bonds": (n("n_outlying"), none, warn(n("n_outlying") > 0)),
        "hydrogen bonds": (n("n_hbonds"), none, info), "contacts": (n("n_contacts"), none, info), "suppressed": (n("n_suppressed"), none, info),
    }
    items = F.array(*[F.struct(F.lit(k + 1).alias("place"), F.lit(b).alias("block"), F.lit(i).alias("item"), found[i][0].cast("double").alias("number"), found[i][1].alias("text"), found[i][2].alias("severity")) for k, (b, i) in enumerate(ITEMS)])
    return rows.select("structure", F.explode(items).alias("i")).select("structure", "i.*")


def table_text(report: DataFrame) -> DataFrame:
    """structure, severity (the worst), text: a validation() report written out, a line an item under its block."""
    heads = {"A": "Crystal data", "B": "Geometry", "C": "Hydrogen bonds"}
    number = F.when(F.col("number").isNull(), "-").otherwise(F.format_string("%.4f", F.col("number")))
    line = F.concat(F.rpad("item", 18, " "), F.lpad(number, 14, " "), F.when(F.col("text") == "", "").otherwise(F.concat(F.lit("  "), "text")), F.when(F.col("severity") == "INFO", "").otherwise(F.concat(F.lit("  ["), "severity", F.lit("]"))))
    first = {b: min(k + 1 for k, (c, _) in enumerate(ITEMS) if c == b) for b in heads}
    head = F.lit(None).cast("string")
    for b, name in heads.items():
        head = F.when(F.col("place") == first[b], f"{name}\n").otherwise(head)
    lines = report.withColumn("line", F.concat(F.coalesce(head, F.lit("")), F.lit("  "), line))
    worst = review.worst(report, ["structure"]).select("structure", "severity")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda p: p["line"]), "\n")
    return lines.groupBy("structure").agg(text.alias("text")).join(worst, "structure").select("structure", "severity", "text")


def methods_text(models: DataFrame, unit: str = "") -> DataFrame:
    """models with text: a paragraph on a multivariate calibration, from the numbers in its row alone.

    Needs method, n, channels, chain, components, scheme, question, rmsec, r2, rmsecv, r2cv, bias; a null number is '?'.
    """
    given = lambda c, form: F.when(F.col(c).isNull(), "?").otherwise(F.format_string(form, F.col(c)))
    three, fixed = (lambda c: given(c, "%.3g")), (lambda c: given(c, "%.3f"))
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    of = f" {unit}" if unit else ""
    sort = F.when(F.col("method") == "pls", "latent variables").otherwise("principal components")
    sentences: list[list[Column | str]] = [
        ["A multivariate calibration by ", F.upper("method"), " used ", whole("n"), " samples of ", whole("channels"), " channels."], ["Preprocessing: ", F.coalesce("chain", F.lit("none")), "."],
        ["It has ", whole("components"), " ", sort, ", the number chosen by cross-validation."], ["Cross-validation (", F.coalesce("scheme", F.lit("?")), ") asks about ", F.coalesce("question", F.lit("?")), "."],
        ["RMSEC ", three("rmsec"), f"{of}, R2 ", fixed("r2"), "; RMSECV ", three("rmsecv"), f"{of}, R2 ", fixed("r2cv"), ", bias ", given("bias", "%+.3g"), f"{of}."],
    ]
    text = F.concat_ws(" ", *[F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in s]) for s in sentences])
    return models.withColumn("text", text)
