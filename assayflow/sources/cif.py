"""Crystal information files: a tokenizer that gives every value as a row, and tables of structures made from the rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import cif_number
from ..operators import groups
from ..operators.structure import element_of

#: Rows of values that a task gathers before it passes them on.
_ROWS = 20_000
_SCHEMA = "block_no int, block string, loop int, row long, tag string, value string, problem string"
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]

# Tags of the cell, of operations, of names, of atoms and tensors, and of what is only declared.
CELL = {"a": "_cell_length_a", "b": "_cell_length_b", "c": "_cell_length_c", "alpha": "_cell_angle_alpha", "beta": "_cell_angle_beta", "gamma": "_cell_angle_gamma"}
OPERATIONS = ["_symmetry_equiv_pos_as_xyz", "_space_group_symop_operation_xyz"]
NAME = ["_symmetry_space_group_name_h-m", "_space_group_name_h-m_alt"]
HALL = ["_symmetry_space_group_name_hall", "_space_group_name_hall"]
DECLARED = {
    "volume": "_cell_volume", "z": "_cell_formula_units_z", "weight": "_chemical_formula_weight", "density": "_exptl_crystal_density_diffrn", "f000": "_exptl_crystal_f_000", "wavelength": "_diffrn_radiation_wavelength",
    "r_gt": "_refine_ls_r_factor_gt", "r_all": "_refine_ls_r_factor_all", "gof": "_refine_ls_goodness_of_fit_ref", "reflections": "_reflns_number_total", "reflections_gt": "_reflns_number_gt", "theta_max": "_diffrn_reflns_theta_max",
    "size_max": "_exptl_crystal_size_max", "size_mid": "_exptl_crystal_size_mid", "size_min": "_exptl_crystal_size_min",
}
WORDS = {"radiation": ["_diffrn_radiation_type", "_diffrn_radiation_probe"], "temperature": ["_diffrn_ambient_temperature", "_cell_measurement_temperature"], "formula": ["_chemical_formula_sum"]}


def tokens(text: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of data, loop, tag, value, unknown (? and .) and problem, in the order of the file.

    A value is a line block between semicolons at line starts, a quoted text up to a quote before white space, or a
    run without white space. # starts a comment where a token could start. A quote or block that doesn't end runs to
    the end of its line, or of the file, and is a problem as well.
    """
    at, end = 0, len(text)
    while at < end:
        c = text[at]
        if c.isspace():
            at += 1
        elif c == "#":
            at = (text.find("\n", at) + 1) or end
        elif c == ";" and (at == 0 or text[at - 1] == "\n"):
            stop = text.find("\n;", at)
            if stop < 0:
                yield "problem", "a text block doesn't end"
                stop = end
            yield "value", text[at + 1 : stop].strip("\r\n")
            at = stop + 2
        elif c in "'\"":
            line = text.find("\n", at)
            line = end if line < 0 else line
            stop = at + 1
            while (stop := text.find(c, stop, line)) >= 0 and stop + 1 < end and not text[stop + 1].isspace():
                stop += 1
            if stop < 0:
                yield "problem", "a quoted value doesn't end"
                stop = line
            yield "value", text[at + 1 : stop].rstrip("\r")
            at = stop + 1
        else:
            m = _WORD.match(text, at)
            word, at = m[0], m.end()
            low = word.lower()
            if low.startswith("data_"):
                yield "data", word[5:]
            elif low == "loop_":
                yield "loop", ""
            elif c == "_":
                yield "tag", low
            elif low not in ("global_", "stop_") and not low.startswith("save_"):
                yield ("unknown" if word in "?." else "value"), word


_WORD = re.compile(r"\S+")


def _rows(text: str) -> Iterator[tuple]:
    """Each value with its place: block number and name, loop (-1: none) and row in it, tag, value, problem."""
    block, name, loop = -1, None, -1
    tags: list[str] = []
    state, seen = "out", 0

    def fault(what: str) -> tuple:
        return block, name, loop, None, None, None, what

    def loop_end() -> Iterator[tuple]:
        if state == "body" and seen % len(tags) or state == "head" and tags:
            yield fault(f"a loop of {len(tags)} tags has {seen} values")

    for kind, word in chain(tokens(text or ""), [("end", "")]):
        if kind in ("value", "unknown"):
            value = word if kind == "value" else None
            if state in ("head", "body") and tags:
                state = "body"
                yield block, name, loop, seen // len(tags), tags[seen % len(tags)], value, None
                seen += 1
            elif state == "tag":
                yield block, name, -1, 0, tags[0], value, None
                state = "out"
            else:
                yield fault(f"a value stands alone: {word[:40]}")
            continue
        if kind == "problem":
            yield fault(word)
            continue
        if kind == "tag" and state == "head":
            tags.append(word)
            continue
        yield from loop_end()
        if state == "tag":
            yield fault(f"no value of {tags[0]}")
        if kind == "data":
            block, name, loop, state = block + 1, word, -1, "out"
        elif kind == "loop":
            loop, tags, state, seen = loop + 1, [], "head", 0
        elif kind == "tag":
            tags, state = [word], "tag"


def items(texts: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """A row per value of each text: key, block_no, block, loop, row, tag (lower case), value (null: ? or .), problem.

    Texts are read in one pass each, values leave in batches, so a text's rows are never held together. A null or
    empty text has no rows. What can't be read is a row with a problem and without a tag.
    """
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held: list[tuple] = []
                for row in _rows(body):
                    held.append(row)
                    if len(held) == _ROWS:
                        yield batch(b.schema.field(0), name, held)
                        held = []
                if held:
                    yield batch(b.schema.field(0), name, held)

    def batch(field: pa.Field, name, held: list[tuple]) -> pa.RecordBatch:
        types = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(held), field.type), *[pa.array(c, t) for c, t in zip(zip(*held), types)]], names=[key, *_NAMES])

    return texts.select(key, text).mapInArrow(run, f"{key} {kind}, {_SCHEMA}")


def read_cif(spark: SparkSession, path: str) -> DataFrame:
    """items() of the files at a path or glob, by file name. Spark reads them, so they may lie on any of its stores."""
    return items(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text")))


def chosen(found: DataFrame, block: str | int | None = None, key: str = "file") -> DataFrame:
    """items() of one block of each text: by number (from 0; from the end if negative) or name, else the first."""
    if isinstance(block, int):
        last = found.groupBy(key).agg(F.max("block_no").alias("__last"))
        return found.join(last, key).filter(F.col("block_no") == (F.lit(block) if block >= 0 else F.col("__last") + 1 + block)).drop("__last")
    if block is not None:
        return found.filter(F.col("block") == block)
    return found.filter("block_no = 0")


def structures(texts: DataFrame, found: DataFrame, block: str | int | None = None, key: str = "file") -> DataFrame:
    """A row per text: key, block, blocks, cell, name and Hall symbol, what is declared, and findings.

    found is items(texts). findings is an array of struct<code, severity>: no_block (none with a value), many_blocks (several, none of
    them asked for), no_cell (a length or angle is missing), no_atoms (all FAIL) and no_symmetry (none of the sources;
    P1 is assumed; WARN), problems (WARN). A cell that is missing is null.
    """
    one = chosen(found, block, key)
    value = lambda tag: F.max(F.when((F.col("tag") == tag) & (F.col("row") == 0), F.col("value")))
    first = lambda tags: F.coalesce(*[value(t) for t in tags])
    rows = one.groupBy(key).agg(
        F.max("block").alias("block"), *[cif_number(value(t)).alias(c) for c, t in CELL.items()], first(NAME).alias("name"), first(HALL).alias("hall"),
        *[cif_number(value(t)).alias(c) for c, t in DECLARED.items()], *[first(t).alias(c) for c, t in WORDS.items()],
        F.count(F.when(F.col("tag").isin(*OPERATIONS), 1)).alias("__ops"), F.count("problem").alias("__problems"),
    )
    whole = found.groupBy(key).agg((F.max("block_no") + 1).alias("blocks"))
    sites = atoms(one, key).groupBy(key).agg(F.count("*").alias("n_atoms"))
    known = F.broadcast(groups.listed(texts.sparkSession).select("short", F.lit(True).alias("known")))
    out = texts.select(key).join(whole, key, "left").join(rows, key, "left").join(sites, key, "left").withColumn("short", groups.short_name(F.col("name"))).join(known, "short", "left")
    finding = lambda when, code, severity: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    nothing = F.col("block").isNull() & F.col("a").isNull() & F.col("n_atoms").isNull()
    several = (F.col("blocks") > 1) if block is None else F.lit(False)
    unlisted = (F.coalesce("__ops", F.lit(0)) == 0) & F.col("known").isNull() & ~_readable(F.col("hall"))
    findings = F.filter(F.array(
        finding(nothing, "no_block", "FAIL"), finding(~nothing & several, "many_blocks", "FAIL"), finding(~nothing & F.array_contains(F.array(*[F.col(c).isNull() for c in CELL]), True), "no_cell", "FAIL"),
        finding(~nothing & F.col("n_atoms").isNull(), "no_atoms", "FAIL"), finding(~nothing & unlisted, "no_symmetry", "WARN"), finding(F.col("__problems") > 0, "problems", "WARN"),
    ), lambda f: f.isNotNull())
    return out.withColumn("findings", findings).withColumn("n_atoms", F.coalesce("n_atoms", F.lit(0))).drop("short", "known", "__ops", "__problems")


def _readable(hall: Column) -> Column:
    """Whether a Hall symbol has the form of one."""
    return F.coalesce(F.trim(hall).rlike(r"^-?[PABCIRFpabcirf](\s+-?[12346][xyz'\"*]*[1-5]?[abcnuvwd]*)+(\s*\(.*\))?$"), F.lit(False))


def _pivot(one: DataFrame, tags: dict[str, str], key: str) -> DataFrame:
    """The rows of the loop that has these tags: key, loop, row and a column each. Of several loops the first."""
    rows = one.filter(F.col("tag").isin(*tags.values()) & (F.col("loop") >= 0)).groupBy(key, "loop", "row").agg(*[F.max(F.when(F.col("tag") == t, F.col("value"))).alias(c) for c, t in tags.items()])
    first = rows.groupBy(key).agg(F.min("loop").alias("loop"))
    return rows.join(first, [key, "loop"])


def atoms(one: DataFrame, key: str = "file") -> DataFrame:
    """key, idx, label, sym, x, y, z, occ, u_iso, assembly, grp of the atoms with places and a known element, in file order."""
    tags = {"label": "label", "kind": "type_symbol", "x": "fract_x", "y": "fract_y", "z": "fract_z", "occ": "occupancy", "u_iso": "u_iso_or_equiv", "assembly": "disorder_assembly", "grp": "disorder_group"}
    rows = _pivot(one, {c: f"_atom_site_{t}" for c, t in tags.items()}, key)
    out = rows.select(
        key, F.col("row").alias("idx"), "label", element_of(F.col("kind"), F.col("label")).alias("sym"), *[cif_number(F.col(c)).alias(c) for c in "xyz"],
        F.coalesce(cif_number(F.col("occ")), F.lit(1.0)).alias("occ"), cif_number(F.col("u_iso")).alias("u_iso"), "assembly", "grp",
    )
    return out.filter("label is not null and sym <> '' and x is not null and y is not null and z is not null")


def tensors(one: DataFrame, key: str = "file") -> DataFrame:
    """key, label and u11..u23 of the anisotropic displacements that have all six."""
    names = ("11", "22", "33", "12", "13", "23")
    rows = _pivot(one, {"label": "_atom_site_aniso_label"} | {f"u{n}": f"_atom_site_aniso_u_{n}" for n in names}, key)
    out = rows.select(key, "label", *[cif_number(F.col(f"u{n}")).alias(f"u{n}") for n in names])
    return out.dropna(subset=["label", *[f"u{n}" for n in names]])


def _operations_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for symbol in pdf["symbol"]:
            try:
                found = groups.hall_operations(symbol)
            except ValueError:  # of the right form, but no group
                found = groups.hall_operations("P 1")
            rows += [(symbol, k, *r, *[v / groups.PARTS for v in t]) for k, (r, t) in enumerate(found)]
        yield pd.DataFrame(rows, columns=["symbol", "op", *groups.ROTATION, *groups.SHIFT])


def triplet(text: Column) -> list[Column]:
    """r11..r33 and t1..t3 of an operation such as '1/2-x, y+1/2, -z'; decimal and leading shifts count as well."""
    parts = F.split(F.lower(F.regexp_replace(text, r"[\s'\"]", "")), ",")
    turns, shifts = [], []
    for i in range(3):
        p = F.get(parts, F.lit(i))
        turns += [F.when(p.rlike(f"-{v}"), -1).when(p.rlike(v), 1).otherwise(0).cast("int") for v in "xyz"]
        number = r"([+-]?\d*[.]?\d+)(?:/(\d+))?"
        top, bottom = F.regexp_extract(p, number, 1), F.regexp_extract(p, number, 2)
        shifts.append(F.coalesce(F.nullif(top, F.lit("")).cast("double"), F.lit(0.0)) / F.coalesce(F.nullif(bottom, F.lit("")).cast("double"), F.lit(1.0)))
    return [*turns, *shifts]


def operations(found: DataFrame, one: DataFrame, key: str = "file") -> DataFrame:
    """key, op, r11..r33, t1..t3, source: the operations of each structure by the first source that has any.

    found is structures(), one the items of its blocks. Sources in order: the loop of either tag, the Hermann-Mauguin
    name if it is listed, the Hall symbol if it can be read, P1. Symbols are worked out once each.
    """
    spark = one.sparkSession
    columns = [*groups.ROTATION, *groups.SHIFT]
    loops = one.filter(F.col("tag").isin(*OPERATIONS) & F.col("value").isNotNull()).withColumn("rank", F.when(F.col("tag") == OPERATIONS[0], 0).otherwise(1))
    best = loops.groupBy(key).agg(F.min("rank").alias("rank"))
    written = loops.join(best, [key, "rank"]).select(key, F.col("row").cast("int").alias("op"), *[v.alias(c) for c, v in zip(columns, triplet(F.col("value")))], F.lit("loop").alias("source"))
    rest = found.join(best.select(key), key, "left_anti").withColumn("short", groups.short_name(F.col("name")))
    known = F.broadcast(groups.listed(spark).select("short", F.col("hall").alias("by_name")))
    rest = rest.join(known, "short", "left").select(key, F.when(F.col("by_name").isNotNull(), "name").when(_readable(F.col("hall")), "hall").otherwise("none").alias("source"), F.coalesce("by_name", F.when(_readable(F.col("hall")), F.col("hall")), F.lit("P 1")).alias("symbol"))
    made = rest.select("symbol").distinct().mapInPandas(_operations_of, "symbol string, op int, " + ", ".join(f"{c} int" for c in groups.ROTATION) + ", " + ", ".join(f"{c} double" for c in groups.SHIFT))
    return written.unionByName(rest.join(made, "symbol").select(key, "op", *columns, "source"))
