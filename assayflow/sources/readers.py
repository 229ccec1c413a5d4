"""Readers of laboratory files: two-column text, calibration tables, CIF, JSON results; and plain CSV writers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import cif_field, cif_number

SMALLEST_FILE = 64


def parse_xy(lines: DataFrame, line: str = "value", name: str = "file") -> DataFrame:
    """Lines of text to file, x, y: commas are blanks, lines of # ; % and lines without two numbers are skipped."""
    tokens = F.split(F.trim(F.regexp_replace(F.col(line), "[,\\s]+", " ")), " ")
    rows = lines.filter(~F.col(line).rlike(r"^\s*[#;%]")).select(name, F.try_element_at(tokens, F.lit(1)).try_cast("double").alias("x"), F.try_element_at(tokens, F.lit(2)).try_cast("double").alias("y"))
    return rows.filter("x is not null and y is not null")


def read_xy(spark: SparkSession, path: str) -> DataFrame:
    """Two-column spectra of a file, folder or glob."""
    return parse_xy(spark.read.text(path).withColumn("file", F.input_file_name()))


def read_calibration(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """conc, signal from the first two columns of CSV files; header and other lines without two numbers are skipped.

    Files of fewer than `least` such lines are refused: their rows are left out. A line with errors needs three.
    """
    raw = spark.read.csv(path, schema="a string, b string", mode="PERMISSIVE")
    rows = raw.select(F.trim("a").try_cast("double").alias("conc"), F.trim("b").try_cast("double").alias("signal"), F.input_file_name().alias("file"))
    rows = rows.filter("conc is not null and signal is not null")
    enough = rows.groupBy("file").count().filter(F.col("count") >= least).select("file")
    return rows.join(enough, "file", "left_semi").select("conc", "signal", "file")


def file_gate(spark: SparkSession, path: str, least: int = SMALLEST_FILE) -> DataFrame:
    """A row per file: path, length, severity. Where there is no file, one row that fails, with a null length."""
    none = spark.createDataFrame([(path, None, "FAIL")], "path string, length long, severity string")
    try:
        found = spark.read.format("binaryFile").load(path)
        empty = found.isEmpty()
    except AnalysisException:
        return none
    return none if empty else found.select("path", "length", F.when(F.col("length") < least, "FAIL").otherwise("INFO").alias("severity"))


# The tags of a structure's identity, first choice first.
IDENTITY = {
    "name": ["_chemical_name_common", "_chemical_name_mineral", "_chemical_name_systematic"], "title": ["_publ_section_title"],
    "moiety": ["_chemical_formula_moiety", "_chemical_formula_sum"], "space_group": ["_symmetry_space_group_name_h-m", "_space_group_name_h-m_alt"], "code": ["_cod_database_code", "_database_code_csd"],
}
CELL = ["_cell_length_a", "_cell_length_b", "_cell_length_c", "_cell_angle_alpha", "_cell_angle_beta", "_cell_angle_gamma"]


def cif_identity(texts: DataFrame, text: str = "text") -> DataFrame:
    pick = lambda tags: F.coalesce(*[F.nullif(cif_field(F.col(text), t), F.lit("")) for t in tags], F.lit(""))
    return texts.withColumns({name: pick(tags) for name, tags in IDENTITY.items()})


def identity_matches(expect: str) -> Column:
    """Whether name, title or moiety holds the expected words, case aside."""
    return F.contains(F.lower(F.concat_ws(" ", "name", "title", "moiety")), F.lit(expect.lower()))


def cif_cell(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.withColumns({tag.removeprefix("_cell_").replace("length_", "").replace("angle_", ""): cif_number(cif_field(F.col(text), tag)) for tag in CELL})


def cif_blocks(texts: DataFrame, text: str = "text") -> DataFrame:
    """A row per data block of a CIF text: block, body."""
    parts = F.split(text, r"(?im)^data_")
    rows = texts.select(*[c for c in texts.columns if c != text], F.posexplode(parts).alias("__k", "__b")).filter("__k > 0")
    return rows.withColumn("block", F.regexp_extract("__b", r"^(\S*)", 1)).withColumn("body", F.regexp_replace("__b", r"^\S*", "")).drop("__k", "__b")


def cif_loop(blocks: DataFrame, prefix: str, body: str = "body") -> DataFrame:
    """Rows of the loop whose tags start with prefix, a map tag -> value each, numbered from 0.

    Values are cut at white space outside quotes. A loop without rows or a block without the loop gives none.
    """
    tag = prefix.replace(".", "[.]")
    loop = rf"(?ims)^\s*loop_\s*\n((?:\s*_\S+\s*\n)*?\s*{tag}\S*\s*\n(?:\s*_\S+\s*\n)*)(.*?)(?=^\s*(?:loop_|_|data_|;|#)|\z)"
    rows = blocks.withColumn("__tags", F.regexp_extract_all(F.lower(F.regexp_extract(body, loop, 1)), F.lit(r"_\S+"), F.lit(0)))
    rows = rows.withColumn("__cells", F.regexp_extract_all(F.regexp_extract(body, loop, 2), F.lit(r"'[^'\n]*'|\"[^\"\n]*\"|\S+"), F.lit(0))).filter(F.size("__tags") > 0)
    n = F.size("__tags")
    starts = F.sequence(F.lit(0), F.floor(F.size("__cells") / n).cast("int") - 1)
    rows = rows.filter(F.size("__cells") >= n).withColumn("row", F.explode(starts))
    values = F.transform(F.slice("__cells", F.col("row") * n + 1, n), lambda v: F.regexp_replace(v, "^['\"]|['\"]$", ""))
    return rows.withColumn("fields", F.map_from_arrays("__tags", values)).drop("__tags", "__cells")


def cif_atoms(blocks: DataFrame) -> DataFrame:
    """label, sym, x, y, z, occ, u_iso, assembly, grp of each block's atom sites, numbered (idx) in file order."""
    from ..operators.structure import element_of

    rows = cif_loop(blocks, "_atom_site_")
    f = lambda tag: F.when(~F.try_element_at("fields", F.lit(tag)).isin("?", "."), F.try_element_at("fields", F.lit(tag)))
    number = lambda tag: cif_number(f(tag))
    out = rows.select(
        *[c for c in blocks.columns if c != "body"], F.col("row").alias("idx"), f("_atom_site_label").alias("label"), element_of(f("_atom_site_type_symbol"), f("_atom_site_label")).alias("sym"),
        *[number(f"_atom_site_fract_{c}").alias(c) for c in "xyz"], F.coalesce(number("_atom_site_occupancy"), F.lit(1.0)).alias("occ"), number("_atom_site_u_iso_or_equiv").alias("u_iso"),
        f("_atom_site_disorder_assembly").alias("assembly"), f("_atom_site_disorder_group").alias("grp"),
    )
    return out.filter("sym <> '' and x is not null and y is not null and z is not null")


def json_records(texts: DataFrame, text: str, schema: str, needs: str) -> DataFrame:
    """Records of a JSON list, or of an object's result or data list; those without the field `needs` are dropped."""
    kind = f"array<struct<{schema}>>"
    t = F.col(text)
    plain = F.from_json(F.when(F.ltrim(t).startswith("["), t), kind)
    boxed = F.from_json(F.when(F.ltrim(t).startswith("{"), t), f"struct<result:{kind},data:{kind}>")
    rows = texts.withColumn("r", F.explode(F.coalesce(plain, boxed["result"], boxed["data"])))
    return rows.select(*[c for c in texts.columns if c != text], "r.*").filter(F.coalesce(F.col(needs).cast("string"), F.lit("")) != "")


def formula_counts(formula: Column) -> Column:
    """Element counts of a formula such as C9 H8 O4, as a map; a missing number is 1."""
    names = F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)([0-9.]*)"), F.lit(1))
    counts = F.transform(F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)([0-9.]*)"), F.lit(2)), lambda n: F.coalesce(F.nullif(n, F.lit("")).cast("double"), F.lit(1.0)))
    return F.map_from_arrays(names, counts)


def json_properties(texts: DataFrame, text: str, schema: str) -> DataFrame:
    """The first record of PropertyTable.Properties as columns of `schema`, null where there is none."""
    found = F.get(F.from_json(F.col(text), f"struct<PropertyTable:struct<Properties:array<struct<{schema}>>>>")["PropertyTable"]["Properties"], F.lit(0))
    return texts.withColumn("__p", found).select(*[c for c in texts.columns if c != text], "__p.*")


def structure_url(base: str, code: Column) -> Column:
    return F.concat(F.lit(base + "/"), F.url_encode(code.cast("string")), F.lit(".cif"))


def property_url(base: str, name: Column, properties: list[str]) -> Column:
    return F.concat(F.lit(base + "/"), F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")), F.lit("/property/" + ",".join(properties) + "/JSON"))


def search_url(base: str, elements: list[str], **more: str) -> str:
    from urllib.parse import urlencode

    return f"{base}?{urlencode({f'el{i}': e for i, e in enumerate(elements, 1)} | more)}"


def write_hydrogen_bonds(found: DataFrame, path: str) -> None:
    """Asserted bonds, then contacts, with the columns of a table for people."""
    from ..operators.structure import bonds_and_contacts

    columns = {"donor": "D", "hydrogen": "H", "acceptor": "A", "ha": "H..A/A", "da": "D..A/A", "angle": "angle/deg", "strength": "class"}
    rows = bonds_and_contacts(found).orderBy(F.desc("asserted"), "donor", "hydrogen", "acceptor")
    write_csv(rows.select(*[F.col(a).alias(b) for a, b in columns.items()]), path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header; a table of results for people, in the order of its columns."""
    df.write.mode("overwrite").option("header", True).csv(path)
