import math

from pyspark.sql import functions as F

from assayflow.operators import outliers, traces
from assayflow.sources import readers
from assayflow.streaming import scoring


def test_two_column_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# head\n\n; note\n3,4\n1 2 9\nbad line\n2\t5\n% end\nx 1\n7\n")
    rows = sorted((r.x, r.y) for r in readers.read_xy(spark, str(tmp_path)).collect())
    assert rows == [(1.0, 2.0), (2.0, 5.0), (3.0, 4.0)]
    assert readers.file_gate(spark, str(tmp_path / "a.txt")).first().severity == "FAIL" or (tmp_path / "a.txt").stat().st_size >= 64


def test_calibration_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("conc,signal\n1,2\n2,x\n3,6.5,extra\n")
    assert sorted((r.conc, r.signal) for r in readers.read_calibration(spark, str(tmp_path)).collect()) == [(1.0, 2.0), (3.0, 6.5)]


def test_calibration_files_of_too_few_lines_are_refused(spark, tmp_path):
    for name, text in (("a", "1,2\n2,3\n"), ("b", "x,y\n1,2\n2,3\n3,5\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    assert sorted(r.conc for r in readers.read_calibration(spark, str(tmp_path), least=3).collect()) == [1.0, 2.0, 3.0]


def test_file_gate_and_properties_and_urls(spark, tmp_path):
    r = readers.file_gate(spark, str(tmp_path / "none" / "x.cif")).first()
    assert r.severity == "FAIL" and r.length is None
    texts = spark.createDataFrame([('{"PropertyTable": {"Properties": [{"CID": 7, "Name": "a b"}, {"CID": 8}]}}',), ("{}",), (None,)], "text string")
    assert [(r.CID, r.Name) for r in readers.json_properties(texts, "text", "CID:int,Name:string").collect()] == [(7, "a b"), (None, None), (None, None)]
    urls = texts.limit(1).select(readers.structure_url("http://x/cif", F.lit(12)).alias("a"), readers.property_url("http://x/name", F.lit("a b"), ["P", "Q"]).alias("b")).first()
    assert tuple(urls) == ("http://x/cif/12.cif", "http://x/name/a%20b/property/P,Q/JSON")


def test_hydrogen_bond_sink_lists_bonds_then_contacts(spark, tmp_path):
    rows = [("D1", "H1", "A1", 2.9, 1.9, 170.0, kind, "moderate") for kind in ("contact", "hbond", "bent")]
    found = spark.createDataFrame(rows, "donor string, hydrogen string, acceptor string, da double, ha double, angle double, kind string, strength string")
    readers.write_hydrogen_bonds(found.coalesce(1), str(tmp_path / "h"))
    assert spark.read.csv(str(tmp_path / "h"), header=True).count() == 2


CIF = """data_one
_cell_length_a 10.0(2)
_chemical_name_common 'Two atoms'
loop_
_atom_site_label
_atom_site_type_symbol
_atom_site_fract_x
_atom_site_fract_y
_atom_site_fract_z
_atom_site_occupancy
C1 C 0.1(1) 0.2 0.3 1
O1 O2- .5 ? .1 1
N1 N 0.5 0.5 0.5 .
data_two
_cell_length_a 5
"""


def test_cif_blocks_and_atoms(spark):
    blocks = readers.cif_blocks(spark.createDataFrame([(CIF,)], "text string"))
    assert sorted(r.block for r in blocks.collect()) == ["one", "two"]
    atoms = readers.cif_atoms(blocks).orderBy("idx").collect()
    assert [(r.block, r.label, r.sym, r.x, r.occ) for r in atoms] == [("one", "C1", "C", 0.1, 1.0), ("one", "N1", "N", 0.5, 1.0)]
    named = readers.cif_identity(blocks.withColumnRenamed("body", "text"))
    assert named.filter(readers.identity_matches("two ATOMS")).count() == 1
    assert readers.cif_cell(blocks, "body").orderBy("block").first().a == 10.0


def test_formula_and_url(spark):
    assert spark.range(1).select(readers.formula_counts(F.lit("C9 H8 O4"))).first()[0] == {"C": 9.0, "H": 8.0, "O": 4.0}
    assert readers.search_url("http://x", ["C", "H"], text="a b") == "http://x?el1=C&el2=H&text=a+b"


def test_gate_and_spikes(spark):
    wave = [(1, float(k), math.exp(-(((k - 25) / 2) ** 2))) for k in range(50)]
    spiked = [(2, float(k), 1.0 if k == 20 else 0.01 * (k % 3)) for k in range(50)] + [(3, 1.0, 1.0), (3, 1.0, 2.0)]
    rows = spark.createDataFrame(wave + spiked, "trace int, x double, y double")
    assert [(r.trace, r.x, r.direction) for r in traces.spikes(rows).collect()] == [(2, 20.0, "up")]
    codes = {r.trace: r.code for r in traces.gate(rows).collect()}
    assert codes == {1: "ok", 2: "ok", 3: "too_few_points"}


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i % 3), float(i % 5), float(i)]) for i in range(30)], "sample int, spectrum array<double>")
    model = outliers.fit(rows, 1)
    limits = outliers.acceptance(outliers.distances(rows, model))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    scoring.run_to_end(scoring.score(stream, model, limits).select("sample", "f", "accepted"), "scored", str(tmp_path / "cp"))
    want = {r.sample: round(r.f, 9) for r in outliers.accept(outliers.distances(rows, model), limits).collect()}
    assert {r.sample: round(r.f, 9) for r in spark.table("scored").collect()} == want


def test_windowed_stream(spark, tmp_path):
    rows = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:10:00' AS ts, 'a' AS event_type, 1D AS value UNION ALL SELECT TIMESTAMP_NTZ '2024-01-01 02:10:00', 'a', 3D")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    scoring.run_to_end(scoring.band_totals(stream), "totals", str(tmp_path / "cp"), "complete")
    assert sorted((r.n, r["mean"]) for r in spark.table("totals").collect()) == [(1, 1.0), (1, 3.0)]
