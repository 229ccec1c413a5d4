"""Findings about structures that lack or contradict what is declared, and texts from rows."""

from assayflow.operators import crystals, report
from assayflow.sources.scratch import materialize
from tests.test_crystals import ATOMS, CELLS, OPS, SAME

NONE = (None,) * 5
DECLARED = CELLS + ", name string, volume double, density double, weight double, z double, f000 double, formula map<string,double>, wavelength double, radiation string"


def made(spark, structures, atoms):
    ids = sorted({s[0] for s in structures})
    found, ops = spark.createDataFrame(atoms, ATOMS), spark.createDataFrame([(s, 0, *SAME) for s in ids], OPS)
    told = spark.createDataFrame(structures, DECLARED)
    sites = crystals.sites(found, ops, told)
    where = materialize(crystals.with_clusters(sites, crystals.disorder_clusters(sites)), "placed")
    return report.validation(told, found, ops, where, crystals.periodic_bonds(where), crystals.hydrogen_bond_images(where))


def test_findings(spark):
    box = (10.0, 10.0, 10.0, 90.0, 90.0, 90.0)
    atoms = [(1, 1, "C1", "C", 0.1, 0.1, 0.1, 1.0, None, None), (1, 2, "O1", "O", 0.22, 0.1, 0.1, 1.0, None, None), (1, 3, "Fe1", "Fe", 0.6, 0.6, 0.6, 1.0, None, None), (1, 4, "Fe2", "Fe", 0.6, 0.6, 0.7, 1.0, None, None)]
    atoms += [(2, 1, "C1", "C", 0.1, 0.1, 0.1, 1.0, None, None)]
    rows = [(1, *box, "P -1", 1050.0, 0.221, 139.7, 1.0, 200.0, {"C": 1.0, "O": 1.0, "Fe": 2.0}, 1.4, None), (2, *box, *NONE, None, None, None, None), (3, *box, "Q 9", *NONE[1:], None, None, 0.71073, "x")]
    got = {(r.structure, r.item): r for r in made(spark, rows, atoms).collect()}
    assert len(got) == 3 * len(report.ITEMS)
    severities = lambda s: {i for (k, i), r in got.items() if k == s and r.severity != "INFO"}
    assert severities(1) == {"volume", "F(000)", "wavelength", "space group", "outlying bonds"} and severities(2) == set() and severities(3) == set()
    assert got[1, "volume"].number == 1000 and got[1, "volume"].text == "declared 1050.00" and got[1, "F(000)"].number == 6 + 8 + 52 and got[1, "bonds"].number == 2 and got[1, "outlying bonds"].number == 1
    assert got[1, "density"].text.startswith("consistent") and got[1, "elements"].text == "C Fe O (some without a radius of their own)" and got[1, "space group"].text == "incomplete: P -1 / P 1"
    assert got[2, "density"].text == "not_declared" and got[2, "wavelength"].number is None and got[2, "space group"].text == "not_listed: ? / P 1"
    assert got[3, "elements"].number == 0 and got[3, "wavelength"].text == "standard Mo"
    texts = {r.structure: r for r in report.table_text(made(spark, rows, atoms)).collect()}
    assert texts[1].severity == "WARN" and texts[3].severity == "INFO"
    lines = texts[1].text.split("\n")
    assert lines[0] == "Crystal data" and lines[1] == "  volume                 1000.0000  declared 1050.00  [WARN]" and "Geometry" in lines and "Hydrogen bonds" in lines and len(lines) == len(report.ITEMS) + 3


def test_methods_text(spark):
    rows = [("pls", 12, 64, "snv", 3, "logo", "a new group", 0.12345, 0.98765, 1234.5, 0.5, -0.25), ("pcr", None, None, None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "method string, n long, channels int, chain string, components int, scheme string, question string, rmsec double, r2 double, rmsecv double, r2cv double, bias double")
    one, two = (r.text for r in report.methods_text(df, "%").collect())
    assert one == "A multivariate calibration by PLS used 12 samples of 64 channels. Preprocessing: snv. It has 3 latent variables, the number chosen by cross-validation. Cross-validation (logo) asks about a new group. RMSEC 0.123 %, R2 0.988; RMSECV 1.23e+03 %, R2 0.500, bias -0.250 %."
    assert two == "A multivariate calibration by PCR used ? samples of ? channels. Preprocessing: none. It has ? principal components, the number chosen by cross-validation. Cross-validation (?) asks about ?. RMSEC ? %, R2 ?; RMSECV ? %, R2 ?, bias ? %."
