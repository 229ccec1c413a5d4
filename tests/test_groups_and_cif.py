"""Space groups from shuffled, shifted operations; crystal information files token by token."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayflow.operators import groups
from assayflow.sources import cif


def arrays(name):
    ops = groups.hall_operations(groups.HALL[name])
    return np.array([np.array(r).reshape(3, 3) for r, _ in ops]), np.array([t for _, t in ops]) / groups.PARTS


def test_listed_settings_are_groups_of_their_own():
    listed = groups._listed()
    assert len({key for key, *_ in listed}) == len(groups.HALL) and "" not in {key for key, *_ in listed}
    order = {name: n for _, name, n in listed}
    # fixed values: orders
    assert [order[n] for n in ("P 1", "P 21/c", "C 2/c", "P n m a", "I 41/a", "R -3", "R -3 c", "P 63/m m c", "F d d d", "F m -3 m", "I a -3 d", "F d -3 m")] == [1, 4, 8, 8, 16, 18, 36, 24, 32, 192, 96, 192]


@pytest.mark.parametrize("name", ["P 1", "P -1", "P 21", "C c", "P 21/n", "I 2 2 2", "I 21 21 21", "F d d 2", "I 41/a", "P 43 21 2", "R -3 c", "P 61 2 2", "I 21 3", "F d -3 m"])
def test_order_and_origin_do_not_matter(name):
    rotations, shifts = arrays(name)
    rng = np.random.default_rng(7)
    for _ in range(5):
        origin, place = rng.random(3), rng.permutation(len(rotations))
        moved = (shifts + origin - rotations @ origin)[place] + rng.integers(-2, 3, (len(rotations), 3))
        assert groups.signature(rotations[place], moved) == groups.signature(rotations, shifts)


def test_hall_symbols():
    ops = {(tuple(r), tuple(t)) for r, t in groups.hall_operations("-P 2ybc")}
    assert ops == {((1, 0, 0, 0, 1, 0, 0, 0, 1), (0, 0, 0)), ((-1, 0, 0, 0, -1, 0, 0, 0, -1), (0, 0, 0)), ((-1, 0, 0, 0, 1, 0, 0, 0, -1), (0, 12, 12)), ((1, 0, 0, 0, -1, 0, 0, 0, 1), (0, 12, 12))}
    screw = {tuple(t) for r, t in groups.hall_operations("P 31")}
    assert screw == {(0, 0, 0), (0, 0, 8), (0, 0, 16)}
    for bad in ("", "Q 1", "P 5", "P 2yq", "P"):
        if bad == "P":
            assert len(groups.hall_operations(bad)) == 1
        else:
            with pytest.raises(ValueError):
                groups.hall_operations(bad)


def test_names_by_structure(spark):
    rows = []
    for s, name in enumerate(("P 21/c", "I 4/m m m", "P 1")):
        rotations, shifts = arrays(name)
        rows += [(s, *map(int, r.ravel()), *map(float, t)) for r, t in zip(rotations, shifts)]
    rows += [(0, *rows[1][1:10], *[t + 1 for t in rows[1][10:]])]  # the same but for whole cells
    rows += [(3, *r[1:]) for r in rows if r[0] == 0][:3]  # not closed
    rows += [(4, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0.3, 0.0, 0.0), (4, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0.0, 0.0, 0.0)]
    ops = spark.createDataFrame(rows, "structure long, " + ", ".join(f"{c} int" for c in groups.ROTATION) + ", t1 double, t2 double, t3 double")
    got = {r.structure: (r.n_ops, r.closed, r.name) for r in groups.named(ops).collect()}
    assert got == {0: (4, True, "P 21/c"), 1: (32, True, "I 4/m m m"), 2: (1, True, "P 1"), 3: (3, False, None), 4: (2, False, None)}
    asked = spark.createDataFrame([(0, "P 1 21/c 1", "x"), (1, "I4/m", "x"), (2, "P-1", "x"), (3, "p21/n", "x"), (4, None, "x"), (9, "P 1", "x")], "structure long, declared string, short string")
    codes = {r.structure: (r.code, r.severity) for r in groups.check(asked.drop("short"), ops).collect()}
    assert codes == {0: ("consistent", "INFO"), 1: ("incomplete", "WARN"), 2: ("incomplete", "WARN"), 3: ("incomplete", "WARN"), 4: ("not_listed", "INFO"), 9: ("incomplete", "WARN")}
    assert groups.named(ops.limit(0)).count() == 0


TEXT = """#\\#CIF
data_one # a comment
_cell_length_a 5.0(2)
_cell_length_b '6.0'
_note 'it's a ''quoted' _more "x # y" _bare a#b
_text
;first
 ; not the end
_cell_length_a 9
;
_cell_length_c 7 _cell_angle_alpha 90. _cell_angle_beta 90 _cell_angle_gamma 100
LOOP_ _Symmetry_equiv_pos_as_xyz
'x, y, z' "1/2-x,y+.5,-z"
loop_
_atom_site_fract_x _atom_site_label
_atom_site_fract_y _atom_site_fract_z _atom_site_occupancy
.1 C1 .2 .3 ? 0.5(1) 'Q9' 0 0 1 .4 O2
-.5 1e-1 0.5
. N3 0 0 1
_empty ?
loop_ _atom_site_aniso_label _atom_site_aniso_U_11 _atom_site_aniso_U_22 _atom_site_aniso_U_33 _atom_site_aniso_U_12 _atom_site_aniso_U_13 _atom_site_aniso_U_23
C1 .01 .02 .03 .001 .002 .003 O2 .01 ? .03 0 0 0
"""


def parsed(spark, texts):
    return spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "file string, text string, tag string")


def test_tokens():
    kinds = list(cif.tokens(TEXT))
    assert kinds[0] == ("data", "one") and ("value", "it's a ''quoted") in kinds and ("value", "x # y") in kinds and ("value", "a#b") in kinds
    assert ("value", "first\n ; not the end\n_cell_length_a 9") in kinds and ("unknown", "?") in kinds and ("loop", "") in kinds
    assert [k for k, _ in cif.tokens("_a 'b\n_c ;d\n;never")] == ["tag", "problem", "value", "tag", "value", "problem", "value"]
    assert list(cif.tokens("")) == [] and list(cif.tokens("\n;\n;")) == [("value", "")]


def test_structure_of_a_text(spark):
    texts = parsed(spark, {"a": TEXT})
    found = cif.items(texts)
    assert found.filter("problem is not null").count() == 0
    one = cif.chosen(found)
    made = cif.structures(texts, found)
    r = made.first()
    assert (r.block, r.blocks, r.a, r.b, r.c, r.gamma, r.n_atoms, r.findings) == ("one", 1, 5.0, 6.0, 7.0, 100.0, 2, [])
    assert [(x.label, x.sym, x.x, x.y, x.z, x.occ) for x in cif.atoms(one).orderBy("idx").collect()] == [("C1", "C", 0.1, 0.2, 0.3, 1.0), ("O2", "O", 0.4, -0.5, 0.1, 0.5)]
    ops = cif.operations(made, one).orderBy("op").collect()
    assert [(o.source, o.r11, o.r22, o.r33, o.t1, o.t2, o.t3) for o in ops] == [("loop", 1, 1, 1, 0.0, 0.0, 0.0), ("loop", -1, 1, -1, 0.5, 0.5, 0.0)]
    assert [(x.label, x.u23) for x in cif.tensors(one).collect()] == [("C1", 0.003)]


def test_symmetry_by_the_ladder(spark):
    cell = "".join(f"{t} 9\n" for t in cif.CELL.values()) + "loop_ _atom_site_label _atom_site_fract_x _atom_site_fract_y _atom_site_fract_z\nC1 0 0 0\n"
    hm, hall = "_symmetry_space_group_name_H-M", "_space_group_name_Hall"
    texts = parsed(spark, {
        "second": "data_a\nloop_ _space_group_symop_operation_xyz x,y,z -x,-y,-z\n" + cell, "name": f"data_a {hm} 'P 1 21/c 1' {hall} 'P 1'\n" + cell, "alt": "data_a _space_group_name_H-M_alt P-1\n" + cell,
        "hall": f"data_a {hm} 'odd' {hall} '-C 2yc'\n" + cell, "none": "data_a\n" + cell, "bad": f"data_a {hall} 'nothing'\n" + cell, "two": "data_a\n" + cell + "data_b\n" + cell, "empty": "", "null": None, "bare": "data_a",
    })
    found = cif.items(texts)
    made = cif.structures(texts, found)
    n = {(r.file, r.source): r["count"] for r in cif.operations(made, cif.chosen(found)).groupBy("file", "source").count().collect()}
    assert {k: v for k, v in n.items() if k[0] in ("second", "name", "alt", "hall", "none", "bad")} == {("second", "loop"): 2, ("name", "name"): 4, ("alt", "name"): 2, ("hall", "hall"): 8, ("none", "none"): 1, ("bad", "none"): 1}
    codes = {r.file: [(f.code, f.severity) for f in r.findings] for r in made.collect()}
    assert codes["name"] == codes["hall"] == codes["second"] == [] and codes["none"] == codes["bad"] == [("no_symmetry", "WARN")]
    assert codes["two"] == [("many_blocks", "FAIL"), ("no_symmetry", "WARN")] and codes["empty"] == codes["null"] == codes["bare"] == [("no_block", "FAIL")]
    for block in ("b", 1, -1):
        assert {r.file: r.block for r in cif.structures(texts, found, block).collect()}["two"] == "b"


def test_loops_that_do_not_fit_and_long_texts(spark):
    texts = parsed(spark, {"odd": "data_a loop_ _a _b 1 2 3 _c loop_ _d data_b 5 _e 6", "long": "data_a loop_ _a _b " + "12.5 'a b' " * 60_000})
    found = cif.items(texts)
    problems = [r.problem for r in found.filter("file = 'odd' and problem is not null").collect()]
    assert problems == ["a loop of 2 tags has 3 values", "no value of _c", "a loop of 1 tags has 0 values", "a value stands alone: 5"]
    assert [(r.block, r.tag, r.value) for r in found.filter("file = 'odd' and problem is null").collect()][-1] == ("b", "_e", "6")
    rows = found.filter("file = 'long'")
    assert rows.count() == 120_000 and rows.agg(F.max("row")).first()[0] == 59_999


def test_files(spark, tmp_path):
    (tmp_path / "x.cif").write_text(TEXT)
    assert cif.read_cif(spark, f"{tmp_path}/*.cif").filter("tag = '_note'").first()["value"] == "it's a ''quoted"
