"""Lattice images against explicit blocks of cells."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayflow.operators import crystals, graph
from assayflow.operators.structure import BOND_TOLERANCE, COVALENT, cartesian
from assayflow.sources.scratch import materialize

ATOMS = "structure long, idx long, label string, sym string, x double, y double, z double, occ double, assembly string, grp string"
CELLS = "structure long, a double, b double, c double, alpha double, beta double, gamma double"
OPS = "structure long, op int, " + ", ".join(f"r{i}{j} int" for i in (1, 2, 3) for j in (1, 2, 3)) + ", t1 double, t2 double, t3 double"
SAME = (1, 0, 0, 0, 1, 0, 0, 0, 1, 0.0, 0.0, 0.0)
INVERSE = (-1, 0, 0, 0, -1, 0, 0, 0, -1, 0.0, 0.0, 0.0)
SCREW = (-1, 0, 0, 0, 1, 0, 0, 0, -1, 0.0, 0.5, 0.0)


def made(spark, cells, atoms, ops=None):
    """cells: structure -> six numbers; atoms: rows without occ, assembly and grp, or with them."""
    rows = [(*a, 1.0, None, None) if len(a) == 7 else a for a in atoms]
    ops = ops or {s: [SAME] for s in cells}
    made_ops = spark.createDataFrame([(s, k, *o) for s, found in ops.items() for k, o in enumerate(found)], OPS)
    placed = crystals.sites(spark.createDataFrame(rows, ATOMS), made_ops, spark.createDataFrame([(s, *map(float, c)) for s, c in cells.items()], CELLS))
    return materialize(crystals.with_clusters(placed, crystals.disorder_clusters(placed)), "placed")


@pytest.mark.parametrize("radius", [0.7, 1.9, 4.0])
def test_pairs_match_an_explicit_block(spark, radius):
    rng = np.random.default_rng(int(radius * 10))
    cells = {1: (9, 10, 11, 90, 90, 90), 2: (5, 6, 7, 75, 100, 95), 3: (2.5, 3, 9, 90, 110, 90), 4: (40, 4, 30, 90, 90, 120)}
    atoms = [(s, k, f"C{k}", "C", *rng.random(3).tolist()) for s in cells for k in range(14)] + [(1, 50, "C50", "C", 0.0, 0.0, 0.0), (1, 51, "C51", "C", 0.999999, 0.5, 0.0)]
    placed = made(spark, cells, atoms)
    found = {(r.structure, r.l.site, r.r.site, r.du, r.dv, r.dw): r.d for r in crystals.periodic_pairs(placed, placed, radius, ["site"], ["site"]).collect()}
    want = {}
    where = {s: {r.site: np.array([r.x, r.y, r.z]) for r in placed.filter(F.col("structure") == s).collect()} for s in cells}
    for s, cell in cells.items():
        m = cartesian(cell)
        for t in itertools.product(range(-3, 4), repeat=3):
            for i, p in where[s].items():
                for j, q in where[s].items():
                    d = float(np.linalg.norm(m @ (q + t - p)))
                    if d <= radius:
                        want[s, i, j, *t] = d
    assert found.keys() == want.keys() and all(math.isclose(found[k], want[k], abs_tol=1e-9) for k in want)
    assert len(want) > len(atoms)


def grow(edges, seeds, block):
    """All images reached within a block of cells; edges: (structure, i) -> (j, offset)."""
    have, front = set(seeds), list(seeds)
    while front:
        s, i, t = front.pop()
        for j, o in edges.get((s, i), ()):
            to = (s, j, tuple(a + b for a, b in zip(t, o)))
            if max(map(abs, to[2])) <= block and to not in have:
                have.add(to)
                front.append(to)
    return have


def test_molecules_match_growth_in_a_block(spark):
    rng = np.random.default_rng(3)
    cells = {s: (4.5 + s % 3, 6, 5, 90 if s % 2 else 82, 95, 90 if s % 2 else 100) for s in range(1, 25)}
    atoms = [(s, k, f"C{k}", "C", *rng.random(3).tolist()) for s in cells for k in range(4 + s % 6)]
    ops = {s: [SAME] if s % 3 == 0 else [SAME, INVERSE] if s % 3 == 1 else [SAME, SCREW] for s in cells}
    placed = made(spark, cells, atoms, ops)
    bonds = crystals.periodic_bonds(placed)
    edges = {}
    for r in bonds.collect():
        edges.setdefault((r.structure, r.i), []).append((r.j, (r.du, r.dv, r.dw)))
        edges.setdefault((r.structure, r.j), []).append((r.i, (-r.du, -r.dv, -r.dw)))
    found = crystals.molecules(placed, bonds)
    rows = found.collect()
    dimensions = set()
    for r in rows:
        images = grow(edges, [(r.structure, r.molecule, (0, 0, 0))], 5)
        assert (r.structure, r.site) in {x[:2] for x in images} and min(x[1] for x in images) == r.molecule
        back = np.array([x[2] for x in images if x[1] == r.molecule])
        assert r.dimension == np.linalg.matrix_rank(back)
        dimensions.add(r.dimension)
        assert (r.du is None) == (r.dimension > 0)
        if not r.dimension:
            assert [x[2] for x in images if x[1] == r.site] == [(r.du, r.dv, r.dw)]
    assert {0, 1} <= dimensions and len(rows) == placed.count()
    closed = {(r.structure, r.site) for r in rows if not r.dimension}
    seeds = placed.filter("op = 0").select("structure", "site", F.lit(1).alias("du"), F.lit(0).alias("dv"), F.lit(-1).alias("dw"))
    whole = {(r.structure, r.site, (r.du, r.dv, r.dw)) for r in crystals.complete(seeds, found).collect()}
    begin = {(r.structure, r.site, (1, 0, -1)) for r in seeds.collect() if (r.structure, r.site) in closed}
    assert whole == grow(edges, begin, 9)


def test_networks_by_dimension(spark):
    """Carbon at 1.5 angstrom along one, two and three edges of the cell; a molecule over the border; lone atoms."""
    cells = {1: (1.5, 9, 9, 90, 90, 90), 2: (1.5, 1.5, 9, 90, 90, 90), 3: (1.5, 1.5, 1.5, 90, 90, 90), 4: (9, 9, 9, 90, 90, 90), 5: (3, 9, 9, 90, 90, 90)}
    atoms = [(s, 1, "C1", "C", 0.0, 0.0, 0.0) for s in (1, 2, 3)] + [(4, 1, "C1", "C", 0.95, 0.5, 0.98), (4, 2, "C2", "C", 0.07, 0.5, 0.02), (4, 3, "C3", "C", 0.5, 0.5, 0.5), (5, 1, "C1", "C", 0.0, 0.1, 0.1), (5, 2, "C2", "C", 0.5, 0.1, 0.1)]
    placed = made(spark, cells, atoms)
    rows = {(r.structure, r.site): (r.molecule, r.du, r.dv, r.dw, r.dimension) for r in crystals.molecules(placed, crystals.periodic_bonds(placed)).collect()}
    n = crystals.MOST_OPS
    assert [rows[s, n][-1] for s in (1, 2, 3)] == [1, 2, 3]
    assert rows[4, n] == (n, 0, 0, 0, 0) and rows[4, 2 * n] == (n, 1, 0, 1, 0) and rows[4, 3 * n] == (3 * n, 0, 0, 0, 0)
    assert rows[5, n][-1] == rows[5, 2 * n][-1] == 1 and rows[5, 2 * n][0] == n


def test_half_a_molecule_is_completed_by_inversion(spark):
    """Two atoms near a centre at the corner: their molecule has four, in four cells' images."""
    cells = {1: (8, 8, 8, 90, 90, 90)}
    atoms = [(1, 1, "C1", "C", 0.09, 0.0, 0.0), (1, 2, "C2", "C", 0.25, 0.1, 0.0)]
    placed = made(spark, cells, atoms, {1: [SAME, INVERSE]})
    found = crystals.molecules(placed, crystals.periodic_bonds(placed))
    seeds = placed.filter("op = 0").select("structure", "site", "su", "sv", "sw").toDF("structure", "site", "du", "dv", "dw")
    got = crystals.complete(seeds, found).join(placed.select("structure", "site", "x", "y", "z"), ["structure", "site"]).collect()
    assert sorted((round(r.x + r.du, 6), round(r.y + r.dv, 6)) for r in got) == [(-0.25, -0.1), (-0.09, 0.0), (0.09, 0.0), (0.25, 0.1)]


def test_hydrogen_bonds_reach_over_the_border(spark):
    """O-H at one face, an acceptor behind the opposite one, and an acceptor that excludes the donor."""
    cells = {1: (10, 10, 10, 90, 90, 90), 2: (10, 10, 10, 90, 90, 90)}
    atoms = [(1, 1, "O1", "O", 0.95, 0.3, 0.3), (1, 2, "H1", "H", 0.04, 0.3, 0.3), (1, 3, "O2", "O", 0.77, 0.7, 0.7), (1, 4, "N1", "N", 0.95, 0.08, 0.3)]
    atoms += [(2, 1, "O1", "O", 0.05, 0.5, 0.5, 0.5, "A", "1"), (2, 2, "H1", "H", 0.96, 0.5, 0.5, 1.0, None, None), (2, 3, "O2", "O", 0.78, 0.5, 0.5, 0.5, "A", "2")]
    rows = {(r.structure, r.acceptor): r for r in crystals.hydrogen_bond_images(made(spark, cells, atoms, {1: [SAME, INVERSE], 2: [SAME]})).collect() if r.donor == "O1"}
    best = rows[1, "O2"]
    assert (best.kind, best.strength, best.code) == ("hbond", "moderate", "2_666") and best.angle == pytest.approx(180) and best.da == pytest.approx(2.8)
    assert best.ha == pytest.approx(2.8 - 0.983)
    assert rows[1, "N1"].kind == "bent" and rows[1, "N1"].code == "1_455"
    assert rows[2, "O2"].kind == "disorder" and rows[2, "O2"].ha is None and rows[2, "O2"].angle is None and rows[2, "O2"].code == "."


def test_defined_cases(spark):
    cells = {1: (9, 9, 9, 90, 90, 90)}
    empty = made(spark, cells, [])
    assert crystals.periodic_bonds(empty).count() == 0 and crystals.hydrogen_bond_images(empty).count() == 0
    assert crystals.molecules(empty, crystals.periodic_bonds(empty)).count() == 0
    placed = made(spark, cells, [(1, 1, "C1", "C", 0.1, 0.1, 0.1), (2, 2, "C2", "C", 0.2, 0.1, 0.1), (1, 3, "X1", "X", 0.2, 0.1, 0.1)])
    assert placed.count() == 2 and crystals.periodic_bonds(placed).count() == 0  # no cell; an element without a radius


def test_offset_components_of_conflicting_ways(spark):
    edges = [("a", "b", 0, 0, 0), ("b", "c", 1, 0, 0), ("a", "c", 1, 0, 0), ("c", "d", 0, -2, 0), ("p", "q", 0, 0, 0), ("q", "p", 0, 0, 3), ("z", "z", 0, 5, 0), ("z", "z", 2, 0, 0), ("y", "y", 0, 0, 0)]
    nodes, periods = graph.offset_components(spark.createDataFrame(edges, "src string, dst string, du int, dv int, dw int"))
    at = {r.node: (r.root, r.du, r.dv, r.dw) for r in nodes.collect()}
    assert at["d"] == ("a", 1, -2, 0) and at["c"] == ("a", 1, 0, 0) and at["b"] == ("a", 0, 0, 0) and at["q"][0] == "p"
    assert {r.root: r["rank"] for r in graph.period_ranks(periods).collect()} == {"p": 1, "z": 2}


def test_a_bond_is_of_the_sum_of_radii(spark):
    reach = (2 * COVALENT["C"] + BOND_TOLERANCE) / 10
    placed = made(spark, {1: (10, 10, 10, 90, 90, 90)}, [(1, 1, "C1", "C", 0.0, 0.0, 0.0), (1, 2, "C2", "C", reach - 1e-6, 0.0, 0.0), (1, 3, "C3", "C", 1 - reach - 1e-6, 0.0, 0.0)])
    assert [(r.i, r.j, r.outlying) for r in crystals.periodic_bonds(placed).collect()] == [(200, 400, True)]
