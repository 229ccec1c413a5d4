import cmath
import math
import struct

import numpy as np
import pytest

from assayflow.operators import pattern, scattering
from assayflow.sources import spc


def test_form_factors_at_zero_angle_are_atomic_numbers():
    numbers = {"H": 1, "C": 6, "N": 7, "O": 8, "F": 9, "Na": 11, "P": 15, "S": 16, "Cl": 17}
    assert {s: round(sum(f[0:8:2]) + f[8]) for s, f in scattering.FORM_FACTORS.items()} == numbers
    assert all(abs(sum(f[0:8:2]) + f[8] - numbers[s]) < 0.01 for s, f in scattering.FORM_FACTORS.items())


def test_amplitudes_match_a_direct_sum_and_absences_vanish(spark):
    cell = (5.6, 5.6, 5.6, 90.0, 90.0, 90.0)
    face = [(0.0, 0.0, 0.0), (0.5, 0.5, 0.0), (0.5, 0.0, 0.5), (0.0, 0.5, 0.5)]
    sites = [("Na", *p, 1.0, 0.02) for p in face] + [("Cl", x + 0.5, y, z, 1.0, None) for x, y, z in face]
    atoms = spark.createDataFrame(sites, "sym string, x double, y double, z double, occ double, u_iso double")
    lines = scattering.with_amplitudes(pattern.reflections(spark, cell, 1.5406, 20, 60), atoms)
    rows = lines.collect()
    for r in rows:
        total = 0
        for sym, x, y, z, occ, u in sites:
            f = scattering.FORM_FACTORS[sym]
            s2 = 1 / (4 * r.d**2)
            size = sum(f[i] * math.exp(-f[i + 1] * s2) for i in (0, 2, 4, 6)) + f[8]
            total += occ * size * math.exp(-8 * math.pi**2 * (u or 0) * s2) * cmath.exp(2j * math.pi * (r.h * x + r.k * y + r.l * z))
        assert r.amplitude == pytest.approx(abs(total), abs=1e-6)
        if len({r.h % 2, r.k % 2, r.l % 2}) > 1:
            assert r.amplitude < 1e-6
    merged = scattering.powder_lines(lines).collect()
    best = max(merged, key=lambda m: m.intensity)
    assert best.intensity == pytest.approx(100) and best.reflections == 6  # 200
    with pytest.raises(Exception, match="no form factors for element Xx"):
        scattering.with_amplitudes(pattern.reflections(spark, cell, 1.5406, 20, 30), atoms.selectExpr("'Xx' AS sym", "x", "y", "z", "occ")).collect()
    none = scattering.with_amplitudes(pattern.reflections(spark, cell, 1.5406, 20, 30), atoms.limit(0))
    assert {r.intensity for r in scattering.powder_lines(none).collect()} == {0.0}


def made(flags, exponent, n, x_stored=(), own_x=(), y=b"", sub_exponent=0):
    head = struct.pack("<BBBbiddi", flags, spc.VERSION, 0, exponent, n, 10.0, 20.0, 1).ljust(spc.HEADER, b"\0")
    trace = struct.pack("<xb14xi", sub_exponent, len(own_x)).ljust(spc.TRACE_HEADER, b"\0")
    return head + struct.pack(f"<{len(x_stored)}f", *x_stored) + trace + struct.pack(f"<{len(own_x)}f", *own_x) + y


CASES = {
    "floats": (made(0, -128, 3, y=struct.pack("<3f", 1, 2, 0.5)), [(10, 1), (15, 2), (20, 0.5)]),
    "longs": (made(0, 4, 2, y=struct.pack("<2i", 1 << 28, -(1 << 29))), [(10, 1), (20, -2)]),
    "shorts": (made(1, 4, 2, y=struct.pack("<2h", 1 << 12, -(1 << 13))), [(10, 1), (20, -2)]),
    "stored": (made(0x80, -128, 2, x_stored=(9, 3), y=struct.pack("<2f", 7, 8)), [(3, 8), (9, 7)]),
    "own": (made(0x44, 9, 0, own_x=(1, 4), y=struct.pack("<2i", 1 << 28, 1 << 29), sub_exponent=4), [(1, 1), (4, 2)]),
}


def test_spc_layouts_and_bad_files(spark):
    bad = {"none": None, "empty": b"", "text": b"1 2\n" * 300, "cut": CASES["floats"][0][:-1], "short": CASES["stored"][0][:520]}
    rows = [(k, bytearray(v[0])) for k, v in CASES.items()] + [(k, None if v is None else bytearray(v)) for k, v in bad.items()]
    out = spc.parse_spc(spark.createDataFrame(rows, "file string, content binary")).collect()
    for name, (_, want) in CASES.items():
        assert [(r.x, r.y) for r in out if r.file == name] == want
    assert {r.file for r in out if r.problem} == set(bad) and all(r.x is None for r in out if r.problem)


def test_read_spc_folder(spark, tmp_path):
    (tmp_path / "a.spc").write_bytes(CASES["floats"][0])
    assert [r.y for r in spc.read_spc(spark, str(tmp_path)).collect()] == [1, 2, 0.5]


def test_atoms_of_a_large_cell_are_summed_where_they_lie(spark):
    rng = np.random.default_rng(5)
    xyz, occ, u = rng.random((20000, 3)), rng.random(20000), rng.random(20000) / 20
    sym = rng.choice(["C", "O"], 20000)
    rows = [(str(s), *map(float, p), float(o), float(v)) for s, p, o, v in zip(sym, xyz, occ, u)] + [("C", None, 0.1, 0.2, 1.0, 0.0)]
    atoms = spark.createDataFrame(rows, "sym string, x double, y double, z double, occ double, u_iso double").repartition(8)
    lines = scattering.with_amplitudes(pattern.reflections(spark, (5.0, 5.0, 5.0, 90.0, 90.0, 90.0), 1.5406, 20, 40), atoms)
    got = lines.collect()
    assert got and "collect_list" not in lines._jdf.queryExecution().toString()  # no row holds all atoms
    for r in got:
        s2 = 1 / (4 * r.d**2)
        size = {s: sum(f[i] * math.exp(-f[i + 1] * s2) for i in (0, 2, 4, 6)) + f[8] for s, f in scattering.FORM_FACTORS.items()}
        weight = occ * np.array([size[s] for s in sym]) * np.exp(-8 * math.pi**2 * u * s2)
        assert r.amplitude == pytest.approx(abs((weight * np.exp(2j * math.pi * (xyz @ [r.h, r.k, r.l]))).sum()), abs=1e-6)
