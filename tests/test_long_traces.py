"""Peaks, knots and hulls over slices against loops over whole traces."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayflow.operators import baseline, long_traces, ranks


def trace_table(spark, traces, parts=3):
    rows = [(k, float(i), None if v is None else float(v)) for k, ys in traces.items() for i, v in enumerate(ys)]
    return spark.createDataFrame(rows, "trace string, x double, y double").repartition(parts)


def plain_maxima(y, height):
    out, i, n = [], 1, len(y)
    while i < n - 1:
        if y[i - 1] < y[i]:
            k = i
            while k < n - 1 and y[k + 1] == y[i]:
                k += 1
            if k < n - 1 and y[k + 1] < y[i] and y[i] >= height:
                out.append((i + k) // 2)
            i = k
        i += 1
    return out


def plain_thinned(peaks, y, distance):
    """The highest first, of equal ones the later, each removing what is nearer than distance."""
    gone, kept = set(), []
    for p in sorted(peaks, key=lambda p: (y[p], p), reverse=True):
        if p not in gone:
            kept.append(p)
            gone |= {q for q in peaks if abs(q - p) < distance}
    return sorted(kept)


def hills(seed, n, levels):
    return np.random.default_rng(seed).integers(0, levels, n).astype(float)


SHAPES = {
    "noise": hills(1, 400, 50), "ties": hills(2, 400, 4), "flat": np.ones(90), "long tops": np.repeat(hills(3, 30, 3), 13), "rising": np.arange(300) + np.where(np.arange(300) % 2, 3.0, 0.0),
    "falling": np.arange(300)[::-1] + np.where(np.arange(300) % 2, 3.0, 0.0), "two": np.array([1.0, 2.0]), "one top": np.r_[0.0, np.full(60, 5.0), 0.0], "steps": np.repeat([0.0, 2.0, 1.0, 1.0, 3.0, 0.0], 11),
}


@pytest.mark.parametrize(("width", "distance"), [(40, 5), (37, 20), (1000, 3)])
def test_peaks_match_a_loop(spark, width, distance):
    at = long_traces.placed(trace_table(spark, SHAPES), "trace")
    found = long_traces.maxima(at, "trace", height=1.0, width=width)
    got: dict[str, list[int]] = {}
    for r in found.collect():
        assert r.x == r.pos and r.y == SHAPES[r.trace][r.pos]
        got.setdefault(r.trace, []).append(r.pos)
    want = {k: plain_maxima(y, 1.0) for k, y in SHAPES.items()}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    thin: dict[str, list[int]] = {}
    for r in long_traces.thinned(found, distance, "trace", width=width).collect():
        thin.setdefault(r.trace, []).append(r.pos)
    assert {k: sorted(v) for k, v in thin.items()} == {k: plain_thinned(v, SHAPES[k], distance) for k, v in want.items() if v}


def test_of_equal_heights_the_later_stays(spark):
    peaks = spark.createDataFrame([("a", 3, 1.0), ("a", 5, 1.0), ("a", 6, 1.0), ("b", 0, 2.0), ("b", 2, 2.0)], "trace string, pos long, y double")
    assert sorted((r.trace, r.pos) for r in long_traces.thinned(peaks, 3, "trace").collect()) == [("a", 3), ("a", 6), ("b", 2)]
    assert long_traces.thinned(peaks.limit(0), 3, "trace").count() == 0


def test_knots_carry_over_slices(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SLICES", 8)
    rng = np.random.default_rng(4)
    points = {k: np.sort(rng.uniform(-2, 12, 80)) for k in ("a", "b", "c", "none")}
    knots = {"a": np.sort(rng.uniform(0, 10, 15)), "b": np.array([5.0]), "c": np.array([0.0, 10.0])}
    values = {k: rng.normal(size=len(v)) for k, v in knots.items()}
    rows = [(k, float(x), f"{k}{i}") for k, v in points.items() for i, x in enumerate(v)] + [("a", None, "null"), ("a", float(knots["a"][3]), "on")]
    p = spark.createDataFrame(rows, "trace string, x double, value string")
    k = spark.createDataFrame([(t, float(x), float(y)) for t in knots for x, y in zip(knots[t], values[t])] + [("a", None, 1.0), ("a", 3.0, None)], "trace string, at double, v double")
    got = {r.value: r.value_at for r in long_traces.interpolated(p, k, "x", "at", "v", ["trace"]).collect()}
    assert len(got) == len(rows) and got["null"] is None
    for t, x, name in rows:
        if t == "none":
            assert got[name] is None
        elif x is not None:
            assert got[name] == pytest.approx(np.interp(x, knots[t], values[t]), abs=1e-12)
    near = {r.value: r.gap for r in long_traces.gaps(p, k, "x", "at", ["trace"]).collect()}
    assert near["none0"] is None and all(near[n] == pytest.approx(min(abs(x - q) for q in [*knots[t], *([3.0] if t == "a" else [])])) for t, x, n in rows if t != "none" and x is not None)
    every = np.concatenate([*knots.values(), [3.0]])
    overall = {r.value: r.gap for r in long_traces.gaps(p, k, "x", "at").collect()}
    assert all(overall[n] == pytest.approx(np.abs(every - x).min()) for _, x, n in rows if x is not None)


def test_repeated_knots_count_once(spark):
    p = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    k = spark.createDataFrame([(2.0, 4.0), (2.0, 6.0), (4.0, 9.0)], "at double, v double")
    assert [r.value_at for r in long_traces.interpolated(p, k, "x", "at", "v").orderBy("x").collect()] == [5.0, 5.0, 7.0]
    assert long_traces.interpolated(p.limit(0), k, "x", "at", "v").count() == 0
    assert [r.value_at for r in long_traces.interpolated(p, k.limit(0), "x", "at", "v").collect()] == [None] * 3


@pytest.mark.parametrize("slices", [20])
def test_hull_equals_that_of_the_whole_trace(spark, monkeypatch, slices):
    monkeypatch.setattr(ranks, "SLICES", slices)
    rng = np.random.default_rng(slices)
    traces = {"noise": rng.normal(size=300), "bowl": (np.arange(100) - 50.0) ** 2, "hill": -((np.arange(100) - 50.0) ** 2), "line": np.arange(20.0) * 2, "down": 5.0 - np.arange(9.0), "pair": [3.0, 1.0], "one": [2.0], "flat": [1.0] * 6, "kink": [0.0, 0.0, 1.0]}
    rows = long_traces.rubber_band(trace_table(spark, traces), "trace")
    got: dict = {}
    for r in rows.collect():
        got.setdefault(r.trace, {})[int(r.x)] = (r.baseline, r.corrected, r.method)
    for k, y in traces.items():
        y = np.array(y)
        x = np.arange(len(y), dtype=float)
        how = "running minimum" if k in ("line", "down", "pair", "one", "flat") else "rubberband"
        want = np.minimum.accumulate(y) if how == "running minimum" else baseline.rubber_band(x, y)
        assert {v[2] for v in got[k].values()} == {how}
        assert np.allclose([got[k][i][0] for i in range(len(y))], want) and np.allclose([got[k][i][1] for i in range(len(y))], y - want)


def test_null_samples_and_repeated_places(spark):
    rows = spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.0, 3.0), ("a", 1.0, 5.0), ("a", 2.0, 1.5), ("a", None, 0.0), ("a", 1.0, None), ("a", 3.0, 4.0)], "trace string, x double, y double")
    got = {(r.x, r.y): r.baseline for r in long_traces.rubber_band(rows, "trace").collect()}
    assert got == pytest.approx({(0.0, 1.0): 1.0, (0.0, 3.0): 1.0, (1.0, 5.0): 1.25, (2.0, 1.5): 1.5, (3.0, 4.0): 4.0})
    empty = rows.filter(F.lit(False))
    assert long_traces.rubber_band(empty, "trace").count() == 0 and long_traces.maxima(long_traces.placed(empty, "trace"), "trace").count() == 0


def test_no_window_of_a_long_trace_runs_up_to_its_end(spark):
    """Spark works such a window out anew for every row, which costs the square of a slice."""
    p = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    plans = [long_traces.gaps(p, p.withColumnRenamed("x", "at"), "x", "at"), long_traces.interpolated(p, p.selectExpr("x AS at", "x AS v"), "x", "at", "v")]
    for df in plans:
        assert "unboundedfollowing" not in df._jdf.queryExecution().toString().lower()


def plain_hull(x, y):
    kept = []
    for u, v in sorted(zip(x, y)):
        if kept and kept[-1][0] == u:
            continue
        while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (v - kept[-2][1]) <= (kept[-1][1] - kept[-2][1]) * (u - kept[-2][0]):
            kept.pop()
        kept.append((u, v))
    return kept


def test_hull_of_a_slice_equals_a_loop_and_few_points_are_looked_at_one_by_one():
    rng = np.random.default_rng(8)
    t = np.arange(500.0)
    shapes = [(t, rng.normal(size=500)), (t, (t - 250) ** 2), (t, -((t - 250) ** 2)), (rng.integers(0, 40, 500).astype(float), rng.integers(0, 9, 500).astype(float)), (t, np.abs(t - 99)), (t[:1], t[:1]), (t[:0], t[:0])]
    for x, y in shapes:
        deal = rng.permutation(len(x))
        got = long_traces._hull(pd.DataFrame({"__x": x[deal], "__y": y[deal]}))
        assert list(zip(got["__x"], got["__y"])) == plain_hull(x, y)
    assert len(long_traces._corners(np.arange(1e5), rng.normal(size=100000))) < 5000
