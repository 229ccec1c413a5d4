"""Sliced ranks and quantiles against plain ones; scratch tables that go when their scope ends."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayflow.operators import baseline, ranks, stats
from assayflow.sources.scratch import materialize, scope


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    values = [None if k % 50 == 0 else float(v) for k, v in enumerate(np.round(rng.lognormal(size=900), 2))]
    return spark.createDataFrame([("big" if k % 3 else "small", k, v) for k, v in enumerate(values)], "g string, k int, v double")


def test_ranks_in_groups_and_overall(rows, monkeypatch):
    monkeypatch.setattr(ranks, "SLICES", 16)
    known = rows.filter("v is not null")
    for by in ([], ["g"]):
        got = {r.k: r["rank"] for r in ranks.ranked(known, "v", by, ties="k").collect()}
        want, seen = {}, {}
        for r in sorted(known.collect(), key=lambda r: (r.v, r.k)):
            key = r.g if by else ""
            want[r.k] = seen.get(key, 0)
            seen[key] = want[r.k] + 1
        assert got == want


def test_quantiles_and_flags_are_exact(rows, monkeypatch):
    monkeypatch.setattr(ranks, "SLICES", 16)
    got = {r.g: (r.n, r.q0, r.q1) for r in ranks.quantiles(rows, ["g"], "v", [0.5, 0.9]).collect()}
    want = {r.g: (r.n, r.a, r.b) for r in rows.groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", 0.5).alias("a"), F.percentile("v", 0.9).alias("b")).collect()}
    assert {k: pytest.approx(v) for k, v in want.items()} == got
    plain = {r.k: (r.flagged, r.z) for r in stats.mad_flags(rows, ["g"], "v").collect()}
    sliced = {r.k: (r.flagged, r.z) for r in stats.mad_flags(rows, ["g"], "v", large_groups=True).collect()}
    assert {k: v[0] for k, v in plain.items()} == {k: v[0] for k, v in sliced.items()} and any(v[0] for v in plain.values())
    assert all(sliced[k][1] == pytest.approx(v[1]) for k, v in plain.items() if v[1] is not None)


def test_adjusted_p_values_of_one_family(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SLICES", 8)
    rng = np.random.default_rng(4)
    ps = np.round(rng.uniform(size=300) ** 3, 3)
    df = spark.createDataFrame([(k, float(p)) for k, p in enumerate(ps)], "k int, p double")
    order = np.argsort(ps, kind="stable")
    for method in ("holm", "bh", "bonferroni"):
        m, sorted_p = len(ps), ps[order]
        steps = {"holm": np.maximum.accumulate((m - np.arange(m)) * sorted_p), "bh": np.minimum.accumulate((m * sorted_p / (np.arange(m) + 1))[::-1])[::-1], "bonferroni": m * sorted_p}[method]
        want = np.empty(m)
        want[order] = np.minimum(1, steps)
        got = np.array([r.p_adjusted for r in stats.adjust_pvalues(df, "p", method).orderBy("k").collect()])
        assert got == pytest.approx(want)


def test_smoothing_traces_together_is_smoothing_each(monkeypatch):
    rng = np.random.default_rng(2)
    traces = [rng.normal(size=n).cumsum() + 5 * (np.arange(n) % 17 == 3) for n in (40, 3, 2, 0, 75, 40, 12)]
    traces[5] = np.full(40, 2.0)
    alone = [baseline.arpls(y, 100.0) for y in traces]
    monkeypatch.setattr(baseline, "TOGETHER", 120)
    for got, want, y in zip(baseline.arpls_many(traces, 100.0), alone, traces):
        assert got.shape == y.shape and got == pytest.approx(want, abs=1e-6)


def test_scope_removes_what_it_wrote(spark):
    df = spark.range(5)
    kept = materialize(df, "kept")
    with scope(spark) as made:
        gone, stays = materialize(df, "gone"), materialize(df, "stays")
        paths = list(made)
        made.remove(paths[1])
    assert kept.count() == stays.count() == 5 and len(paths) == 2
    assert not os.path.exists(paths[0].removeprefix("file://")) and os.path.exists(paths[1].removeprefix("file://"))
    assert gone is not None


def test_empty_tables_have_no_ranks(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert ranks.ranked(empty, "v", ["g"]).count() == 0 and ranks.quantiles(empty, ["g"], "v", [0.5]).count() == 0
    assert stats.adjust_pvalues(empty, "v", "holm").count() == 0


def test_values_that_differ_when_worked_out_again_lose_no_row(spark):
    """As sums of doubles do in their last bits: of few values each is the edge of a slice."""
    again = F.udf(lambda v: v * (1 + random.choice([-2, -1, 0, 1, 2]) * 2.0**-52), "double").asNondeterministic()
    df = spark.createDataFrame([(k, (k + 1) / 997) for k in range(40)], "k int, p double").withColumn("p", again("p"))
    assert sorted(r["rank"] for r in ranks.ranked(df, "p").collect()) == list(range(40))
    for method, want in (("holm", [(40 - k) * (k + 1) / 997 for k in range(40)]), ("bh", [40 / 997] * 40)):
        want = np.minimum(1, np.maximum.accumulate(want))
        got = {r.k: r.p_adjusted for r in stats.adjust_pvalues(df, "p", method).collect()}
        assert len(got) == 40 and [got[k] for k in range(40)] == pytest.approx(want)
    (row,) = stats.multiplicity(df, "p", alpha=1.0).collect()
    assert (row.raw_hits, row.bonferroni_hits, row.holm_hits, row.bh_hits) == (40, 40, 40, 40)
