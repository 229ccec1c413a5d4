"""Golden values: distributions, calibration, statistics, models and geometry against published or recomputed numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayflow.functions import dist, savgol
from assayflow.operators import baseline, calibration, gram, mixture, outliers, pattern, preprocess, review, stats, structure, traces, validate

LINE = [(0.6, 2.131), (0.8, 2.850), (1.0, 3.521), (1.2, 3.913), (1.4, 4.601)]


def test_quantiles():
    assert dist.t_ppf(0.975, 5) == pytest.approx(2.570581835636, rel=1e-10)
    assert dist.chi2_ppf(0.95, 10) == pytest.approx(18.307038053, rel=1e-9)
    assert dist.f_ppf(0.95, 2, 4) == pytest.approx(6.944271910, rel=1e-9)
    assert dist.beta_ppf(0.95, 1, 1.5) == pytest.approx(0.864279120, rel=1e-8)
    assert dist.norm_ppf(0.975) == pytest.approx(1.959963985, rel=1e-9)
    assert dist.t_cdf(-dist.t_ppf(0.9, 3), 3) == pytest.approx(0.1, rel=1e-10)


def test_calibration_line(spark):
    rows = spark.createDataFrame([("m", x, y) for x, y in LINE] + [("m", None, 1.0)], "g string, x double, y double")
    m = calibration.intercept_test(calibration.with_limits(calibration.fit(rows, ["g"], "x", "y")))
    r = m.first()
    for got, want in ((r.n, 5), (r.slope, 3.0015), (r.intercept, 0.4017), (r.r2, 0.991902), (r.s_resid, 0.0990284), (r.lod, 0.108877), (r.loq, 0.329930), (r.t, 2.468653), (r.intercept_low, -0.116149), (r.intercept_high, 0.919549)):
        assert got == pytest.approx(want, abs=1e-6)
    assert not r.significant and r.p == pytest.approx(0.0902, abs=1e-4)
    signals = spark.createDataFrame([("m", 3.5), ("m", 6.0)], "g string, s double")
    back = {x.s: (x.status, x.x_predicted) for x in calibration.inverse(signals, m, ["g"], "s").collect()}
    assert back[3.5] == ("OK", pytest.approx(1.032251, abs=1e-6)) and back[6.0] == ("REFUSED", None)


def test_small_and_constant_groups(spark):
    rows = spark.createDataFrame([("one", 1.0, 2.0), ("flat", 1.0, 5.0), ("flat", 2.0, 5.0), ("flat", 3.0, 5.0)], "g string, x double, y double")
    m = {r.g: r for r in calibration.with_limits(calibration.fit(rows, ["g"], "x", "y")).collect()}
    assert m["one"].s_resid is None and m["one"].lod is None
    assert m["flat"].r2 is None and m["flat"].lod is None and m["flat"].s_resid == 0


def test_adjusted_pvalues(spark):
    rows = spark.createDataFrame([(p,) for p in (0.001, 0.013, 0.04, 0.2, 0.5, 0.9)], "p double")
    got = lambda m: [r.p_adjusted for r in stats.adjust_pvalues(rows, "p", m).orderBy("p").collect()]
    assert got("holm") == pytest.approx([0.006, 0.065, 0.16, 0.6, 1, 1])
    assert got("bh") == pytest.approx([0.006, 0.039, 0.08, 0.3, 0.6, 0.9])
    assert got("bonferroni") == pytest.approx([0.006, 0.078, 0.24, 1, 1, 1])
    with pytest.raises(ValueError):
        stats.adjust_pvalues(rows, "p", "none")


def test_robust_flags_keep_nan_unflagged(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("a", float("nan")), ("b", 5.0), ("b", 5.0)], "g string, v double")
    flags = {(r.g, str(r.v)): r.flagged for r in stats.mad_flags(rows, ["g"], "v").collect()}
    assert flags["a", "100.0"] and not flags["a", "nan"] and not flags["a", "3.0"] and not flags["b", "5.0"]


def test_class_merit_and_residuals(spark):
    rows = spark.createDataFrame([(True, True)] * 3 + [(True, False), (False, True)] + [(False, False)] * 3, "t boolean, p boolean")
    r = stats.class_merit(rows, F.col("t"), F.col("p")).first()
    assert (r.sensitivity, r.specificity, r.efficiency) == (0.75, 0.75, 0.75)
    none = stats.class_merit(rows.filter("not t"), F.col("t"), F.col("p")).first()
    assert none.sensitivity is None
    w = lambda a, weight: stats.weighted_residual(spark.createDataFrame(a, "o double, c double"), [], "o", "c", weight).first().rwp
    assert w([(100.0, 110.0), (100.0, 90.0)], "poisson") == pytest.approx(0.1)
    assert w([(100.0, 100.0), (25.0, 20.0)], "poisson") == pytest.approx(math.sqrt(1 / 125))
    assert w([(100.0, 100.0), (25.0, 20.0)], "unit") == pytest.approx(math.sqrt(25 / 10625))


MATRIX = [[2, 0, 1], [0, 2, 0], [3, 1, 2], [1, 3, 1], [4, 0, 3], [2, 2, 2]]


def matrix(spark, rows=MATRIX):
    return spark.createDataFrame([(i, [float(v) for v in r], float(i % 4), i % 3) for i, r in enumerate(rows)], "sample int, spectrum array<double>, y double, grp int")


def test_principal_components_and_distances(spark):
    rows = matrix(spark)
    model = outliers.fit(rows, 2)
    assert model.eigenvalues == pytest.approx([3.7812886, 0.7632012, 0.0221769], abs=1e-6)
    d = outliers.distances(rows, model).orderBy("sample").collect()
    assert [r.t2 for r in d] == pytest.approx([2.4705981, 2.2419840, 0.3937636, 1.9042242, 2.1356383, 0.8537918], abs=1e-5)
    assert [r.q for r in d] == pytest.approx([0.00065204, 0.00572200, 0.04670982, 0.01321247, 0.00808042, 0.03650782], abs=1e-6)
    limits = {"F_textbook": 17.3606798, "F_n2m1": 20.2541264, "chi2": 5.9914645, "beta": 3.6011630}
    assert {k: outliers.t2_limit(model, form=k) for k in limits} == {k: pytest.approx(v, rel=1e-7) for k, v in limits.items()}
    assert outliers.q_limit(model) == pytest.approx(0.08309166, rel=1e-6) and outliers.q_limit(model, method="box", scored=outliers.distances(rows, model)) == pytest.approx(0.05571389, rel=1e-6)
    a = outliers.acceptance(outliers.distances(rows, model))
    assert (a.nh, a.nq) == (8, 2) and a.h0 == pytest.approx(1 / 3) and a.q0 == pytest.approx(0.018480761891874)
    assert a.critical == pytest.approx(18.307038053) and a.outlier == pytest.approx(28.205075354)


def direct_pls(x, y, a, scale=True):
    mx, my = x.mean(0), y.mean()
    sx = x.std(0, ddof=1) if scale else np.ones(x.shape[1])
    sy = y.std(ddof=1) if scale else 1.0
    e, f = (x - mx) / sx, (y - my) / sy
    ws, ps, qs = [], [], []
    for _ in range(a):
        w = e.T @ f
        w /= np.linalg.norm(w)
        t = e @ w
        p, q = e.T @ t / (t @ t), f @ t / (t @ t)
        e, f = e - np.outer(t, p), f - q * t
        ws.append(w), ps.append(p), qs.append(q)
    w, p = np.array(ws).T, np.array(ps).T
    b = w @ np.linalg.solve(p.T @ w, np.array(qs)) * sy / sx
    return b, my - b @ mx


@pytest.mark.parametrize("scale", [True, False])
def test_moment_pls_equals_direct_pls(spark, scale):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 6)) @ rng.normal(size=(6, 6))
    y = x @ rng.normal(size=6) + rng.normal(size=30)
    rows = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), i % 5) for i in range(30)], "sample int, spectrum array<double>, y double, grp int")
    model = gram.pls(gram.moments(rows)[None], 3, scale)
    b, base = direct_pls(x, y, 3, scale)
    assert model.coef[-1] == pytest.approx(b, rel=1e-8) and model.intercept[-1] == pytest.approx(base, rel=1e-8)
    assert (gram.vip(model) ** 2).sum() == pytest.approx(6)
    held = validate.predictions(validate.folds(rows, "logo"), 3).filter("a = 3").collect()
    for r in held:
        train = np.arange(30) % 5 != r.grp
        bt, b0 = direct_pls(x[train], y[train], 3)
        assert r.predicted == pytest.approx(x[r.sample] @ bt + b0, rel=1e-7)
    one = {r.sample: r.predicted for r in validate.leave_one_out(rows, 2).collect()}
    train = np.arange(30) != 7
    bt, b0 = direct_pls(x[train], y[train], 2)
    assert one[7] == pytest.approx(x[7] @ bt + b0, rel=1e-7)


def test_cv_error_splits_into_spread_and_bias(spark):
    p = spark.createDataFrame([(1.0, 1.5), (2.0, 1.8), (3.0, 3.9), (4.0, 4.1)], "y double, predicted double")
    r = validate.cv_stats(p, []).first()
    e = np.array([0.5, -0.2, 0.9, 0.1])
    assert r.rmsecv**2 == pytest.approx(e.var(ddof=1) * 3 / 4 + e.mean() ** 2)


def test_permutations_find_a_signal(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(24, 4))
    rows = spark.createDataFrame([(i, x[i].tolist(), float(2 * x[i, 0] + 0.05 * rng.normal()), i % 4) for i in range(24)], "sample int, spectrum array<double>, y double, grp int")
    r = validate.permutation_test(spark, rows.withColumn("fold", F.col("grp")), 1, n_perm=19).first()
    assert r.as_good == 0 and r.p == pytest.approx(1 / 20)


def test_folds_never_split_a_level(spark):
    f = validate.folds(matrix(spark), "kfold", k=3)
    assert f.groupBy("y").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0


def test_preprocessing(spark):
    rows = matrix(spark)
    x = np.array(MATRIX, float)
    get = lambda c: np.array([r.spectrum for r in preprocess.Preprocessor(c).fit(rows).transform(rows).orderBy("sample").collect()])
    assert get("snv") == pytest.approx((x - x.mean(1, keepdims=True)) / np.where(x.std(1, keepdims=True) == 0, 1, x.std(1, keepdims=True)))
    assert get("autoscale") == pytest.approx((x - x.mean(0)) / x.std(0))
    with pytest.raises(ValueError):
        preprocess.Preprocessor("snv+magic")


def test_emsc_recovers_scaled_spectra(spark):
    axis = np.linspace(4000, 1000, 30)
    pure, odd = np.exp(-(((axis - 2200) / 300) ** 2)), np.sin(axis / 200)
    rows = spark.createDataFrame([(0, (1.7 * pure).tolist()), (1, (1.3 * pure + 0.8 * odd).tolist())], "sample int, spectrum array<double>")
    out = preprocess.emsc(rows, axis, pure, 0, [odd]).orderBy("sample").collect()
    assert out[0].emsc[0] == pytest.approx(1.7) and out[0].corrected == pytest.approx(pure.tolist(), abs=1e-9) and out[1].corrected == pytest.approx(pure.tolist(), abs=1e-9)


def test_smoothing_keeps_polynomials(spark):
    y = [0.5 * k**3 - k + 2.0 for k in range(20)]
    rows = spark.createDataFrame([(y,)], "a array<double>")
    r = rows.select(savgol.filter_array(F.col("a"), 7, 3).alias("s"), savgol.filter_array(F.col("a"), 7, 3, 1).alias("d")).first()
    assert r.s == pytest.approx(y) and r.d == pytest.approx([1.5 * k * k - 1 for k in range(20)])


def test_baselines():
    rng = np.random.default_rng(0)
    y = np.cumsum(rng.normal(size=40)) + 30 * np.exp(-((np.arange(40) - 20.0) ** 2) / 8)
    d = np.diff(np.eye(40), 2, axis=0)
    w = rng.random(40)
    assert baseline._solve_smooth(w, y, 10.0) == pytest.approx(np.linalg.solve(np.diag(w) + 10.0 * d.T @ d, w * y))
    assert baseline.arpls(y, 1e-9, rounds=1) == pytest.approx(y, abs=1e-4)
    hull = baseline.rubber_band(np.arange(40.0), y)
    assert (hull <= y + 1e-9).all() and hull[0] == y[0] and hull[-1] == y[-1]


def test_unmixing(spark):
    x = np.linspace(5, 40, 200)
    line = lambda c, h: h * np.exp(-(((x - c) / 0.5) ** 2))
    a, b = line(10, 1) + line(20, 0.6) + line(30, 0.4), line(15, 0.8) + line(25, 1) + line(35, 0.5)
    rows = spark.createDataFrame([("mix", float(u), float(v), float(0.7 * u + 0.3 * v)) for u, v in zip(a, b)] + [("a", float(u), float(v), float(u - 0.2 * v)) for u, v in zip(a, b)], "g string, a double, b double, y double")
    out = {r.g: (r.part_a, r.part_b) for r in mixture.unmix_two(rows, ["g"], "y", "a", "b").collect()}
    assert out["mix"] == pytest.approx((0.7, 0.3)) and out["a"] == pytest.approx((1.0, 0.0))
    assert mixture.unmix(rows.filter("g = 'mix'"), "y", ["a", "b"]) == {"a": pytest.approx(0.7), "b": pytest.approx(0.3)}


def test_reflections_and_line_shapes(spark):
    g = pattern.reciprocal_metric(5, 5, 5, 90, 90, 90)
    angle = lambda u, v: math.degrees(spark.range(1).select(pattern.angle_between(g, [F.lit(x) for x in u], [F.lit(x) for x in v])).first()[0])
    assert [angle((1, 0, 0), v) for v in ((0, 1, 0), (2, 0, 0), (1, 1, 0))] == pytest.approx([90, 0, 45], abs=1e-6)
    lines = spark.createDataFrame([(20.0, 100.0)], "two_theta double, intensity double")
    second = pattern.doublet(lines).filter("line = 2").first()
    assert second.two_theta == pytest.approx(2 * math.degrees(math.asin(math.sin(math.radians(10)) * 1.544426 / 1.540598))) and second.intensity == 50
    far = pattern.reflections(spark, (24.61, 24.61, 24.61, 90, 90, 90), 1.5406, 5, 50)
    assert far.agg(F.max("h")).first()[0] >= 12


def test_elements_and_cells(spark):
    rows = spark.createDataFrame([("O2-", "x"), ("Fe3+", "x"), (None, "C12"), ("Q", "zz")], "t string, l string")
    assert [r[0] for r in rows.select(structure.element_of(F.col("t"), F.col("l"))).collect()] == ["O", "Fe", "C", ""]
    m = structure.cartesian((6.1, 7.2, 8.3, 70, 80, 100))
    v = spark.range(1).select(structure.cell_volume(*[F.lit(float(x)) for x in (6.1, 7.2, 8.3, 70, 80, 100)])).first()[0]
    assert np.linalg.det(m) == pytest.approx(v)


def test_acceptance_without_a_spread_and_by_its_root(spark):
    flat = spark.createDataFrame([(0.25, 1.0)] * 6, "leverage double, q double")
    for method in ("classical", "robust"):
        a = outliers.acceptance(flat, method=method)
        assert (a.nh, a.nq) == (1, 1) and a.h0 == pytest.approx(0.25) and a.critical == pytest.approx(dist.chi2_ppf(0.95, 2))
    for dof in (1, 3, 17):
        iqr, median = dist.chi2_ppf(0.75, dof) - dist.chi2_ppf(0.25, dof), dist.chi2_ppf(0.5, dof)
        assert outliers._robust_dof(median, iqr) == (dof, pytest.approx(dof))
    assert outliers._robust_dof(1.0, 1e-9)[0] == 250 and outliers._robust_dof(1.0, 50.0)[0] == 1 and outliers._robust_dof(0.0, 0.0) == (1, 1e-12)
    empty = spark.createDataFrame([(0.1, 1e-15), (0.3, 0.0), (0.2, 1e-14)], "leverage double, q double")
    a = outliers.acceptance(empty, gamma=None)
    assert a.nq == 0 and math.isinf(a.q0) and math.isinf(a.outlier)
    assert {r.kind for r in outliers.accept(empty, a).collect()} <= {"regular", "extreme"}


def test_phase_verdict_goes_by_new_peaks_and_not_by_the_residual(spark):
    grid = np.arange(5, 40, 0.05)
    peak = lambda at, h: h * np.exp(-(((grid - at) / 0.5) ** 2))
    a, b = peak(10, 1) + peak(20, 0.6) + peak(30, 0.4), peak(15, 0.8) + peak(25, 1) + peak(35, 0.5)
    wide = 0.3 * np.exp(-(((grid - 22) / 60.0) ** 2)) + 0.3
    made = {"mixture": 0.7 * a + 0.3 * b, "new": 0.7 * a + 0.3 * b + peak(12.5, 0.12), "raised": 0.7 * a + 0.3 * b + wide}
    rows = [(k, float(x), float(y), float(u), float(v)) for k, ys in made.items() for x, y, u, v in zip(grid, ys, a, b)]
    found = {r.k: r for r in mixture.phase_report(spark.createDataFrame(rows, "k string, x double, y double, a double, b double"), ["k"], "y", "a", "b", weight="unit").collect()}
    assert found["mixture"].verdict == "sum_of_parents" and found["mixture"].part_a == pytest.approx(0.7, abs=1e-6) and found["mixture"].new_peaks == []
    assert found["new"].verdict == "new_signal" and found["new"].rwp < 0.15 and found["new"].new_peaks[0].x == pytest.approx(12.5, abs=0.06)
    assert found["raised"].rwp > 0.15


def test_refined_errors_of_a_nearly_perfect_line(spark):
    rows = [("g", float(x), 1e6 + 3.0 * x + (1e-7 if x % 2 else -1e-7)) for x in range(20)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    m = calibration.refined(df, calibration.fit(df, ["g"], "x", "y"), ["g"], "x", "y").first()
    assert 0 < m.s_resid < 1e-6 and m.r2 == pytest.approx(1.0) and m.n == 20


def test_ratios_of_a_perfect_prediction(spark):
    r = stats.spread_ratios(spark.createDataFrame([("a", 1.0), ("a", 3.0)], "g string, y double"), ["g"], "y", F.lit(0.0)).first()
    assert math.isinf(r.rpd) and math.isinf(r.rpiq)
    fit = stats.fit_stats(spark.createDataFrame([("a", 2.0, 2.0), ("a", 2.0, 3.0), ("a", None, 1.0)], "g string, y double, p double"), ["g"], "y", "p").first()
    assert fit.n == 2 and fit.r2 is None and fit.rmse == pytest.approx(math.sqrt(0.5))


def test_band_metrics_ignore_a_sloping_background(spark):
    grid = np.arange(100.0, 200.0, 1.0)
    band = np.exp(-(((grid - 150) / 6) ** 2))
    rows = [(0, band.tolist()), (1, (band + 0.02 * grid + 3).tolist())]
    anchors = traces.locked_anchors(band + 1e-4 * np.abs(grid - 150), grid, 150, 12, 40)
    assert traces.auto_windows(band, grid, [(150, "b")], gap=12, most=40)[0][2] == "b"
    got = spark.createDataFrame(rows, "k int, spectrum array<double>").select("k", *[v.alias(n) for n, v in traces.band_metrics(grid, anchors, 150).items()]).orderBy("k").collect()
    assert got[0].deriv2 == pytest.approx(got[1].deriv2, abs=1e-9) and got[0].area == pytest.approx(6 * math.sqrt(math.pi), rel=0.02) and got[1].height == pytest.approx(got[0].height, abs=0.05)
    with pytest.raises(ValueError):
        traces.locked_anchors(band, grid, 500)


def test_cross_validation_names_its_question(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist(), float(i % 4), i % 4) for i in range(24)]
    df = spark.createDataFrame(rows, "sample int, spectrum array<double>, y double, grp int")
    loo, kfold, logo = (validate.cross_validate(df, 2, **o).first() for o in ({}, {"scheme": "kfold"}, {"groups": "grp"}))
    assert (loo.scheme, loo.code, loo.severity) == ("loo", "levels_repeat", "WARN") and (kfold.scheme, kfold.code) == ("kfold", "ok") and logo.scheme == "logo"
    assert loo.n == kfold.n == logo.n == 24
    with pytest.raises(ValueError):
        validate.cross_validate(df, 2, "other")


def test_density_branches_and_strict_gate(spark):
    base = {"volume": 1000.0, "mass": 600.0, "electrons": 100.0, "counts": {"C": 40.0, "O": 20.0}, "formula": {"C": 20.0, "O": 10.0}, "weight": 300.0, "z": 2.0, "density": 0.996, "f000": 100.0}
    cases = {
        "consistent": {}, "not_declared": {"density": None}, "declared_off": {"weight": 500.0}, "weight_off": {"mass": 700.0, "weight": 300.0}, "atoms_missing": {"mass": 400.0, "counts": {"C": 20.0}, "weight": 400.21},
        "expansion_wrong": {"mass": 900.0, "formula": {"H": 1.0}, "counts": {"H": 2.0}, "weight": 1.008, "density": 1.66042 * 1.008 * 2 / 1000}, "cell_off": {"mass": 700.0, "formula": None},
    }
    kind = "want string, volume double, mass double, electrons double, counts map<string,double>, formula map<string,double>, weight double, z double, density double, f000 double"
    rows = [(want, *[(base | change)[k] for k in base]) for want, change in cases.items()]
    for r in structure.density_review(spark.createDataFrame(rows, kind)).collect():
        assert r.branch == r.want and (r.severity == "FAIL") == (r.want == "expansion_wrong")
    findings = spark.createDataFrame([("a", "INFO"), ("a", "WARN"), ("b", "FAIL")], "g string, severity string")
    assert {r.g: r.severity for r in review.worst(findings, ["g"]).collect()} == {"a": "WARN", "b": "FAIL"}
    with pytest.raises(Exception, match="gate failed: b"):
        review.worst(findings, ["g"], strict=True).collect()


def test_complementary_pairs_meet_in_buckets_of_every_value(spark):
    rng = np.random.default_rng(6)
    rows = [(k, *map(float, np.round(rng.uniform([-1, 0, -9], [1, 1, 9]), 1))) for k in range(150)]
    rows += [(200 + k, *rows[k % 7][1:]) for k in range(40)] + [(300, None, 0.5, 1.0), (301, 0.5, None, 1.0), (302, 0.5, 0.5, math.nan)]
    table = lambda some: spark.createDataFrame(some, "id int, short double, middle double, dipole double")
    found = mixture.complementary_pairs(table(rows), table(rows[::2]))
    got = [(r.l.id, r.r.id) for r in found.collect()]
    near = lambda a, b: None not in a + b and abs(a[1] - b[1]) <= 0.2 and abs(a[2] - b[2]) <= 0.2 and abs(a[3] - b[3]) <= 4
    assert sorted(got) == [(a[0], b[0]) for a in rows for b in sorted(rows[::2]) if near(a, b)] and len(got) > 500
    assert "__dipole" in found._jdf.queryExecution().toString()  # rows alike in one value alone never meet
