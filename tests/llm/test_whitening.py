import numpy as np
import pytest

from assayflow.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, x string, whitened double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], SCHEMA)


def plain(vectors, top=16):
    """n, S, falling eigenvalues and axes of the different whole-number vectors, in the plainest way."""
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    z = fit - s / n
    values, axes = np.linalg.eigh(z.T @ z / n)
    return x, n, s, values[::-1], axes[:, ::-1][:, :top]


def check(rows, vectors):
    """rows: (vector's place, component) -> row."""
    x, n, s, values, axes = plain(vectors)
    top = max(k for _, k in rows)
    white = (x - s / n) @ axes[:, :top] / np.sqrt(values[:top])
    for k in range(1, top + 1):
        got = np.array([rows[i, k]["whitened"] for i in range(len(x))])
        assert min(np.abs(got - white[:, k - 1]).max(), np.abs(got + white[:, k - 1]).max()) < 1e-7
    for (i, k), r in rows.items():
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], s))
        assert r["explained"] == pytest.approx(values[k - 1] / values.sum(), rel=1e-9) and r["identity_error"] < 1e-8
    return top


@pytest.mark.parametrize("dims", [3, 20, 40])
def test_matches_a_plain_decomposition(spark, dims, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 32)
    rng = np.random.default_rng(dims)
    spread = np.linspace(1, 3, dims)
    vectors = [v.tolist() for v in (rng.normal(size=(150, dims)) * spread).astype(np.float32)]
    vectors += [vectors[0]] * 80 + [vectors[1]]  # copies weigh nothing
    got = whitening.whiten(frame(spark, list(enumerate(vectors)))).collect()
    assert check({(r.vec_id, r.component): r.asDict() for r in got}, vectors) == min(16, dims) and len(got) == len(vectors) * min(16, dims)


def test_vectors_that_do_not_count(spark):
    rng = np.random.default_rng(5)
    good = [v.tolist() for v in rng.normal(size=(9, 2)).astype(np.float32)]
    bad = [None, [], [1.0, None], [float("nan"), 1.0], [1.0, float("-inf")], [1.0], [1.0, 2.0, 3.0], [3e38, 0.0]]
    rows = [(i, v) for i, v in enumerate(good)] + [(100 + i, v) for i, v in enumerate(bad)] + [(None, good[0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r.vec_id for r in got} == {*range(9), None}
    check({(r.vec_id, r.component): r.asDict() for r in got if r.vec_id is not None}, good)


def test_components_without_spread(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    got = whitening.whiten(frame(spark, [(k, [float(k), 2.0 * k, 1.0]) for k in range(5)])).collect()
    assert {r.component for r in got} == {1} and all(r.explained == pytest.approx(1) for r in got)


def test_a_deviation_that_does_not_fit(spark):
    rows = [(k, [k * 3e8, 1.0]) for k in range(40)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(frame(spark, rows)).collect()}
    x, n, s, *_ = plain([v for _, v in rows])
    for i in got:
        exact = sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], s))
        assert got[i] == (exact if exact < 2**63 else None)
    assert None in got.values()


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    table = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = sorted(table)
    place = {i: k for k, i in enumerate(ids)}
    got = queries.op12_embedding_whitening(spark, sf).collect()
    assert len(got) == 16 * len(ids)
    check({(place[r.vec_id], r.component): r.asDict() for r in got}, [table[i] for i in ids])
