import random
import zlib

import numpy as np
import pytest

from assayflow.llm import labelled, quality, subword_model, toxicity
from assayflow.llm.text_stats import NAMES, stats

SYLLABLES = ["ti", "on", "er", "the", "an", "ou", "re", "st", "ha", "ing"]


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))


def corpus(n, seed=0):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        seq = [word(rng) for _ in range(rng.randint(30, 120))]
        good, toxic = int(rng.random() < 0.6), int(rng.random() < 0.35)
        if not good:
            seq = [w.upper() + "!!" for w in seq]
        if toxic:
            for _ in range(4):
                seq.insert(rng.randrange(len(seq)), rng.choice(["grumble", "snarky", "blockhead"]))
        docs.append((i, " ".join(seq), "clash"))
        labels.append((i, good, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus(400)
    odd = [(1000, None, "x"), (1001, "", "x"), (None, "the the", "x"), (1002, " \n ", "x"), (1003, "word " * 40_000, "x"), (1003, "word " * 40_000, "x")]
    return spark.createDataFrame(docs + odd, "doc_id long, text string, score string"), spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


@pytest.mark.parametrize(("classify", "k", "threshold"), [(quality.classify, 0, 0.3), (toxicity.classify, 1, 0.5)])
def test_held_out_accuracy_and_defined_cases(tables, classify, k, threshold):
    docs, labels, truth = tables
    rows = classify(docs, labels).collect()
    assert len(rows) == 406 and all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in rows if r.held_out} == {r.doc_id for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id][k] for r in held]) >= 0.9


@pytest.mark.parametrize("classify", [quality.classify, toxicity.classify])
def test_without_labels_scores_are_constant(spark, tables, classify):
    docs, labels, _ = tables
    assert len({r.score for r in classify(docs.limit(9), labels.limit(0)).collect()}) <= 1
    assert classify(docs.limit(0), labels).count() == 0
    one = labels.filter("quality = 1 and toxic = 1")
    assert classify(docs, one).count() == 406


def test_filter_keeps_columns(tables):
    docs, labels, truth = tables
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    right = [(i in ids) == bool(q) for i, (q, _) in truth.items()]
    assert np.mean(right) >= 0.95


def test_isotonic_is_monotone_and_pools():
    score, y = np.array([0.1, 0.2, 0.3, 0.4, 0.5]), np.array([0.0, 1.0, 0.0, 1.0, 1.0])
    knots, values = quality.isotonic(score, y)
    assert (np.diff(values) >= 0).all() and np.interp(0.25, knots, values) == pytest.approx(0.5) and (np.diff(knots) > 0).all()


def test_tasks_pool_as_one(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 40, (600, len(NAMES))) / 8
    y = (rng.random(600) < x[:, 0] / 5).astype(int)
    p = len(NAMES)
    linear = quality.Model(np.zeros(p), np.full(p, 2.0), np.zeros((p, 1)), np.zeros(1), np.r_[0, 1, np.zeros(p)], np.zeros(1), np.zeros(1))
    rows = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x array<double>, y int").repartition(7)
    score = (linear.features(x) @ linear.weights).round(12)
    order = np.lexsort((-y, score))  # of equal scores the ones first, so that they are pooled
    for got, want in zip(quality._isotonic(rows, linear), quality.isotonic(score[order], y[order])):
        assert got == pytest.approx(want)


def test_every_labelled_document_is_learnt_from(spark):
    ids = spark.range(25_800).withColumnRenamed("id", "doc_id")
    known = labelled.known(ids.selectExpr("doc_id", "1 as quality"), "quality")
    last = {r.doc_id for r in known.selectExpr("doc_id", "xxhash64(doc_id, 11) as h").orderBy("h").offset(20_000).collect()}
    assert 100 < len(last) < 1500
    rows = [(i, "NO!! WAY!!" if i in last else "yes of course", int(i not in last)) for i in range(25_800)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    kept = quality.keep_good(table.select("doc_id", "text"), table.select("doc_id", "quality"))
    assert {r.doc_id for r in kept.collect()} == {i for i in range(25_800) if i not in last}


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    p, d = len(NAMES), 4096
    m = quality.Model(np.zeros(p), np.ones(p), rng.normal(size=(p, d)) / 4, rng.uniform(0, 2 * np.pi, d), np.zeros(1), np.zeros(1), np.zeros(1))
    x = rng.normal(size=(2, p))
    f = m.features(x)[:, 1 + p :]
    assert f[0] @ f[1] == pytest.approx(np.exp(-((x[0] - x[1]) ** 2).sum() / 32), abs=0.06)


def test_statistics_of_odd_texts():
    for t in (None, "", " ", "\n", "a", "é" * 10, "x " * 100_000):
        v = stats(t)
        assert len(v) == len(NAMES) and np.isfinite(v).all()


def test_score_is_that_of_the_worst_stretch_wherever_it_starts():
    docs, labels = corpus(300, 5)
    model = subword_model.train([t for _, t, _ in docs], np.array([t for _, _, t in labels]))
    for text in ["", "one", docs[0][1], docs[1][1] * 3, "blockhead " + docs[2][1]]:
        scores = []
        for w in subword_model.words(text):
            buckets, _ = subword_model.grams([w])
            scores.append(sum(model.gram_scores[b] for b in buckets) / max(1, len(buckets)))
        size = min(len(scores), subword_model.STRETCH)
        worst = max((sum(scores[i : i + size]) / subword_model.STRETCH for i in range(len(scores) - size + 1)), default=0.0) if scores else 0.0
        want = 1 / (1 + np.exp(-np.clip(worst + model.bias, -30, 30)))
        assert model.texts([text.encode()])[0] == pytest.approx(want, abs=1e-9)
    plain = docs[3][1]
    one, two = model.texts([(plain + " snarky grumble").encode(), ("word " + plain + " snarky grumble").encode()])
    assert one == pytest.approx(two, abs=1e-9)


def test_sample_is_bounded_by_bytes(spark):
    rows = spark.createDataFrame([(f"{i}" * 100, i % 2, 1, i) for i in range(8)] + [("x" * (labelled.LONGEST + 1), 1, 1, -1), (None, 0, 1, 99)], "text string, y int, fold int, order long")
    assert sorted(r.order for r in labelled.within(rows, 20, 450).collect()) == [0, 1, 2, 3]
    assert labelled.within(rows, 20).count() == 9


def test_grams_and_unseen_misspelling():
    buckets, owners = subword_model.grams([b"abc", b"de"])
    alone = subword_model.grams([b"abc"])[0]
    assert sorted(buckets[owners == 0]) == sorted(alone) and len(alone) == 6  # " ab abc bc " and so on up to " abc "
    docs, labels = corpus(400, 3)
    model = subword_model.train([t for _, t, _ in docs], np.array([t for _, _, t in labels]))
    plain = " ".join(word(random.Random(9)) for _ in range(60))
    scores = model.texts([plain.encode(), (plain + " blockheadd").encode(), (plain + " snarkky").encode()])
    assert scores[0] < 0.5 < scores[1] and scores[2] > scores[0]
