"""The pipeline against its stages done plainly in Python, and what remains when a stage has nothing to do."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_classifiers import word
from tests.llm.test_decontaminate import brute
from tests.llm.test_simhash import brute_print, brute_roots


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    d = tmp_path_factory.mktemp("sf")
    clean = [" ".join(word(rng) for _ in range(rng.randint(30, 90))) for _ in range(160)]
    item = " ".join(word(rng) for _ in range(20))
    texts = clean + [t.upper() for t in clean[:10]] + [t + " " for t in clean[10:20]] + [clean[21] + " " + item, None, ""]
    bad = [" ".join(word(rng).upper() + "!!" for _ in range(60)) for _ in range(80)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts + bad)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(not (t or "").isupper() and "!!" not in (t or "")), 0) for i, t, *_ in rows if t and i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages_match_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    good = stages["quality_classifier"](spark, docs, sf_dir)
    rows = {r.doc_id: r.text for r in good.collect()}
    assert sum("!!" in (t or "") for t in rows.values()) <= 2 and len(rows) >= 150

    exact = stages["exact_dedup"](spark, good, sf_dir)
    lower = {}
    for i in sorted(rows):
        lower.setdefault((rows[i] or "").lower(), i)
    assert {r.doc_id for r in exact.collect()} == set(lower.values())

    near = stages["simhash_near_dedup"](spark, exact, sf_dir)
    ids = sorted(lower.values())
    roots = brute_roots([brute_print(rows[i]) for i in ids], 2)
    assert {r.doc_id for r in near.collect()} == {ids[k] for k in set(roots)}

    clean = stages["benchmark_decontamination"](spark, near, sf_dir)
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in near.collect() if not brute(r.text, [(1, item)], 13)[4]}
    for stage in (good, exact, near, clean):
        assert stage.columns == docs.columns

    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean.collect()}
    used = Counter()
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0
