"""Near dedup by similarity against all pairs."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from assayflow.llm import similar


def shingles(text, size=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_kept(rows, similarity=0.8):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9 and root[i] != root[j]:
                gone, to = root[i], root[j]
                root = [to if r == gone else r for r in root]
    return sorted(min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root))


def texts(rng):
    out = [None, "", " ", "one", "one two", "ONE  two", "a b c d e", "a b c d e f", "w " * 3000]
    for k in range(30):
        base = [f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(rng.randint(20, 300))]
        out.append(" ".join(base))
        for changes in (1, 2, 4, 8):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = f"new{rng.randint(0, 99999)}"
            out.append(" ".join(copy) + " " + " ".join(f"tail{rng.randint(0, 9999)}" for _ in range(rng.randint(0, 9))))
    return out


def test_kept_rows_match_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k * 37 % 1009, t) for k, t in enumerate(texts(rng))]
    want = brute_kept(rows)
    assert len(want) < len(rows) - 40
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, n int")
    for tree, block in ((1024, 256), (1, 3)):
        monkeypatch.setattr(similar, "MOST_IN_TREE", tree)
        monkeypatch.setattr(similar, "MOST_IN_BLOCK", block)
        kept = similar.drop_similar(docs)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == want
    assert similar.drop_similar(docs.limit(0)).count() == 0


def test_a_hot_group_without_a_centre(spark, monkeypatch):
    """A chain of copies, each with a few words other than the last, in blocks of few; most pairs aren't similar."""
    rng = random.Random(4)
    words, rows = [f"word{i}" for i in range(120)], []
    for k in range(60):
        for at in range(k * 2, k * 2 + 2):
            words[at % 120] = f"other{k}"
        rows.append((rng.randint(0, 10**6), " ".join(words)))
    monkeypatch.setattr(similar, "MOST_IN_TREE", 5)
    monkeypatch.setattr(similar, "MOST_IN_BLOCK", 7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in similar.drop_similar(docs).collect()) == brute_kept(rows)


def test_stage_drops_copies_with_changed_words_and_keeps_others(spark):
    rng = random.Random(3)
    base = [f"word{rng.randint(0, 9999)}" for _ in range(300)]
    near, far = list(base), list(base)
    for at in (40, 120, 200, 280):
        near[at] = "changed"
    for at in range(10, 300, 12):
        far[at] = "changed"
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "").collect()) == [1, 3]


def test_one_row_of_each_component_with_repeats_and_without_ids(spark):
    a, b = "the same words in each of these rows", "these are quite other words than those above"
    rows = [(5, a), (5, a.upper()), (5, b), (5, b), (None, a), (None, "no id here at all but some words"), (None, "no id here at all but some words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((str(r.doc_id), r.text.lower()) for r in similar.drop_similar(docs).collect())
    assert kept == [("5", a), ("5", b), ("None", "no id here at all but some words")]
    assert similar.drop_similar(docs.withColumn("doc_id", F.col("doc_id").cast("string"))).count() == 3


def test_shingles_of_every_text_are_counted(spark):
    docs = spark.range(41_000).select(F.concat(F.lit("w"), F.col("id") % 40_000).alias("text"))
    counts = similar._common(docs, 5)
    assert counts.sum() == 41_000
    assert (counts[similar.shingle_set(b"w7", 5) >> (64 - similar.CELL_BITS)] >= 2).all()
