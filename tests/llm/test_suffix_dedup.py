import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from assayflow.llm import suffix_dedup
from assayflow.llm.suffix_dedup import _rerank, remove_repeats


def brute(texts, size):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(raw[i : i + size] for raw in raws for i in range(len(raw) - size + 1))
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - size + 1):
            if seen[raw[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((len(raw), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out


def random_texts(seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(10, 90))) for _ in range(6)]
    texts = [None, "", "short"]
    for _ in range(60):
        text = "".join(rng.choice(passages) if rng.random() < 0.3 else "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 6)))
        if rng.random() < 0.3 and len(texts) > 5:
            text = rng.choice(texts[4:])
            if rng.random() < 0.7 and text:
                at = rng.randrange(len(text))
                text = text[:at] + "#" + text[at + 1 :]
        texts.append(text)
    return [*texts, "a" * 300, "ab" * 100, "a" * 55]


def removed(spark, texts, size, **options):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs, size, **options).collect()}
    return [got[i] for i in range(len(texts))]


@pytest.mark.parametrize(("seed", "block"), [(1, 1 << 20), (2, 1 << 20), (3, 70)])
def test_removed_bytes_match_brute_force(spark, seed, block):
    texts = random_texts(seed)
    assert removed(spark, texts, 24, block=block) == brute(texts, 24)


def test_production_threshold_on_periodic_texts_and_a_hot_passage(spark):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    passage, other = noise(330), noise(260)
    texts = [noise(rng.randint(0, 300)) + passage[rng.randint(0, 60) :] + noise(rng.randint(0, 300)) for _ in range(60)]
    texts += [noise(150) + other + noise(90), other[20:] + passage, "ab" * 300, "b" + "ab" * 250 + "c", "x" * 900, "x" * 199, "x" * 200 + "y", noise(199), noise(5_000)]
    texts += [texts[3][:250] + "#" + texts[3][250:], texts[3], None]
    assert removed(spark, texts, 200) == brute(texts, 200)


def test_ranks_of_sorted_pairs(spark):
    """Over many tasks, with one pair that a third of all positions have and pairs that occur once."""
    rng = random.Random(9)
    rows = [(no, place, 7, 7, no) if no % 3 == 0 else (no, place, rng.randint(0, 9), rng.randint(-40, 40), no) for no in range(900) for place in range(3)]
    positions = spark.createDataFrame(rows, "no long, place int, rank long, next long, then long").repartition(5)
    several = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "9"}
    before = {k: spark.conf.get(k) for k in several}
    try:
        for k, v in several.items():
            spark.conf.set(k, v)
        got = {(r.no, r.place): r.rank for r in _rerank(positions).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    counts = Counter((r[2], r[3]) for r in rows)
    order = {pair: i for i, pair in enumerate(sorted(counts))}
    assert got == {(r[0], r[1]): order[r[2], r[3]] for r in rows if counts[r[2], r[3]] > 1}
    assert _rerank(spark.createDataFrame([], "no long, place int, rank long, next long, then long")).count() == 0


def test_shared_and_null_ids_and_empty_table(spark):
    text = "the quick brown fox jumps over the lazy dog"
    docs = spark.createDataFrame([(1, text), (1, text), (1, "another text under the same id, unlike"), (None, "x" + text)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in remove_repeats(docs, 24).collect())
    assert got == [(0, 44, 43), (1, 38, 0), (1, 43, 43), (1, 43, 43)]
    assert remove_repeats(docs.limit(0), 24).count() == 0


def test_kernels_hold_little_of_a_long_text():
    raw = np.random.default_rng(1).integers(97, 123, 3 << 20, dtype=np.uint8).tobytes()
    suffix_dedup._POWERS.clear()
    tracemalloc.start()
    for _, _, parts in suffix_dedup._blocks([raw], 200, suffix_dedup.BLOCK):
        suffix_dedup.anchors(parts, 200)
    suffix_dedup._first_ranks([raw[at : at + 400] for at in range(0, suffix_dedup.NAMED, 400)], 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20


def test_copies_of_a_passage_meet_in_no_task(spark):
    # the sort-merge plan, as on tables too large to broadcast
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = suffix_dedup._keyed(spark.createDataFrame(list(enumerate(random_texts(1))), "doc_id long, text string")).drop("doc_id")
        plan = suffix_dedup.repeated_spans(docs, 24)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(id" in plan and "hashpartitioning(rank" not in plan
