import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from assayflow.llm import simhash

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(values, radius):
    root = list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(values))]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbBÉé \t\n\x0b\x1c .", max_size=80))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_print(text)


def test_fingerprint_across_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "_BLOCK", 7)
    text = " ".join(str(k * k % 13) for k in range(50))
    assert simhash.fingerprint(text.encode()) == brute_print(text)


def test_tree_finds_all_within_radius():
    rng = random.Random(1)
    values = list({rng.getrandbits(64) & 0xFFFF for _ in range(300)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:40]:
        assert sorted(tree.values[i] for i in tree.near(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)


def test_masks_cover_every_pair_within_radius():
    for radius in (1, 2, 3):
        masks = simhash._masks(radius)
        for _ in range(300):
            bits = sum(1 << b for b in np.random.default_rng(_).choice(64, radius, replace=False).tolist())
            assert any(not bits & m for m in masks)


def test_components_match_all_pairs(spark, monkeypatch):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(1, 40))) for _ in range(25)]
    texts = [None, "", "   ", "one", "one two", "w " * 30_000]
    for b in base:
        texts += [b, b.upper(), b + " x", b.replace("a", "b", 1)]
    rows = [(i * 3 % 107, t, "clash", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    prints = [brute_print(t) for t in texts]
    for most in (2048, 1):
        monkeypatch.setattr(simhash, "MOST_IN_SHARD", most)
        for radius in (2, 8):
            roots = brute_roots(prints, radius)
            least = {}
            for (i, *_), r in zip(rows, roots):
                least[r] = min(i, least.get(r, i))
            want = {i: (f"{p:016x}", least[r]) for (i, *_), p, r in zip(rows, prints, roots)}
            if radius == 8 and most == 1:
                continue
            assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, radius).collect()} == want
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {v for _, v in [(0, c) for c in {x.component_id for x in simhash.near_duplicates(df).collect()}]}


def test_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (9, "q")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [("5", 5), ("5", 5), ("9", 9), ("None", 5)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_one_id_on_two_texts(spark):
    a, b = "one text of some words", "quite another one that has no copy"
    for extra in ([], [(9, b.upper())]):
        df = spark.createDataFrame([(1, a), (5, a.upper()), (5, b), *extra], "doc_id long, text string")
        assert sorted((r.doc_id, r.text) for r in simhash.drop_near_copies(df).collect()) == [(1, a), (5, b)]


def test_filter_leaves_one_row_on_ties(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "q r"), (None, "q r")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in simhash.drop_near_copies(df).collect()) == [("5", "a b c d"), ("None", "q r")]
