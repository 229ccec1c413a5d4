import hashlib
import random
import re

import pytest

import corpus_pipeline
from assayflow.llm import decontaminate as dc
from assayflow.llm.queries import OP10_SQL, op10_benchmark_decontamination


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items, window):
    seq, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            win = w[k : k + window]
            for at in range(len(seq) - len(win) + 1):
                if seq[at : at + len(win)] == win:
                    hit.update(range(at, at + len(win)))
                    found.add(str(item))
    ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(seq), len(hit), len(found), ids, bool(hit) and 20 * len(hit) >= len(seq), hit


@pytest.mark.parametrize("shard_bytes", [4_000_000, 150])
def test_hits_match_brute_force(spark, shard_bytes):
    rng = random.Random(2)
    vocabulary = ["alpha", "Beta", "ça", "x1", "the", "of", "日本"]
    make = lambda n: rng.choice([" ", ", ", "--"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(10, make(9)), (9, make(2)), (2, make(4)), (3, None), (4, "?!"), (5, make(6)), (5, make(7)), (None, "the")]
    texts = [None, "", "!!", *[make(rng.randint(1, 60)) for _ in range(30)], items[0][1], "q " * 50_000 + items[0][1]]
    texts += [make(5) + " " + items[0][1] + "\n" + make(200)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(0, None, 7)], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.decontaminate(docs, bench, 4, shard_bytes).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        *want, hit = brute(texts[r.doc_id], [x for x in items if x[0] is not None], 4)
        assert [r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated] == want
        assert {k for s in r.spans for k in range(s.first, s.last)} == hit
        for s, c in zip(r.spans, r.chars):
            assert words(texts[r.doc_id][c.first : c.last]) == words(texts[r.doc_id])[s.first : s.last]
    kept = dc.drop_contaminated(docs, bench, 4, shard_bytes)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if not r.contaminated)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert dc.decontaminate(docs.limit(0), bench).count() == 0
    r = dc.decontaminate(docs, bench.limit(0)).first()
    assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (2, 0, 0, False)


def test_items_without_an_id_are_searched(spark, tmp_path):
    import duckdb

    long = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, "x " + long), (2, "short item here"), (3, "named one and short item"), (4, "none"), (5, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, long), (None, "short item"), (7, "named one"), (None, None)], "item_id long, text string")
    for name, df in (("documents", docs), ("benchmark", bench)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    with duckdb.connect() as db:
        for name in ("documents", "benchmark"):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
        want = sorted(db.execute(OP10_SQL).fetchall())
    got = sorted(map(tuple, op10_benchmark_decontamination(spark, str(tmp_path)).collect()))
    assert got == want and [r[2] for r in got] == [20, 2, 4, 0, 0]
    kept = dict(corpus_pipeline.STAGES)["benchmark_decontamination"](spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5]
    split = dc.decontaminate(docs, bench, shard_bytes=100, nameless=True)
    assert sorted((r.doc_id, r.n_hit, r.n_items) for r in split.collect()) == [(r[0], r[2], r[3]) for r in got]


def test_a_benchmark_of_many_shards_and_slices(spark, monkeypatch):
    """Several automata of a bounded size; texts taken through them in slices of a few."""
    rng = random.Random(7)
    items = [(i, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(300))) for i in range(400)]
    cut = [t.split()[40:60] for _, t in items[::150]]
    texts = [" ".join(["before", *c, "after"]) for c in cut] + ["nothing of these", None]
    monkeypatch.setattr(dc, "SCANNED", 200)
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    shards = dc.shards_of(bench, 13, 300_000, False)
    assert len(shards.parts) > 2
    got = sorted((r.doc_id, r.n_hit, r.n_items) for r in dc.decontaminate(docs.coalesce(1), bench, shard_bytes=300_000).collect())
    assert got == [(0, 20, 1), (1, 20, 1), (2, 20, 1), (3, 0, 0), (4, 0, 0)]


def test_words_of_few_texts_are_held_for_one_automaton():
    import pyarrow as pa

    from assayflow.llm.common import slices

    batch = pa.record_batch({"text": ["word " * 100_000] * 20})
    one, two = dc.Shards([None], 13), dc.Shards([None, None], 13)
    sizes = [b.num_rows for b in slices([batch], most=one.scanned)]
    assert sum(sizes) == 20 and max(sizes) <= 5
    assert [b.num_rows for b in slices([batch], most=two.scanned)] == [20]  # automata are built anew for each lot
