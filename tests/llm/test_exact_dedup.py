import hashlib

import pytest
from pyspark.sql import functions as F

from assayflow.llm import exact_dedup as ed


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, keep_id string, row string")


ROWS = [(1, "Same", "x", "r"), (2, "sAME", "x", "r"), (3, "ÀB", "x", "r"), (4, "àb", "x", "r"), (5, None, "x", "r"), (6, "", "x", None), (None, "same", "x", "r"), (7, "y" * 200_000, "x", "r"), (7, "y" * 200_000, "x", "r")]


@pytest.mark.parametrize("keep", ["min", "max"])
def test_groups_and_defined_cases(spark, keep):
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in ed.exact_dedup(docs(spark, ROWS), keep=keep).collect()]
    pick = min if keep == "min" else max
    best, blank = pick(1, 2), pick(5, 6)
    want = [(i, best, 3, i == best) for i in (1, 2, None)] + [(3, 3, 1, True), (4, 4, 1, True)] + [(i, blank, 2, i == blank) for i in (5, 6)] + [(7, 7, 2, True)] * 2
    assert sorted(got, key=str) == sorted(want, key=str)
    sums = {r.doc_id: r.text_sha256 for r in ed.exact_dedup(docs(spark, ROWS)).collect()}
    assert sums[3] == hashlib.sha256("Àb".encode()).hexdigest() and sums[5] == hashlib.sha256(b"").hexdigest()


def test_colliding_hashes_are_told_apart_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(F, "md5", lambda c: F.lit("00"))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in ed.exact_dedup(docs(spark, ROWS[:4])).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 1)}


def test_filter_keeps_columns_and_empty_tables(spark):
    kept = ed.drop_exact_copies(docs(spark, ROWS[:6]))
    assert kept.columns == ["doc_id", "text", "keep_id", "row"] and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]
    assert ed.exact_dedup(docs(spark, [])).count() == 0 and ed.drop_exact_copies(docs(spark, [])).count() == 0


def test_texts_without_any_id_are_not_lost(spark):
    rows = [(None, "only", "x", "r"), (None, "also", "x", "r"), (None, "ALSO", "x", "s"), (None, "named", "x", "r"), (4, "Named", "x", "r")]
    kept = ed.drop_exact_copies(docs(spark, rows))
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("4", "Named"), ("None", "ALSO"), ("None", "also"), ("None", "only")]


def test_filter_leaves_one_row_of_repeats(spark):
    rows = [(1, "Same", "x", "r"), (1, "same", "y", "r"), (1, "same", "y", "r"), (2, "same", "x", "r"), (1, "other", "x", "r"), *[(None, "nameless", "x", "r")] * 3, (None, None, "x", "r"), (None, "", "x", "r")]
    for keep, named in (("min", 1), ("max", 2)):
        kept = ed.drop_exact_copies(docs(spark, rows), keep=keep).collect()
        assert sorted((str(r.doc_id), (r.text or "").lower()) for r in kept) == sorted([(str(named), "same"), ("1", "other"), ("None", "nameless"), ("None", "")])
