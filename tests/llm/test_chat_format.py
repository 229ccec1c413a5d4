import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayflow.llm import chat_format as cf

CONTROLS = cf.ChatTemplate().controls


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    return cf.format_chats(df).withColumn("turns", cf.read_turns(F.col("formatted")))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "a|b~x", ""]), st.lists(st.sampled_from([*CONTROLS, "~", "~0", "~1", " ", "<", "[", "\n", "é", "ok", "[/INST", " [/INST]", "$1", "\\"]), max_size=8).map("".join)), min_size=1, max_size=6), min_size=1, max_size=8))
def test_round_trip(spark, chats):
    rows = [(c, t, role, text, "x") for c, turns in enumerate(chats) for t, (role, text) in enumerate(turns)]
    for r in run(spark, rows).collect():
        assert [(t.role, t.text) for t in r.turns] == chats[r.conv_id]
        assert "".join(s.text for s in r.segments) == r.formatted
        kept = [s.text for s in r.segments if s.loss]
        assert len(kept) == sum(role == "assistant" for role, _ in chats[r.conv_id])
        for s in r.segments[1::3]:
            assert not any(c in s.text for c in CONTROLS)


@pytest.mark.parametrize(("roles", "valid", "bad"), [("sua", True, None), ("ua", True, None), ("uaua", True, None), ("u", False, 0), ("us", False, 1), ("uu", False, 1), ("a", False, 0), ("sus", False, 2), ("uax", False, 2)])
def test_turn_order(spark, roles, valid, bad):
    names = {"s": "system", "u": "user", "a": "assistant", "x": "other"}
    r = run(spark, [(1, k, names[c], "t", "x") for k, c in enumerate(roles)]).first()
    assert (r.valid, r.first_bad_turn) == (valid, bad)


def test_nulls_ties_long_texts_and_empty(spark):
    long = "<s> " * 60_000
    rows = [(1, 1, "assistant", None, "x"), (1, 0, None, "b", "x"), (1, 0, None, "a", "x"), (None, None, "user", long, "x"), (2, 0, "user", "r", "x"), (2, 0, "user", "r", "x")]
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in run(spark, rows).collect()}
    assert got == {1: [("", "a"), ("", "b"), ("assistant", "")], None: [("user", long)], 2: [("user", "r")] * 2}
    assert run(spark, []).count() == 0
