"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """marks: role -> (start, end, whether the text is under the loss). Other roles use other_start + name + other_mid."""

    marks: dict[str, tuple[str, str, bool]] = field(
        default_factory=lambda: {
            "system": ("<<SYS>> ", " <</SYS>>", False),
            "user": ("[INST] ", " [/INST]", False),
            "assistant": ("<s> ", " </s>", True),
        }
    )
    other: tuple[str, str, str] = ("<|role=", "|> ", " <|/role|>")
    #: (state, role) -> state; a pair that is missing leads to "bad", which is never left.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "primed", ("start", "user"): "asked", ("primed", "user"): "asked",
            ("asked", "assistant"): "answered", ("answered", "user"): "asked",
        }
    )
    accepts: tuple[str, ...] = ("answered",)

    @property
    def controls(self) -> list[str]:
        return [x.strip() for m in self.marks.values() for x in m[:2]] + [self.other[0], self.other[2].strip()]


def _quote(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()<>*+-=!?^$|/" else c for c in text)


def escape(text: Column, template: ChatTemplate) -> Column:
    """Reversible: ~ becomes ~0, and ~1 goes in after the first character of each control string."""
    ahead = "|".join(f"{_quote(c[0])}(?={_quote(c[1:])})" for c in template.controls)
    return F.regexp_replace(F.replace(text, F.lit("~"), F.lit("~0")), f"({ahead})", "$1~1")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("~1"), F.lit("")), F.lit("~0"), F.lit("~"))


def _role_name(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("~"), F.lit("~0")), F.lit("|"), F.lit("~2"))


def _name_back(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("~2"), F.lit("|")), F.lit("~0"), F.lit("~"))


def _by_role(role: Column, template: ChatTemplate, k: int, default: Column) -> Column:
    out = default
    for name, marks in template.marks.items():
        out = F.when(role == name, F.lit(marks[k])).otherwise(out)
    return out


def _moves(template: ChatTemplate) -> Column:
    return F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}>{role}", to)])


def format_chats(rows: DataFrame, template: ChatTemplate | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per conversation: conv_id, segments array<struct<text, loss>>, formatted, valid, first_bad_turn.

    Turns are taken by turn number; equal numbers by role, then text; null numbers first. Null texts and roles are
    empty. A conversation that breaks the order of roles is formatted like any other, with valid false and the
    0-based place of its first wrong turn (its last turn if it only stops early). Rows without a conv_id form one
    conversation with a null id. An empty table gives no rows; other columns are ignored. One conversation is one
    value, so its turns meet in one row; conversations share nothing.
    """
    t = template or ChatTemplate()
    turns = rows.groupBy(F.col(conv_col).alias("conv_id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")))).alias("turns")
    )
    move = lambda state, turn: F.coalesce(F.element_at(_moves(t), F.concat(state, F.lit(">"), turn["role"])), F.lit("bad"))

    def step(acc: Column, turn: Column) -> Column:
        to = move(acc["state"], turn)
        return F.struct(to.alias("state"), (acc["good"] + F.when(to == "bad", 0).otherwise(1)).alias("good"))

    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("good"))
    ended = turns.withColumn("walk", F.aggregate("turns", start, step))

    def pieces(turn: Column) -> Column:
        role = turn["role"]
        before = _by_role(role, t, 0, F.concat(F.lit(t.other[0]), _role_name(role), F.lit(t.other[1])))
        after = _by_role(role, t, 1, F.lit(t.other[2]))
        loss = _by_role(role, t, 2, F.lit(False))
        piece = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
        return F.array(piece(before, F.lit(False)), piece(escape(turn["text"], t), loss), piece(after, F.lit(False)))

    valid = F.col("walk.state").isin(*t.accepts)
    return ended.select(
        "conv_id", F.flatten(F.transform("turns", pieces)).alias("segments"), valid.alias("valid"),
        F.when(~valid, F.when(F.col("walk.state") == "bad", F.col("walk.good")).otherwise(F.size("turns") - 1)).alias("first_bad_turn"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>, unescaped."""
    t = template or ChatTemplate()
    ends = "|".join(_quote(m[1]) for m in t.marks.values()) + "|" + _quote(t.other[2])
    starts = "|".join(_quote(m[0]) for m in t.marks.values()) + "|" + _quote(t.other[0]) + r"[^|]*" + _quote(t.other[1])
    turn = rf"(?s)\G({starts})(.*?)({ends})"
    heads, bodies = F.regexp_extract_all(formatted, F.lit(turn), F.lit(1)), F.regexp_extract_all(formatted, F.lit(turn), F.lit(2))

    def back(head: Column, body: Column) -> Column:
        named = F.substring(head, len(t.other[0]) + 1, F.length(head) - len(t.other[0]) - len(t.other[1]))
        role = _name_back(named)
        for name, marks in t.marks.items():
            role = F.when(head == marks[0], F.lit(name)).otherwise(role)
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.zip_with(heads, bodies, back)
