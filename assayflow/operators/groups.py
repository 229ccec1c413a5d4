"""Space groups from operations: Hall symbols, closure, and a form of an operation set that doesn't depend on order or origin.

Structures with the same set of operations are told once: sets are made distinct first, and a set has 192 operations
at most, so what runs in Python is small however many structures there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROTATION = [f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]
SHIFT = ["t1", "t2", "t3"]
#: Translations are whole 24ths.
PARTS = 24
MOST_OPS = 192

# Hermann-Mauguin and Hall symbols of settings.
HALL = {
    "P 1": "P 1", "P -1": "-P 1", "P 2": "P 2y", "P 21": "P 2yb", "C 2": "C 2y", "P m": "P -2y", "P c": "P -2yc", "P n": "P -2yac", "C m": "C -2y", "C c": "C -2yc",
    "P 2/m": "-P 2y", "P 21/m": "-P 2yb", "C 2/m": "-C 2y", "P 2/c": "-P 2yc", "P 2/n": "-P 2yac", "P 21/c": "-P 2ybc", "P 21/n": "-P 2yn", "P 21/a": "-P 2yab", "C 2/c": "-C 2yc", "I 2/a": "-I 2ya",
    "P 2 2 2": "P 2 2", "P 2 2 21": "P 2c 2", "P 21 21 2": "P 2 2ab", "P 21 21 21": "P 2ac 2ab", "C 2 2 21": "C 2c 2", "C 2 2 2": "C 2 2", "F 2 2 2": "F 2 2", "I 2 2 2": "I 2 2", "I 21 21 21": "I 2b 2c",
    "P m m 2": "P 2 -2", "P m c 21": "P 2c -2", "P c c 2": "P 2 -2c", "P m a 2": "P 2 -2a", "P c a 21": "P 2c -2ac", "P n c 2": "P 2 -2bc", "P m n 21": "P 2ac -2", "P b a 2": "P 2 -2ab", "P n a 21": "P 2c -2n", "P n n 2": "P 2 -2n",
    "C m m 2": "C 2 -2", "C m c 21": "C 2c -2", "C c c 2": "C 2 -2c", "F m m 2": "F 2 -2", "F d d 2": "F 2 -2d", "I m m 2": "I 2 -2", "I b a 2": "I 2 -2c",
    "P m m m": "-P 2 2", "P m m a": "-P 2a 2a", "P n n a": "-P 2a 2bc", "P m n a": "-P 2ac 2", "P c c a": "-P 2a 2ac", "P b a m": "-P 2 2ab", "P c c n": "-P 2ab 2ac", "P b c m": "-P 2c 2b", "P n n m": "-P 2 2n", "P b c n": "-P 2n 2ab",
    "P b c a": "-P 2ac 2ab", "P n m a": "-P 2ac 2n", "C m c m": "-C 2c 2", "C m m m": "-C 2 2", "F m m m": "-F 2 2", "F d d d": "-F 2uv 2vw", "I m m m": "-I 2 2", "I b a m": "-I 2 2c", "I b c a": "-I 2b 2c",
    "P 4": "P 4", "P 41": "P 4w", "P 42": "P 4c", "P 43": "P 4cw", "I 4": "I 4", "I 41": "I 4bw", "P -4": "P -4", "I -4": "I -4", "P 4/m": "-P 4", "P 42/m": "-P 4c", "P 4/n": "-P 4a", "P 42/n": "-P 4bc", "I 4/m": "-I 4", "I 41/a": "-I 4ad",
    "P 41 21 2": "P 4abw 2nw", "P 43 21 2": "P 4nw 2abw", "P -4 21 m": "P -4 2ab", "P -4 21 c": "P -4 2n", "I -4 2 d": "I -4 2bw", "P 4/m m m": "-P 4 2", "P 42/m n m": "-P 4n 2n", "I 4/m m m": "-I 4 2",
    "P 3": "P 3", "P 31": "P 31", "P 32": "P 32", "R 3": "R 3", "P -3": "-P 3", "R -3": "-R 3", "P 31 2 1": 'P 31 2"', "P 32 2 1": 'P 32 2"', "R 3 2": 'R 3 2"', "R 3 m": 'R 3 -2"', "R 3 c": 'R 3 -2"c', "P -3 m 1": '-P 3 2"', "R -3 m": '-R 3 2"', "R -3 c": '-R 3 2"c',
    "P 6": "P 6", "P 61": "P 61", "P 65": "P 65", "P 63": "P 6c", "P 6/m": "-P 6", "P 63/m": "-P 6c", "P 61 2 2": "P 61 2 (0 0 -1)", "P 63 m c": "P 6c -2c", "P 6/m m m": "-P 6 2", "P 63/m m c": "-P 6c 2c",
    "P 2 3": "P 2 2 3", "F 2 3": "F 2 2 3", "I 2 3": "I 2 2 3", "P 21 3": "P 2ac 2ab 3", "I 21 3": "I 2b 2c 3", "P m -3": "-P 2 2 3", "F m -3": "-F 2 2 3", "P a -3": "-P 2ac 2ab 3", "I a -3": "-I 2b 2c 3", "P 41 3 2": "P 4bd 2ab 3",
    "P -4 3 m": "P -4 2 3", "F -4 3 m": "F -4 2 3", "I -4 3 m": "I -4 2 3", "P m -3 m": "-P 4 2 3", "F m -3 m": "-F 4 2 3", "I m -3 m": "-I 4 2 3", "F d -3 m": "-F 4vw 2vw 3", "I a -3 d": "-I 4bd 2c 3",
}
# The translations that Hall symbols name, in 24ths; those of centred lattices; turns about z, and about the diagonals beside it.
_STEPS = {"a": (12, 0, 0), "b": (0, 12, 0), "c": (0, 0, 12), "n": (12, 12, 12), "u": (6, 0, 0), "v": (0, 6, 0), "w": (0, 0, 6), "d": (6, 6, 6)}
_CENTRING = {"P": [], "A": [(0, 12, 12)], "B": [(12, 0, 12)], "C": [(12, 12, 0)], "I": [(12, 12, 12)], "R": [(16, 8, 8), (8, 16, 16)], "F": [(0, 12, 12), (12, 0, 12), (12, 12, 0)]}
_TURNS = {"1": (1, 0, 0, 0, 1, 0, 0, 0, 1), "2": (-1, 0, 0, 0, -1, 0, 0, 0, 1), "3": (0, -1, 0, 1, -1, 0, 0, 0, 1), "4": (0, -1, 0, 1, 0, 0, 0, 0, 1), "6": (1, -1, 0, 1, 0, 0, 0, 0, 1)}
_BESIDE = {"'": (0, -1, 0, -1, 0, 0, 0, 0, -1), '"': (0, 1, 0, 1, 0, 0, 0, 0, -1)}
_SPACE_DIAGONAL = (0, 0, 1, 1, 0, 0, 0, 1, 0)

Operation = tuple[tuple[int, ...], tuple[int, ...]]


def _about(matrix: tuple[int, ...], axis: int) -> np.ndarray:
    """A turn given about z, about x (0), y (1) or z (2)."""
    return np.roll(np.array(matrix).reshape(3, 3), axis - 2, axis=(0, 1))


def _operation(rotation: np.ndarray, shift: np.ndarray) -> Operation:
    return tuple(int(v) for v in rotation.ravel()), tuple(int(v) % PARTS for v in shift)


def closed(generators: list[Operation]) -> set[Operation]:
    """All products of operations; more than 192 are an error."""
    found = {_operation(np.eye(3, dtype=int), np.zeros(3, int))}
    front = list(found)
    steps = [(np.array(r).reshape(3, 3), np.array(t)) for r, t in generators]
    while front:
        r, t = front.pop()
        r, t = np.array(r).reshape(3, 3), np.array(t)
        for q, s in steps:
            made = _operation(q @ r, q @ t + s)
            if made not in found:
                found.add(made)
                front.append(made)
                if len(found) > MOST_OPS:
                    raise ValueError("not the operations of a space group")
    return found


def hall_operations(symbol: str) -> list[Operation]:
    """The operations of a Hall symbol, the identity first; ValueError if it can't be read.

    Turns are about z, x or a - b, and a + b + c where the symbol leaves the axis out, by their place and the order of
    the turn before. Letters add translations, a digit a screw, and three twelfths in brackets shift the origin.
    """
    text, _, moved = symbol.strip().partition("(")
    words = text.split()
    head = re.fullmatch("(-?)([PABCIRF])", words[0] if words else "", re.I)
    if not head:
        raise ValueError(f"not a Hall symbol: {symbol}")
    none = np.zeros(3, int)
    made = [_operation(np.eye(3, dtype=int), np.array(t)) for t in _CENTRING[head[2].upper()]]
    if head[1]:
        made.append(_operation(-np.eye(3, dtype=int), none))
    axis, before = 2, ""
    for place, word in enumerate(words[1:]):
        m = re.fullmatch("(-?)([12346])([xyz'\"*]*)([1-5]?)([abcnuvwd]*)", word)
        if not m:
            raise ValueError(f"not a Hall symbol: {symbol}")
        order, mark = m[2], m[3]
        if not mark and place == 1 and order == "2":
            mark = "x" if before in ("2", "4") else "'"
        elif not mark and place == 2 and order == "3":
            mark = "*"
        if mark[-1:] in _BESIDE:
            turn = _about(_BESIDE[mark[-1]], "xyz".index(mark[0]) if mark[0] in "xyz" else axis)
        elif mark == "*":
            turn = np.array(_SPACE_DIAGONAL).reshape(3, 3)
        else:
            axis = "xyz".index(mark) if mark else 2
            turn = _about(_TURNS[order], axis)
        shift = sum((np.array(_STEPS[c]) for c in m[5]), none)
        if m[4]:
            shift = shift + np.eye(3, dtype=int)[axis] * (PARTS * int(m[4]) // int(order))
        made.append(_operation(-turn if m[1] else turn, shift))
        before = order
    origin = 2 * np.array([int(v) for v in moved.rstrip(") ").split()] or [0, 0, 0])
    made = [_operation(r := np.array(o[0]).reshape(3, 3), np.array(o[1]) + origin - r @ origin) for o in made]
    ops = closed(made)
    first = _operation(np.eye(3, dtype=int), none)
    return [first, *sorted(ops - {first}, reverse=True)]


def _primitive(lattice: list[tuple[int, ...]]) -> np.ndarray:
    """A basis, by columns, of the lattice that whole cells and these translations (24ths) span: its echelon form."""
    rows = [list(v) for v in lattice] + (PARTS * np.eye(3, dtype=int)).tolist()
    out = []
    for k in range(3):
        rows = _eliminated(rows, k)
        out.append(rows[0])
        rows = [r for r in rows[1:] if any(r)]
    for k in (1, 2):
        for j in range(k):
            f = out[j][k] // out[k][k]
            out[j] = [a - f * b for a, b in zip(out[j], out[k])]
    return np.array(out).T / PARTS


def _eliminated(rows: list[list], k: int) -> list[list]:
    """Rows with column k zero in all but the first, by adding whole multiples of rows to others."""
    rows = [list(r) for r in rows]
    while True:
        some = [i for i, r in enumerate(rows) if r[k]]
        if not some:
            return rows
        low = min(some, key=lambda i: abs(rows[i][k]))
        rows[0], rows[low] = rows[low], rows[0]
        if rows[0][k] < 0:
            rows[0] = [-v for v in rows[0]]
        if len(some) == 1:
            return rows
        for i in range(1, len(rows)):
            f = rows[i][k] // rows[0][k]
            if f:
                rows[i] = [a - f * b for a, b in zip(rows[i], rows[0])]


def signature(rotations: np.ndarray, shifts: np.ndarray) -> str:
    """The same text for operation sets that differ in order and origin alone, another for any others; '' for no group.

    An origin at s adds (1 - R) s to each translation. Row operations in whole numbers bring the stacked 1 - R to
    echelon form: the translations' rows that meet its zeros are what no origin changes, but for whole numbers, and
    all that is so; the others can be shifted to zero. In a centred cell that holds in a primitive basis.
    """
    shifts = np.asarray(shifts, float)
    same = [t for r, t in zip(rotations, shifts) if (r == np.eye(3)).all()]
    lattice = [tuple(np.rint(PARTS * (t % 1)).astype(int) % PARTS) for t in same]
    basis = _primitive(lattice)
    back = np.linalg.inv(basis)
    seen = {}
    for r, t in zip(rotations, shifts):
        seen.setdefault(tuple(np.rint(back @ r @ basis).astype(int).ravel()), back @ t)
    if len(seen) * len(set(lattice)) != len(rotations):
        return ""
    turns = sorted(seen)
    matrix = np.concatenate([np.eye(3, dtype=int) - np.array(r).reshape(3, 3) for r in turns])
    rows = [[*map(int, m), float(t)] for m, t in zip(matrix, np.concatenate([seen[r] for r in turns]))]
    for k in range(3):
        rows = _eliminated(rows, k)
        if rows[0][k]:
            rows = rows[1:]
    rest = [int(np.rint(PARTS * r[3])) % PARTS for r in rows]
    return f"{'/'.join(map(str, np.rint(PARTS * basis).astype(int).ravel()))}|{';'.join(','.join(map(str, r)) for r in turns)}|{','.join(map(str, rest))}"


@lru_cache(maxsize=1)
def _listed() -> tuple[tuple[str, str, int], ...]:
    """Signature, name and order of the settings of HALL."""
    out = []
    for name, symbol in HALL.items():
        ops = hall_operations(symbol)
        out.append((signature(np.array([np.array(r).reshape(3, 3) for r, _ in ops]), np.array([t for _, t in ops]) / PARTS), name, len(ops)))
    return tuple(out)


def short_name(name: Column) -> Column:
    """A name without blanks, case or the ones of a monoclinic full symbol: 'P 1 21/c 1' is 'p21/c'."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(name, "_", ""), r"\s+", " "))
    return F.lower(F.replace(F.regexp_replace(plain, r"^([A-Za-z]) 1 (\S+) 1$", "$1 $2"), F.lit(" "), F.lit("")))


def listed(spark: SparkSession) -> DataFrame:
    """name, short, hall, signature, order of the settings that this library knows; as many rows as HALL has."""
    rows = spark.createDataFrame([(name, HALL[name], key, n) for key, name, n in _listed()], "name string, hall string, signature string, order int")
    return rows.withColumn("short", short_name(F.col("name")))


def _is_closed(rotations: np.ndarray, shifts: np.ndarray) -> bool:
    """Whether every product is among the operations, translations told apart by half a 24th of a cell."""
    if len(rotations) > MOST_OPS:
        return False
    place: dict[tuple, list[int]] = {}
    for k, r in enumerate(rotations):
        place.setdefault(tuple(r.ravel()), []).append(k)
    for r, t in zip(rotations, shifts):
        want = rotations @ t + shifts  # every other operation after this one
        for q, w in zip(rotations @ r, want):
            among = shifts[place.get(tuple(q.ravel()), [])]
            if not len(among) or np.abs((among - w + 0.5) % 1 - 0.5).max(axis=1).min() > 0.5 / PARTS:
                return False
    return True


def _told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text in pdf["set"]:
            ops = [list(map(float, o.split(","))) for o in text.split(";")]
            rotations, shifts = np.array([np.rint(o[:9]).astype(int).reshape(3, 3) for o in ops]), np.array([o[9:] for o in ops])
            whole = _is_closed(rotations, shifts)
            rows.append((text, signature(rotations, shifts) if whole else "", whole))
        yield pd.DataFrame(rows, columns=["set", "signature", "closed"])


def named(ops: DataFrame, key: str = "structure") -> DataFrame:
    """A row per structure: key, n_ops, closed (whether products of its operations are among them), name.

    ops: key, r11..r33, t1..t3. Repeated operations and whole-cell translations count once. name is that of the setting
    whose operations are the same up to order and origin; null if none listed in HALL is, or the set isn't closed.
    """
    turn = [F.col(c).cast("int").cast("string") for c in ROTATION]
    shift = [F.format_string("%.5f", F.pmod(F.round(F.pmod(c, F.lit(1.0)), 5), F.lit(1.0))) for c in SHIFT]
    sets = ops.groupBy(key).agg(F.array_sort(F.collect_set(F.concat_ws(",", *turn, *shift))).alias("set"))
    sets = sets.select(key, F.size("set").alias("n_ops"), F.array_join("set", ";").alias("set"))
    told = sets.select("set").distinct().mapInPandas(_told, "set string, signature string, closed boolean")
    told = told.join(F.broadcast(listed(ops.sparkSession).select("signature", "name")), "signature", "left").drop("signature")
    return sets.join(told, "set").select(key, "n_ops", "closed", "name")


def check(structures: DataFrame, ops: DataFrame, declared: str = "declared", key: str = "structure") -> DataFrame:
    """structures with n_ops, name (from their operations), order (of the declared name), code and severity.

    code: not_listed (the declared name isn't known), incomplete (as many operations as the named group doesn't have;
    WARN), other_name (the operations are those of another setting), consistent.
    """
    known = F.broadcast(listed(ops.sparkSession).select("short", "order"))
    rows = structures.join(named(ops, key), key, "left").withColumn("short", short_name(F.col(declared))).join(known, "short", "left")
    code = (
        F.when(F.col("order").isNull(), "not_listed").when(F.coalesce("n_ops", F.lit(0)) != F.col("order"), "incomplete")
        .when(F.col("name").isNotNull() & (short_name(F.col("name")) != F.col("short")), "other_name").otherwise("consistent")
    )
    return rows.withColumn("code", code).drop("short", "closed").withColumn("severity", F.when(F.col("code") == "incomplete", "WARN").otherwise("INFO"))
