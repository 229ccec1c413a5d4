"""Traces of any length: peaks, knots and hulls slice by slice, with what crosses a border carried over.

A trace's samples are ranked over slices of values (ranks.py), so their places are known without one task that sorts
the trace. Per-trace windows then run over slices alone: a few rows for some thousands of samples.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .ranks import ranked, sliced

#: Samples of a slice.
SLICE = 4096


def placed(df: DataFrame, key: str, x: str = "x", ties: str | None = None, name: str = "pos") -> DataFrame:
    """df with the 0-based place of each sample in its trace; samples without an x have none and are left out."""
    return ranked(df.filter(F.col(x).isNotNull()), x, [key], name, ties)


def maxima(df: DataFrame, key: str, x: str = "x", y: str = "y", height: float = 0.0, pos: str = "pos", width: int = SLICE) -> DataFrame:
    """Samples above both neighbours and at least height: key, pos, x, y. Of a flat top the middle place (rounded down).

    df has each sample's place (placed()). Runs of equal values are found in slices; those at the ends of slices are
    joined where they meet an equal one. Ends of a trace are no maxima; a null y is below everything.
    """
    rows = df.select(key, pos, x, F.coalesce(F.col(y).cast("double"), F.lit(float("-inf"))).alias("v")).withColumn("__slice", F.floor(F.col(pos) / width))
    inside = Window.partitionBy(key, "__slice").orderBy(pos)
    rows = rows.withColumn("__run", F.sum(F.coalesce(F.col("v") != F.lag("v").over(inside), F.lit(True)).cast("int")).over(inside))
    runs = rows.groupBy(key, "__slice", "__run").agg(F.first("v").alias("v"), F.min(pos).alias("lo"), F.max(pos).alias("hi"))
    among = Window.partitionBy(key, "__slice").orderBy("__run")
    runs = runs.withColumns({"before": F.lag("v").over(among), "after": F.lead("v").over(among)})
    ends = F.col("before").isNull() | F.col("after").isNull()
    # first and last runs of slices, two rows a slice at most
    along = Window.partitionBy(key).orderBy("lo")
    border = runs.filter(ends).withColumns({"__b": F.coalesce("before", F.lag("v").over(along)), "__a": F.coalesce("after", F.lead("v").over(along)), "__new": F.coalesce(F.col("v") != F.lag("v").over(along), F.lit(True)) | F.col("before").isNotNull()})
    border = border.withColumn("__g", F.sum(F.col("__new").cast("int")).over(along))
    joined = border.groupBy(key, "__g").agg(F.first("v").alias("v"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min_by("__b", "lo").alias("before"), F.max_by("__a", "hi").alias("after"))
    every = runs.filter(~ends).select(key, "v", "lo", "hi", "before", "after").unionByName(joined.drop("__g"))
    top = every.filter((F.col("v") > F.col("before")) & (F.col("v") > F.col("after")) & (F.col("v") >= height)).select(key, F.floor((F.col("lo") + F.col("hi")) / 2).alias(pos), F.col("v").alias(y))
    return top.join(df.select(key, pos, x), [key, pos]).select(key, pos, x, y)


def _decide(distance: int):
    """Greedy thinning of one slice with its neighbours' peaks: what it can be sure of."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__pos")
        pos, own, state = pdf["__pos"].to_numpy(), pdf["__own"].to_numpy(), pdf["state"].to_numpy().copy()
        order = np.lexsort((pos, pdf["__y"].to_numpy()))[::-1]
        low, high = np.searchsorted(pos, pos - distance, "right"), np.searchsorted(pos, pos + distance, "left")
        rank = np.empty(len(pos), np.int64)
        rank[order] = np.arange(len(pos))
        for i in order:
            near = slice(low[i], high[i])
            if state[i] or not own[i]:
                continue
            if (state[near] == 1).any():
                state[i] = -1
            elif not ((state[near] == 0) & (rank[near] < rank[i])).any():
                state[i] = 1
        return pdf.assign(state=state)[own]

    return run


def thinned(peaks: DataFrame, distance: int, key: str, y: str = "y", pos: str = "pos", width: int = SLICE) -> DataFrame:
    """Peaks left when the highest first remove those fewer than distance samples away; of equal ones the later first.

    Each round a slice, which sees its neighbours' peaks within distance of the border, keeps a peak that none higher
    within distance could still remove, and removes what a kept one is near. Slices settle what doesn't hang on their
    neighbours at once, so rounds are as many as slices that a chain of ever higher near peaks crosses.
    """
    wide = max(width, int(distance))
    columns = peaks.columns
    cells = {"__pos": F.col(pos), "__y": F.col(y).cast("double"), "state": F.lit(0)}
    left = materialize(peaks.withColumns(cells), "peaks")
    settled = None
    while True:
        around = left if settled is None else left.unionByName(settled)
        at = F.floor(F.col("__pos") / wide)
        reach = F.array_distinct(F.array(at, F.floor((F.col("__pos") - distance) / wide), F.floor((F.col("__pos") + distance) / wide)))
        dealt = around.withColumn("__home", at).withColumn("__slice", F.explode(reach)).withColumn("__own", F.col("__slice") == F.col("__home")).drop("__home")
        schema = dealt.schema
        done = dealt.groupBy(key, "__slice").applyInPandas(_decide(int(distance)), schema).drop("__slice", "__own")
        done = materialize(done, "peaks")
        settled, left = done.filter("state = 1"), done.filter("state = 0")  # kept ones are seen again, so that they remove what is near
        if left.isEmpty():
            return settled.select(*columns)


def around(points: DataFrame, knots: DataFrame, at: str, place: str, value: str | None = None, by: list[str] | None = None) -> DataFrame:
    """points with the nearest knots on either side: before_x, after_x and, with a value, before_y, after_y; null where there is none.

    A knot at a point's place is on both sides. Knots at one place count once, with the mean of their values; those
    without a place or value don't count. Both sides lie in one table cut into slices; the last knot of each slice is
    carried to those that follow, the first to those before, by a window over slices.
    """
    keys = by or []
    number = lambda c: F.col(c).cast("double")
    k = knots.filter(F.col(place).isNotNull() & (F.col(value).isNotNull() if value else F.lit(True))).groupBy(*keys, number(place).alias("__x")).agg((F.avg(number(value)) if value else F.lit(0.0)).alias("__y"))
    row = points.select(*keys, number(at).alias("__x"), F.lit(None).cast("double").alias("__y"), F.struct(*points.columns).alias("__row"))
    both = row.unionByName(k.withColumn("__row", F.lit(None).cast(row.schema["__row"].dataType)))
    both = sliced(both, "__x", "__slice")
    knot = F.when(F.col("__row").isNull(), F.struct(F.col("__x").alias("x"), F.col("__y").alias("y")))
    # both sides look back, one over falling places: a window up to its end costs the square of a slice
    to = lambda w: w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside, along = Window.partitionBy(*keys, "__slice"), Window.partitionBy(*(keys or [F.lit(0)]))  # along: a row for each slice
    ends = both.groupBy(*keys, "__slice").agg(F.max(knot).alias("last"), F.min(knot).alias("first"))
    over = lambda order: along.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumns({"__prior": F.last("last", True).over(over(F.asc("__slice"))), "__next": F.last("first", True).over(over(F.desc("__slice")))}).drop("last", "first")
    both = both.withColumns({"__before": F.last(knot, True).over(to(inside.orderBy(F.asc("__x")))), "__after": F.last(knot, True).over(to(inside.orderBy(F.desc("__x"))))})
    known = both.filter("__row IS NOT NULL").join(carried, [*keys, "__slice"], "left")
    b, a = F.coalesce("__before", "__prior"), F.coalesce("__after", "__next")
    out = [b["x"].alias("before_x"), a["x"].alias("after_x")] + ([b["y"].alias("before_y"), a["y"].alias("after_y")] if value else [])
    names = ("before_x", "after_x", "before_y", "after_y")
    return known.select("__row.*", *[F.when(F.col(f"__row.{at}").isNotNull(), c).alias(n) for c, n in zip(out, names)])


def interpolated(points: DataFrame, knots: DataFrame, at: str, place: str, value: str, by: list[str] | None = None, name: str = "value_at") -> DataFrame:
    """points with the piecewise linear value of the knots there; before the first and after the last knot theirs; null without knots."""
    found = around(points, knots, at, place, value, by)
    x, part = F.col(at).cast("double"), F.col("after_x") - F.col("before_x")
    line = F.when(part > 0, F.col("before_y") + (F.col("after_y") - F.col("before_y")) * (x - F.col("before_x")) / part).otherwise(F.coalesce("before_y", "after_y"))
    return found.withColumn(name, F.coalesce(line, "before_y", "after_y")).drop("before_x", "after_x", "before_y", "after_y")


def gaps(points: DataFrame, places: DataFrame, at: str, place: str, by: list[str] | None = None, name: str = "gap") -> DataFrame:
    """points with the distance to the nearest place; null where there is none."""
    found = around(points, places, at, place, by=by)
    x = F.col(at).cast("double")
    return found.withColumn(name, F.least(x - F.col("before_x"), F.col("after_x") - x)).drop("before_x", "after_x")


def _corners(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of points (by x, each its own) that may be corners of the lower hull.

    What lies on or above the line between its neighbours is none; passes go on while they take off a tenth.
    """
    at = np.arange(len(x))
    while len(at) > 2:
        u, v = x[at], y[at]
        stays = np.r_[True, ~((u[1:-1] - u[:-2]) * (v[2:] - v[:-2]) <= (v[1:-1] - v[:-2]) * (u[2:] - u[:-2])), True]
        at, before = at[stays], len(at)
        if 10 * (before - len(at)) < before:
            break
    return at


def _hull(pdf: pd.DataFrame) -> pd.DataFrame:
    """The lower hull of points by x; of equal x the lowest."""
    order = np.lexsort((pdf["__y"].to_numpy(), pdf["__x"].to_numpy()))
    x = pdf["__x"].to_numpy()[order]
    order = order[np.r_[True, x[1:] != x[:-1]][: len(x)]]
    order = order[_corners(pdf["__x"].to_numpy()[order], pdf["__y"].to_numpy()[order])]
    x, y = pdf["__x"].to_numpy()[order].tolist(), pdf["__y"].to_numpy()[order].tolist()
    kept: list[int] = []
    for i in range(len(x)):
        while len(kept) > 1:
            a, b = kept[-2], kept[-1]
            if (x[b] - x[a]) * (y[i] - y[a]) <= (y[b] - y[a]) * (x[i] - x[a]):
                kept.pop()
            else:
                break
        kept.append(i)
    return pdf.iloc[order[kept]]


def lower_hull(df: DataFrame, key: str, x: str = "x", y: str = "y", together: int = 16) -> DataFrame:
    """key, x, y of each trace's lower hull. Hulls of slices are merged, some neighbours at a time, up to the whole.

    What meets in a task are hull points of neighbouring slices. A trace that is convex throughout is its own hull.
    """
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    cut = sliced(rows, "__x", "__slice")
    last = cut.agg(F.max("__slice")).first()[0] or 0
    while True:
        cut = cut.groupBy(key, "__slice").applyInPandas(_hull, cut.schema)
        if last == 0:
            return cut.select(key, F.col("__x").alias(x), F.col("__y").alias(y))
        last //= together
        cut = materialize(cut, "hulls").withColumn("__slice", F.floor(F.col("__slice") / together).cast("int"))


def running_minimum(df: DataFrame, key: str, x: str, y: str, ties: list[str], name: str) -> DataFrame:
    """df with the least y so far in each trace: in slices, then over what slices before had."""
    cut = sliced(df, x, "__slice")
    inside = Window.partitionBy(key, "__slice").orderBy(x, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = cut.withColumn("__low", F.min(y).over(inside))
    before = Window.partitionBy(key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
    ends = cut.groupBy(key, "__slice").agg(F.min(y).alias("__m")).withColumn("__prior", F.min("__m").over(before)).drop("__m")
    return cut.join(ends, [key, "__slice"]).withColumn(name, F.least("__low", "__prior")).drop("__slice", "__low", "__prior")


def rubber_band(df: DataFrame, key: str, x: str = "x", y: str = "y", ties: list[str] | None = None) -> DataFrame:
    """df with baseline, corrected and method (rubberband, or running minimum where there is no hull with an inside).

    A trace of fewer than three different points, or with all of them on one line, has the least value so far for its
    baseline. Samples without an x or y are left out.
    """
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    hull = materialize(lower_hull(rows, key, x, y), "hull")
    ends = hull.groupBy(key).agg(F.count("*").alias("__n"), F.min(F.struct(x, y)).alias("__a"), F.max(F.struct(x, y)).alias("__b"))
    run, rise = F.col(f"__b.{x}") - F.col(f"__a.{x}"), F.col(f"__b.{y}") - F.col(f"__a.{y}")
    off = F.abs((F.col(y) - F.col(f"__a.{y}")) * run - (F.col(x) - F.col(f"__a.{x}")) * rise)
    span = F.max(F.abs(F.col(y))) * F.max(F.abs(run))
    # a row for each trace, written: joins on it needn't deal out all samples by trace
    flat = materialize(rows.join(ends, key).groupBy(key).agg((F.max(off) <= 1e-12 * span).alias("__flat")), "flat")
    some = rows.join(flat, key)
    parts = []
    if flat.filter(~F.col("__flat")).count() or flat.isEmpty():
        knots = hull.select(key, F.col(x).alias("__hx"), F.col(y).alias("__hy"))
        parts.append(interpolated(some.filter(~F.col("__flat")).drop("__flat"), knots, x, "__hx", "__hy", [key], "baseline").withColumn("method", F.lit("rubberband")))
    if flat.filter("__flat").count():
        parts.append(running_minimum(some.filter("__flat").drop("__flat"), key, x, y, ties or [y], "baseline").withColumn("method", F.lit("running minimum")))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("corrected", F.col(y) - F.col("baseline"))
