"""Ordered traces in long form (trace, x, y): gates, spikes, normalisation, band areas and anchors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, ratio
from ..functions.savgol import filter_array, smoothed

#: Fixed values of the spike rule: ring offsets, noise factor, share of the range, noise multiple, neighbour share.
RING = (-4, -3, -2, 2, 3, 4)
SPIKE_RANGE, SPIKE_NOISE, SPIKE_SHARE = 0.1, 8.0, 0.25
GAP, MAX_HALF_WIDTH, ANCHOR_HALF = 12.0, 60.0, 2.0


def _ordered(key: str, *order: str) -> Window:
    return Window.partitionBy(key).orderBy(*order)


def gate(df: DataFrame, key: str = "trace", x: str = "x", y: str = "y", order: str | None = None, min_points: int = 8) -> DataFrame:
    """A row per trace: n, all_finite, monotonic (strictly, in stored order), severity and code of the first failure."""
    step = F.col(x) - F.lag(x).over(_ordered(key, order or x))
    rows = df.withColumn("__dx", step).withColumn("__ok", finite(F.col(x)) & finite(F.col(y).cast("double")))
    out = rows.groupBy(key).agg(
        F.count("*").alias("n"), F.every("__ok").alias("all_finite"),
        (F.coalesce(F.every(F.col("__dx") > 0), F.lit(True)) | F.coalesce(F.every(F.col("__dx") < 0), F.lit(True))).alias("monotonic"),
    )
    code = F.when(F.col("n") < min_points, "too_few_points").when(~F.col("all_finite"), "not_finite").when(~F.col("monotonic"), "not_monotonic").otherwise("ok")
    return out.withColumn("code", code).withColumn("severity", F.when(code == "ok", "INFO").otherwise("FAIL"))


def spikes(df: DataFrame, key: str = "trace", x: str = "x", y: str = "y") -> DataFrame:
    """Single samples that stand out of a nine-sample frame, up or down: key, x, y, base, direction.

    base is the median of the six samples two to four places away, noise 1.4826 x their median deviation. A spike is
    over a tenth of the trace's range and eight times the noise off base while neither neighbour goes a quarter as far.
    """
    w = _ordered(key, x)
    at = lambda k: (F.lag(y, -k) if k < 0 else F.lead(y, k)).over(w)
    rows = df.withColumn("__ring", F.array(*[F.lag(y, -k).over(w) if k < 0 else F.lead(y, k).over(w) for k in RING]))
    rows = rows.withColumns({"__before": F.lag(y, 1).over(w), "__after": at(1), "__range": F.max(y).over(Window.partitionBy(key)) - F.min(y).over(Window.partitionBy(key))})
    rows = rows.filter(~F.exists("__ring", lambda v: v.isNull()))
    middle = lambda a: (F.get(a, F.lit(2)) + F.get(a, F.lit(3))) / 2
    rows = rows.withColumn("base", middle(F.array_sort("__ring")))
    rows = rows.withColumn("__noise", 1.4826 * middle(F.array_sort(F.transform("__ring", lambda v: F.abs(v - F.col("base"))))) + 1e-12)
    up, noise, floor = F.col(y) - F.col("base"), F.col("__noise"), SPIKE_RANGE * F.col("__range")
    high, low = F.greatest("__before", "__after") - F.col("base"), F.least("__before", "__after") - F.col("base")
    is_up = (up > floor) & (up > SPIKE_NOISE * noise) & (high < SPIKE_SHARE * up)
    is_down = (-up > floor) & (-up > SPIKE_NOISE * noise) & (-low < SPIKE_SHARE * -up)
    return rows.withColumn("direction", F.when(is_up, "up").when(is_down, "down")).filter("direction is not null").select(key, x, y, "base", "direction")


def trapezoid(x: Column, y: Column, before_x: Column, before_y: Column) -> Column:
    return (x - before_x) * (y + before_y) / 2


def normalize(df: DataFrame, how: str, key: str = "trace", x: str = "x", y: str = "y", tie: str | None = None) -> DataFrame:
    """y divided by the trace's largest |y| (max) or by the area under |y| (area); zero leaves it unchanged."""
    if how not in ("max", "area"):
        raise ValueError(f"unknown normalisation {how!r}")
    every, w = Window.partitionBy(key), _ordered(key, x, *([tie] if tie else []))
    if how == "max":
        by = F.max(F.abs(y)).over(every)
    else:
        df = df.withColumn("__part", trapezoid(F.col(x), F.abs(y), F.lag(x).over(w), F.abs(F.lag(y).over(w))))
        by = F.abs(F.sum("__part").over(every))
    return df.withColumn("y_norm", F.coalesce(ratio(F.col(y), by), F.col(y))).drop("__part")


def anchor_values(df: DataFrame, places: DataFrame, key: str = "trace", x: str = "x", y: str = "y", half: float = ANCHOR_HALF) -> DataFrame:
    """Mean y within half of each place, else the nearest sample's y (the first on a tie): key, place, anchor.

    places (place) is a handful of positions, the same for each trace.
    """
    off = F.abs(F.col(x) - F.col("place"))
    pairs = df.select(key, x, y).crossJoin(F.broadcast(places.select("place").distinct()))
    return pairs.groupBy(key, "place").agg(F.coalesce(F.avg(F.when(off <= half, F.col(y))), F.min_by(y, F.struct(off, x))).alias("anchor"))


def band_areas(df: DataFrame, windows: list[tuple[float, float, str]], shared: bool = False, clip: bool = True, half: float = ANCHOR_HALF, key: str = "trace", x: str = "x", y: str = "y") -> DataFrame:
    """Area and height of each band above a straight baseline: key, band, n, area, height.

    The baseline runs between the anchor values at the band's ends, or, if shared, at the ends of the envelope of all
    bands. Corrected values are clipped at zero before integrating. Bands of fewer than two samples have null area.
    """
    spans = [(min(a, b), max(a, b), name) for a, b, name in windows]
    low, high = min(s[0] for s in spans), max(s[1] for s in spans)
    lines = [(a, b, name, *((low, high) if shared else (a, b))) for a, b, name in spans]
    bands = df.sparkSession.createDataFrame(lines, "lo double, hi double, band string, l double, r double")
    ends = df.sparkSession.createDataFrame([(float(v),) for v in sorted({e for s in lines for e in s[3:]})], "place double")
    anchors = anchor_values(df, ends, key, x, y, half)
    base = anchors.join(F.broadcast(bands), F.col("place").isin(F.col("l"), F.col("r")))
    base = base.groupBy(key, "band", "lo", "hi", "l", "r").agg(F.max(F.when(F.col("place") == F.col("l"), F.col("anchor"))).alias("yl"), F.max(F.when(F.col("place") == F.col("r"), F.col("anchor"))).alias("yr"))
    rows = df.select(key, x, y).join(base, key).filter(F.col(x).between(F.col("lo"), F.col("hi")))
    line = F.col("yl") + (F.col("yr") - F.col("yl")) * F.coalesce(ratio(F.col(x) - F.col("l"), F.col("r") - F.col("l")), F.lit(0.0))
    above = F.col(y) - line
    rows = rows.withColumn("__c", F.greatest(above, F.lit(0.0)) if clip else above)
    w = Window.partitionBy(key, "band").orderBy(x, y)
    rows = rows.withColumn("__part", trapezoid(F.col(x), F.col("__c"), F.lag(x).over(w), F.lag("__c").over(w)))
    found = rows.groupBy(key, "band").agg(F.count("*").alias("n"), F.sum("__part").alias("area"), F.max("__c").alias("height"))
    every = base.select(key, "band").join(found, [key, "band"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return every.withColumn("area", F.when(F.col("n") >= 2, F.col("area")))


def find_anchors(df: DataFrame, center: float, gap: float = GAP, most: float = MAX_HALF_WIDTH, key: str = "trace", x: str = "x", y: str = "y") -> DataFrame:
    """Where y is least on each side of a band, between gap and most away from its centre: key, left, right.

    Search a smoothed reference once and use its anchors for the whole batch. A side without samples is null.
    """
    side = lambda lo, hi: F.min_by(F.when(F.col(x).between(lo, hi), F.col(x)), F.when(F.col(x).between(lo, hi), F.struct(y, x)))
    return df.groupBy(key).agg(side(center - most, center - gap).alias("left"), side(center + gap, center + most).alias("right"))


def gradient(df: DataFrame, key: str = "trace", x: str = "x", y: str = "y", delta: float = 1.0) -> DataFrame:
    """df with slope: central differences of y over 2 delta by order of x, one-sided over delta at the ends."""
    w = _ordered(key, x)
    before, after = F.lag(y).over(w), F.lead(y).over(w)
    inner = (after - before) / (2 * delta)
    return df.withColumn("slope", F.when(before.isNotNull() & after.isNotNull(), inner).when(after.isNotNull(), (after - F.col(y)) / delta).otherwise((F.col(y) - before) / delta))


def locked_anchors(reference: np.ndarray, grid: np.ndarray, center: float, gap: float = GAP, most: float = MAX_HALF_WIDTH, smooth: tuple[int, int] = (13, 3)) -> tuple[float, float]:
    """Where a smoothed reference spectrum (on the ascending grid) is least on each side of a band, as find_anchors().

    Found once, on the driver, and then used for the whole batch. A side without samples is an error.
    """
    ys = smoothed(reference, *smooth)
    ends = []
    for low, high in ((center - most, center - gap), (center + gap, center + most)):
        inside = (grid >= low) & (grid <= high)
        if not inside.any():
            raise ValueError(f"no samples between {low} and {high}")
        ends.append(float(grid[inside][np.argmin(ys[inside])]))
    return ends[0], ends[1]


def auto_windows(reference: np.ndarray, grid: np.ndarray, centers: list[tuple[float, str]], **options) -> list[tuple[float, float, str]]:
    """Integration windows (low, high, name) between the locked anchors of each (center, name)."""
    return [(*locked_anchors(reference, grid, center, **options), name) for center, name in centers]


def band_metrics(grid: np.ndarray, anchors: tuple[float, float], center: float, half: float = ANCHOR_HALF, window: float = 8.0, smooth: tuple[int, int] = (13, 3), spectrum: str = "spectrum") -> dict[str, Column]:
    """area, height and deriv2 of one band of spectra on an ascending grid, as expressions on the array column.

    area and height are above the straight line between the anchor values (means within half, else the nearest
    sample), clipped at zero. deriv2 is the deepest trough of the smoothed second derivative within window of the
    centre, which no constant or sloping background changes. Null where a window has too few samples.
    """
    low, high = sorted(anchors)
    a = F.col(spectrum)
    at = lambda i: F.get(a, F.lit(int(i)))

    def anchor(place: float) -> Column:
        near = np.flatnonzero(np.abs(grid - place) <= half)
        near = near if len(near) else np.array([np.abs(grid - place).argmin()])
        return sum((at(i) for i in near), F.lit(0.0)) / len(near)

    inside = np.flatnonzero((grid >= low) & (grid <= high))
    left, right = anchor(low), anchor(high)
    above = [F.greatest(at(i) - (left + (right - left) * float((grid[i] - low) / (high - low or 1.0))), F.lit(0.0)) for i in inside]
    area = sum((float(grid[j] - grid[i]) * (u + v) / 2 for i, j, u, v in zip(inside, inside[1:], above, above[1:])), F.lit(0.0))
    few = len(inside) < 2
    step = float(np.diff(grid).mean())
    near = np.flatnonzero(np.abs(grid - center) <= window)
    second = filter_array(a, *smooth, 2, len(grid))
    trough = F.array_max(F.transform(F.slice(second, int(near[0]) + 1, len(near)), lambda v: -v)) / (step * step) if len(near) else None
    none = F.lit(None).cast("double")
    return {"area": none if few else area, "height": none if few else F.array_max(F.array(*above)), "deriv2": none if trough is None else trough}


def same_processing(records: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row: whether all records agree on keys with the first, and how many don't."""
    first = F.min_by(F.struct(*keys), order)
    return records.agg(first.alias("__first"), F.count_distinct(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})).alias("n_settings"), F.count("*").alias("n")).select("n", "n_settings", F.when(F.col("n_settings") > 1, "FAIL").otherwise("INFO").alias("severity"))


def offset_stack(df: DataFrame, key: str = "trace", y: str = "y", factor: float = 1.15) -> DataFrame:
    """y shifted by the trace's rank times factor times the largest range, for waterfall tables."""
    spans = df.groupBy(key).agg((F.max(y) - F.min(y)).alias("__ptp"))
    rank = F.dense_rank().over(Window.orderBy(key)) - 1  # over one row per trace
    steps = spans.withColumn("shift", rank * factor * F.max("__ptp").over(Window.partitionBy(F.lit(0))))
    return df.join(steps.select(key, "shift"), key).withColumn("y_stacked", F.col(y) + F.col("shift"))
