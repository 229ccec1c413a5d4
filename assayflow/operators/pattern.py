"""Diffraction: reflections of a cell, line shapes, pattern simulation by range join, peaks and indexing."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .long_traces import gaps
from .spatial import range_join

#: Copper K alpha 1 and 2 wavelengths in angstrom, and half widths at which a line is cut.
CU_KA1, CU_KA2, CUT = 1.540598, 1.544426, 40.0
CAGLIOTI = (0.01, -0.005, 0.008)
LORENTZ, KA2_RATIO, INDEX_TOLERANCE, TOP = 0.5, 0.5, 0.10, 25


def reciprocal_metric(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> np.ndarray:
    ca, cb, cg = (math.cos(math.radians(v)) for v in (alpha, beta, gamma))
    return np.linalg.inv(np.array([[a * a, a * b * cg, a * c * cb], [a * b * cg, b * b, b * c * ca], [a * c * cb, b * c * ca, c * c]]))


def _form(metric: np.ndarray, u: list[Column], v: list[Column]) -> Column:
    return sum(float(metric[i, j]) * u[i] * v[j] for i in range(3) for j in range(3))


def reflections(spark: SparkSession, cell: tuple[float, ...], wavelength: float, low: float, high: float) -> DataFrame:
    """h, k, l, d, two_theta of every reflection in the window, a row each; 000 is left out."""
    g = reciprocal_metric(*cell)
    d_min = wavelength / (2 * math.sin(math.radians(high / 2)))
    out = spark.range(1)
    for name, length in zip("hkl", cell):
        most = int(length / d_min) + 1
        out = out.withColumn(name, F.explode(F.sequence(F.lit(-most), F.lit(most))))
    hkl = [F.col(c) for c in "hkl"]
    out = out.filter("h <> 0 or k <> 0 or l <> 0").withColumn("d", 1 / F.sqrt(_form(g, hkl, hkl)))
    out = out.filter(F.col("d") * 2 >= wavelength).withColumn("two_theta", 2 * F.degrees(F.asin(wavelength / (2 * F.col("d")))))
    return out.filter(F.col("two_theta").between(low, high)).select("h", "k", "l", "d", "two_theta")


def angle_between(metric: np.ndarray, u: list[Column], v: list[Column]) -> Column:
    """Angle between two reflections' normals in radians."""
    cosine = _form(metric, u, v) / F.sqrt(_form(metric, u, u) * _form(metric, v, v))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def march_dollase(angle: Column, r: float) -> Column:
    return F.pow(r * r * F.cos(angle) * F.cos(angle) + F.sin(angle) * F.sin(angle) / r, F.lit(-1.5))


def preferred(lines: DataFrame, metric: np.ndarray, axis: tuple[int, int, int], r: float) -> DataFrame:
    """Intensities scaled for plates (r < 1) or needles (r > 1) along axis; r of 1 changes nothing."""
    angle = angle_between(metric, [F.col(c) for c in "hkl"], [F.lit(v) for v in axis])
    return lines.withColumn("intensity", F.col("intensity") * march_dollase(angle, r))


def doublet(lines: DataFrame, ka1: float = CU_KA1, ka2: float = CU_KA2, share: float = KA2_RATIO) -> DataFrame:
    """Each line and its K alpha 2 partner (line 1 and 2) in one scan; a partner beyond 180 degrees is dropped."""
    sine = F.sin(F.radians(F.col("two_theta") / 2)) * (ka2 / ka1)
    second = F.struct(F.lit(2).alias("line"), F.when(sine < 1, 2 * F.degrees(F.asin(F.when(sine < 1, sine)))).alias("two_theta"), (F.col("intensity") * share).alias("intensity"))
    first = F.struct(F.lit(1).alias("line"), F.col("two_theta"), F.col("intensity"))
    keep = [c for c in lines.columns if c not in ("two_theta", "intensity")]
    return lines.select(*keep, F.explode(F.array(first, second)).alias("e")).select(*keep, "e.*").filter("two_theta is not null")


def caglioti(two_theta: Column, u: float = CAGLIOTI[0], v: float = CAGLIOTI[1], w: float = CAGLIOTI[2]) -> Column:
    t = F.tan(F.radians(two_theta / 2))
    return F.sqrt(F.greatest(u * t * t + v * t + w, F.lit(1e-6)))


def pseudo_voigt(x: Column, center: Column, fwhm: Column, eta: float = LORENTZ) -> Column:
    """A line of area one, eta of it Lorentzian."""
    lorentz = (2 / (math.pi * fwhm)) / (1 + 4 * (x - center) * (x - center) / (fwhm * fwhm))
    gauss = (2 / fwhm) * math.sqrt(math.log(2) / math.pi) * F.exp(-4 * math.log(2) * (x - center) * (x - center) / (fwhm * fwhm))
    return eta * lorentz + (1 - eta) * gauss


def simulate(lines: DataFrame, grid: DataFrame, eta: float = LORENTZ, cut: float = CUT) -> DataFrame:
    """x, y on the grid (x), scaled to a maximum of 100: each line adds within cut half widths; elsewhere y is 0."""
    shaped = lines.select("two_theta", "intensity").withColumn("fwhm", caglioti(F.col("two_theta")))
    reach = cut * F.col("fwhm")
    pairs = range_join(grid.select("x"), shaped, "x", F.col("two_theta") - reach, F.col("two_theta") + reach, 4.0)
    sums = pairs.groupBy("x").agg(F.sum(F.col("intensity") * pseudo_voigt(F.col("x"), F.col("two_theta"), F.col("fwhm"), eta)).alias("v"))
    top = sums.agg(F.max("v").alias("top"))
    out = grid.select("x").join(sums, "x", "left").crossJoin(F.broadcast(top))
    return out.select("x", F.coalesce(F.try_divide(100 * F.col("v"), F.col("top")), F.lit(0.0)).alias("y"))


def nearest(points: DataFrame, lines: DataFrame, at: str = "two_theta") -> DataFrame:
    """points with gap: the distance to the nearest line."""
    return gaps(points, lines.select(F.col("two_theta").alias("__line")), at, "__line")


def index_peaks(peaks: DataFrame, lines: DataFrame, tolerance: float = INDEX_TOLERANCE, top: int = TOP) -> DataFrame:
    """The strongest peaks with the simplest reflection near each: least |h|+|k|+|l|, then gap, then h, k, l; else '?'."""
    some = peaks.select(F.col("two_theta").alias("peak"), "height").orderBy(F.desc("height"), "peak").limit(top)
    pairs = range_join(some, lines.select("h", "k", "l", "two_theta"), "peak", F.col("two_theta") - tolerance, F.col("two_theta") + tolerance + 1e-9, 1.0, "left")
    order = F.struct((F.abs("h") + F.abs("k") + F.abs("l")).alias("size"), F.round(F.abs(F.col("two_theta") - F.col("peak")), 6).alias("gap"), "h", "k", "l")
    best = pairs.groupBy("peak", "height").agg(F.min(F.when(F.col("h").isNotNull(), order)).alias("b"))
    return best.select("peak", "height", F.when(F.col("b").isNull(), "?").otherwise(F.concat_ws(" ", "b.h", "b.k", "b.l")).alias("hkl"))


def local_maxima(df: DataFrame, key: str, x: str = "x", y: str = "y", height: float | Column = 0.0) -> DataFrame:
    """Samples above both neighbours and at least height: key, x, y. Of a flat top the middle place (rounded down)."""
    w = Window.partitionBy(key).orderBy(x)
    rows = df.select(key, x, y).withColumn("__k", F.row_number().over(w)).withColumn("__new", F.coalesce(F.col(y) != F.lag(y).over(w), F.lit(True)).cast("int"))
    rows = rows.withColumn("__run", F.sum("__new").over(w))
    runs = rows.groupBy(key, "__run").agg(F.first(y).alias("v"), F.array_sort(F.collect_list(x)).alias("xs"))
    r = Window.partitionBy(key).orderBy("__run")
    runs = runs.withColumn("before", F.lag("v").over(r)).withColumn("after", F.lead("v").over(r))
    top = runs.filter((F.col("v") > F.col("before")) & (F.col("v") > F.col("after")) & (F.col("v") >= (height if isinstance(height, Column) else F.lit(height))))
    return top.select(key, F.get("xs", F.floor((F.size("xs") - 1) / 2).cast("int")).alias(x), F.col("v").alias(y))


def residual_peaks(df: DataFrame, key: str, observed: str, explained: str, x: str = "x", share: float = 0.05) -> DataFrame:
    """New and lost peaks of a residual: local maxima of it and of its negative above a share of the largest |observed|."""
    top = df.groupBy(key).agg((share * F.max(F.abs(observed))).alias("least"))
    both = df.select(key, x, F.explode(F.array(F.struct(F.lit("new").alias("kind"), (F.col(observed) - F.col(explained)).alias("y")), F.struct(F.lit("lost").alias("kind"), (F.col(explained) - F.col(observed)).alias("y")))).alias("e"))
    named = both.select(F.struct(F.col(key).alias("k"), F.col("e.kind").alias("kind")).alias("who"), x, F.col("e.y").alias("y"))
    found = local_maxima(named, "who", x, "y").select(F.col("who.k").alias(key), "who.kind", x, F.col("y").alias("height"))
    return found.join(top, key).filter(F.col("height") >= F.col("least")).drop("least")
