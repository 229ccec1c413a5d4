"""Calculated powder lines: structure amplitudes of a cell's atoms at each reflection, and lines of one angle merged."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# X-ray form factors of neutral atoms as four Gaussians and a constant (a1 b1 a2 b2 a3 b3 a4 b4 c), as in
# the International Tables for Crystallography; at zero angle the a and c add up to the atomic number.
FORM_FACTORS = {
    "H": (0.489918, 20.6593, 0.262003, 7.74039, 0.196767, 49.5519, 0.049879, 2.20159, 0.001305),
    "C": (2.3100, 20.8439, 1.0200, 10.2075, 1.5886, 0.5687, 0.8650, 51.6512, 0.2156),
    "N": (12.2126, 0.0057, 3.1322, 9.8933, 2.0125, 28.9975, 1.1663, 0.5826, -11.529),
    "O": (3.0485, 13.2771, 2.2868, 5.7011, 1.5463, 0.3239, 0.8670, 32.9089, 0.2508),
    "F": (3.5392, 10.2825, 2.6412, 4.2944, 1.5170, 0.2615, 1.0243, 26.1476, 0.2776),
    "Na": (4.7626, 3.2850, 3.1736, 8.8422, 1.2674, 0.3136, 1.1128, 129.424, 0.6760),
    "P": (6.4345, 1.9067, 4.1791, 27.1570, 1.7800, 0.5260, 1.4908, 68.1645, 1.1149),
    "S": (6.9053, 1.4679, 5.2034, 22.2151, 1.4379, 0.2536, 1.5863, 56.1720, 0.8669),
    "Cl": (11.4604, 0.0104, 7.1964, 1.1662, 6.2556, 18.5194, 1.6455, 47.7784, -9.5574),
}


def with_amplitudes(lines: DataFrame, atoms: DataFrame) -> DataFrame:
    """lines (h, k, l, d, two_theta) with amplitude |F| and intensity |F|^2 times the Lorentz and polarisation factor.

    atoms are those of one whole cell (sym, x, y, z, occ, and u_iso if there is one; null counts as 0), of any number:
    the lines, bounded by cell and angles, go to every task with each element's form factor at their angle, and a task
    sums its atoms for each line. An element without form factors is an error; a cell without atoms has amplitudes of zero.
    """
    s2 = 1 / (4 * F.col("d") * F.col("d"))
    factors = [sum(f[i] * F.exp(-f[i + 1] * s2) for i in (0, 2, 4, 6)) + f[8] for f in FORM_FACTORS.values()]
    key = ["h", "k", "l", "d"]
    angles = lines.select(*key, s2.alias("__s2"), F.array(*factors).alias("__factors")).dropDuplicates(key)
    places = F.create_map(*[x for i, sym in enumerate(FORM_FACTORS) for x in (F.lit(sym), F.lit(i))])
    known = F.coalesce(F.try_element_at(places, F.col("sym")), F.raise_error(F.concat(F.lit("no form factors for element "), F.coalesce("sym", F.lit("null")))))
    u = [F.coalesce(F.col("u_iso").cast("double"), F.lit(0.0)).alias("__u")] if "u_iso" in atoms.columns else []
    sites = atoms.select(known.alias("__element"), "x", "y", "z", F.coalesce(F.col("occ").cast("double"), F.lit(1.0)).alias("__occ"), *u)
    weight = F.col("__occ") * F.get("__factors", F.col("__element"))
    weight = weight * F.exp(-8 * math.pi**2 * F.col("__u") * F.col("__s2")) if u else weight
    phase = 2 * math.pi * (F.col("h") * F.col("x") + F.col("k") * F.col("y") + F.col("l") * F.col("z"))
    sums = sites.crossJoin(F.broadcast(angles)).groupBy(*key).agg(F.sum(weight * F.cos(phase)).alias("__re"), F.sum(weight * F.sin(phase)).alias("__im"))
    half = F.radians("two_theta") / 2
    lorentz = (1 + F.pow(F.cos(2 * half), F.lit(2))) / (F.sin(half) * F.sin(half) * F.cos(half))
    size = F.sqrt(F.col("__re") * F.col("__re") + F.col("__im") * F.col("__im"))
    out = lines.join(F.broadcast(sums), key, "left").withColumn("amplitude", F.coalesce(size, F.lit(0.0)))  # a row per line
    return out.withColumn("intensity", F.col("amplitude") * F.col("amplitude") * lorentz).select(*lines.columns, "amplitude", "intensity")


def powder_lines(lines: DataFrame, digits: int = 4) -> DataFrame:
    """two_theta, intensity (strongest 100), reflections: lines that share an angle to `digits` decimals added up."""
    merged = lines.groupBy(F.round("two_theta", digits).alias("two_theta")).agg(F.sum("intensity").alias("intensity"), F.count("*").alias("reflections"))
    most = F.max("intensity").over(Window.partitionBy())  # one row per angle: some thousands at most
    return merged.withColumn("intensity", F.coalesce(100 * F.col("intensity") / F.nullif(most, F.lit(0.0)), F.lit(0.0)))
