"""Mixtures: non-negative unmixing from sums alone, phase verdicts, and pairing rules for ingredients."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .pattern import residual_peaks
from .stats import weighted_residual

#: Fixed values of the pKa rule and of the complementarity rule (short axis, middle axis, dipole).
SALT_ABOVE, COCRYSTAL_BELOW = 3.0, 0.0
MOST_SHORT, MOST_MIDDLE, MOST_DIPOLE = 0.20, 0.20, 4.0


def unmix_two(df: DataFrame, by: list[str], product: str, a: str, b: str) -> DataFrame:
    """Non-negative weights of two parents per group: part_a, part_b (shares), scale_a, scale_b.

    The best of the four active sets follows from five sums, so a group of any size is one aggregation.
    """
    y, u, v = (F.col(c).cast("double") for c in (product, a, b))
    s = df.groupBy(*by).agg(F.sum(u * u).alias("aa"), F.sum(v * v).alias("bb"), F.sum(u * v).alias("ab"), F.sum(u * y).alias("ay"), F.sum(v * y).alias("by_"), F.sum(y * y).alias("yy"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    free_a, free_b = ratio(F.col("ay") * F.col("bb") - F.col("by_") * F.col("ab"), det), ratio(F.col("by_") * F.col("aa") - F.col("ay") * F.col("ab"), det)
    only_a, only_b = F.greatest(F.lit(0.0), ratio(F.col("ay"), F.col("aa"))), F.greatest(F.lit(0.0), ratio(F.col("by_"), F.col("bb")))
    gain_a, gain_b = only_a * F.col("ay"), only_b * F.col("by_")
    both = (free_a >= 0) & (free_b >= 0)
    wa = F.when(both, free_a).when(gain_a >= gain_b, only_a).otherwise(0.0)
    wb = F.when(both, free_b).when(gain_a >= gain_b, 0.0).otherwise(only_b)
    out = s.select(*by, wa.alias("scale_a"), wb.alias("scale_b"))
    total = F.col("scale_a") + F.col("scale_b")
    return out.withColumn("part_a", ratio(F.col("scale_a"), total)).withColumn("part_b", ratio(F.col("scale_b"), total))


def nnls(gram: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Non-negative least squares on normal equations (x'x, x'y) by active sets."""
    k = len(target)
    w, free = np.zeros(k), np.zeros(k, bool)
    for _ in range(30 * k):
        grad = target - gram @ w
        grad[free] = -np.inf
        if free.all() or grad.max() <= 1e-12 * max(1.0, np.abs(target).max()):
            break
        free[grad.argmax()] = True
        while True:
            trial = np.zeros(k)
            trial[free] = np.linalg.lstsq(gram[np.ix_(free, free)], target[free], rcond=None)[0]
            if (trial[free] > 0).all():
                w = trial
                break
            bad = free & (trial <= 0)
            step = (w[bad] / (w[bad] - trial[bad])).min()
            w = w + step * (trial - w)
            free &= w > 1e-14
            w[~free] = 0
    return w


def unmix(df: DataFrame, product: str, parents: list[str]) -> dict[str, float]:
    """Shares of any number of parents: one aggregation gives the normal equations, whose size is that of parents."""
    v = {c: F.col(c).cast("double") for c in [product, *parents]}
    pairs = [(p, q) for i, p in enumerate(parents) for q in parents[i:]]
    row = df.agg(*[F.sum(v[p] * v[q]) for p, q in pairs], *[F.sum(v[p] * v[product]) for p in parents]).first()
    k = len(parents)
    g = np.zeros((k, k))
    for (p, q), value in zip(pairs, row):
        i, j = parents.index(p), parents.index(q)
        g[i, j] = g[j, i] = value or 0.0
    w = nnls(g, np.array([x or 0.0 for x in row[len(pairs) :]]))
    return {p: float(x / w.sum()) if w.sum() > 0 else float("nan") for p, x in zip(parents, w)}


def phase_report(df: DataFrame, by: list[str], product: str, a: str, b: str, x: str = "x", weight: str = "auto", share: float = 0.05) -> DataFrame:
    """unmix_two with rwp, the residual's new and lost peaks (x, height, highest first) and a verdict.

    The verdict is whether the parents leave a new peak, one of at least `share` of the largest |product|, unexplained;
    rwp is reported beside it and decides nothing.
    """
    parts = unmix_two(df, by, product, a, b)
    rows = df.join(parts, by).withColumn("explained", F.col("scale_a") * F.col(a) + F.col("scale_b") * F.col(b))
    fit = weighted_residual(rows, by, product, "explained", weight).select(*by, "weight", "rwp")
    peaks = residual_peaks(rows.withColumn("__who", F.struct(*by)), "__who", product, "explained", x, share)
    some = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("height", F.col(x).alias("x")))), asc=False).alias(f"{kind}_peaks")
    found = peaks.groupBy("__who").agg(some("new"), some("lost")).select("__who.*", "new_peaks", "lost_peaks")
    out = parts.join(fit, by).join(found, by, "left")
    out = out.withColumns({c: F.coalesce(c, F.array().cast(found.schema[c].dataType)) for c in ("new_peaks", "lost_peaks")})
    return out.withColumn("verdict", F.when(F.size("new_peaks") > 0, "new_signal").otherwise("sum_of_parents"))


def ionisation(pka_acid: Column, pka_base: Column) -> tuple[Column, Column]:
    """The pKa gap, base less acid, and its zone: salt above 3, cocrystal below 0, continuum between, ends included."""
    gap = pka_base - pka_acid
    return gap, F.when(gap > SALT_ABOVE, "salt").when(gap < COCRYSTAL_BELOW, "cocrystal").when(gap.isNotNull(), "continuum")


def complementary(left: str, right: str) -> Column:
    """Whether two molecules' shapes (short and middle ratio) and dipoles are alike enough to pack together."""
    off = lambda c: F.abs(F.col(f"{left}.{c}") - F.col(f"{right}.{c}"))
    return (off("short") <= MOST_SHORT) & (off("middle") <= MOST_MIDDLE) & (off("dipole") <= MOST_DIPOLE)


def complementary_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Complementary rows l, r (structs) of two tables (short, middle, dipole, any others).

    Different shapes are paired on buckets of all three values, and then the rows of each shape of a pair, so that rows
    of one shape are compared once and a bucket holds only what is near in every value.
    """
    most = {"short": MOST_SHORT, "middle": MOST_MIDDLE, "dipole": MOST_DIPOLE}
    number = {c: F.col(c).cast("double") for c in most}
    place = lambda v, c: F.floor(v / (2 * most[c])).cast("long")
    shapes = lambda df: df.select(*[v.alias(c) for c, v in number.items()]).dropna().distinct()
    a, b = shapes(left).select(F.struct("*").alias("ls")), shapes(right).select(F.struct("*").alias("rs"))
    for c, reach in most.items():
        v, reach = F.col(f"rs.{c}"), reach * 1.000001
        a = a.withColumn(f"__{c}", place(F.col(f"ls.{c}"), c))
        b = b.withColumn(f"__{c}", F.explode(F.sequence(place(v - reach, c), place(v + reach, c))))
    near = a.join(b, [f"__{c}" for c in most]).filter(complementary("ls", "rs")).select("ls", "rs")
    rows = lambda df, name, shape: df.select(F.struct("*").alias(name), F.struct(*[v.alias(c) for c, v in number.items()]).alias(shape))
    return rows(left, "l", "ls").join(near, "ls").join(rows(right, "r", "rs"), "rs").select("l", "r")


def conformer_summary(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Median and population deviation of each value over a molecule's conformers, and their number."""
    cells = [x for v in values for x in (F.percentile(F.col(v).cast("double"), 0.5).alias(f"{v}_median"), F.stddev_pop(F.col(v).cast("double")).alias(f"{v}_sd"))]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *cells)


def predictors(pairs: DataFrame, pairings: DataFrame) -> DataFrame:
    """Three separate signals for pairs of molecules, and no verdict on them: zone, complementary, hetero_favoured.

    pairs has pair, pka_acid, pka_base and structs l and r (short, middle, dipole); pairings is best_pairing() by pair.
    A signal whose inputs are missing is null.
    """
    gap, zone = ionisation(F.col("pka_acid"), F.col("pka_base"))
    rows = pairs.withColumn("pka_gap", gap).withColumn("zone", zone).withColumn("complementary", complementary("l", "r"))
    return rows.join(pairings, "pair", "left").select("pair", "pka_gap", "zone", "complementary", "score", "donor", "acceptor", "hetero_favoured")


def best_pairing(donors: DataFrame, acceptors: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A row (per `by`): the best donor and acceptor by summed score (ties by labels), and whether it joins two molecules.

    donors and acceptors (molecule, label, score) are two molecules' functional groups. The best sums over pairs come
    from each side's best group per molecule, so the lists are never multiplied out.
    """
    by = by or []
    top = lambda df, name: df.groupBy(*by, "molecule").agg(F.max(F.struct("score", "label")).alias(name)).withColumnRenamed("molecule", f"{name}_of")
    d, a = top(donors, "donor"), top(acceptors, "acceptor")
    pairs = (d.join(a, by) if by else d.crossJoin(F.broadcast(a))).withColumn("sum", F.col("donor.score") + F.col("acceptor.score"))  # a row per molecule each
    hetero = F.col("donor_of") != F.col("acceptor_of")
    best = F.max(F.struct("sum", "donor.label", F.col("acceptor.label").alias("acceptor_label")))
    out = pairs.groupBy(*by).agg(best.alias("best"), F.max(F.when(hetero, F.col("sum"))).alias("hetero"), F.max(F.when(~hetero, F.col("sum"))).alias("homo"))
    favoured = (F.col("hetero") > 0) & (F.col("hetero") >= F.coalesce("homo", F.lit(float("-inf"))))
    return out.select(*by, F.col("best.sum").alias("score"), F.col("best.label").alias("donor"), F.col("best.acceptor_label").alias("acceptor"), F.coalesce(favoured, F.lit(False)).alias("hetero_favoured"))
