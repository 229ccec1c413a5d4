"""Column expressions on values, arrays and text. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is zero or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def transmittance(absorbance: Column) -> Column:
    return 100 * F.pow(F.lit(10.0), -absorbance)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda u, v: u * v))


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def spread(a: Column) -> Column:
    """Population standard deviation of an array."""
    return F.sqrt(total(F.transform(a, lambda v: (v - mean(a)) * (v - mean(a)))) / F.size(a))


def snv(a: Column) -> Column:
    """Each array centred and scaled by its own mean and population deviation; a constant array is only centred."""
    stat = F.struct(mean(a).alias("m"), spread(a).alias("s"))
    return F.get(F.transform(F.array(stat), lambda q: F.transform(a, lambda v: (v - q["m"]) / F.when(q["s"] == 0, 1.0).otherwise(q["s"]))), F.lit(0))


def convolve(a: Column, weights: list[float], left: list[list[float]], right: list[list[float]]) -> Column:
    """Weighted sums of a sliding frame; left and right hold whole-frame weights for the first and last places."""
    w, half = len(weights), len(weights) // 2
    n = F.size(a)
    inner = lambda i: sum((F.get(a, i + (k - half)) * float(c) for k, c in enumerate(weights) if c), F.lit(0.0))
    edge = lambda first, coefs: sum((F.get(a, first + k) * float(c) for k, c in enumerate(coefs) if c), F.lit(0.0))

    def at(_: Column, i: Column) -> Column:
        out = F.when((i >= half) & (i < n - half), inner(i))
        for k, coefs in enumerate(left):
            out = out.when(i == k, edge(F.lit(0), coefs))
        for k, coefs in enumerate(right):
            out = out.when(i == n - half + k, edge(n - w, coefs))
        return out

    return F.transform(a, at)


def cif_number(text: Column) -> Column:
    """A number with its uncertainty in brackets cut off: 11.429(4) is 11.429."""
    return F.trim(F.split(text, r"\(")[0]).try_cast("double")


def cif_field(text: Column, key: str) -> Column:
    """The value after a CIF tag: a block between semicolon lines, quoted, or bare; ? and . are empty."""
    tag = "(?is)(?:^|\\n)\\s*" + key.replace(".", "[.]")
    forms = [tag + r"[ \t]*\n;(.*?)\n;", tag + r"[ \t]+'([^\n]*?)'[ \t]*(?:\n|$)", tag + r'[ \t]+"([^\n]*?)"[ \t]*(?:\n|$)', tag + r"[ \t]+([^\s'\"]\S*)"]
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, f, 1), F.lit("")) for f in forms], F.lit(""))
    flat = F.trim(F.regexp_replace(found, r"\s+", " "))
    return F.when(flat.isin("?", "."), "").otherwise(flat)
