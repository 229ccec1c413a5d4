"""Symmetric 3 x 3 tensors in columns: displacement tensors under operations, closed-form eigenvalues, axes of view."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from .crystals import basis

PLACES = [(1, 1), (2, 2), (3, 3), (1, 2), (1, 3), (2, 3)]
NAMES = [f"c{i}{j}" for i, j in PLACES]
#: Fixed value: second to first spread at and above which a view has no plane of its own.
DEGENERATE = 0.85
#: A third moment below this share of the absolute one says nothing about a sign.
EVEN = 1e-9


def _at(c: dict[str, Column], i: int, j: int) -> Column:
    return c[f"c{min(i, j)}{max(i, j)}"]


def eigenvalues(c: dict[str, Column]) -> list[Column]:
    """The three eigenvalues of the symmetric tensor c11..c23, smallest first, by the angle form of the cubic's roots."""
    q = (c["c11"] + c["c22"] + c["c33"]) / 3
    off = c["c12"] ** 2 + c["c13"] ** 2 + c["c23"] ** 2
    p = F.sqrt(((c["c11"] - q) ** 2 + (c["c22"] - q) ** 2 + (c["c33"] - q) ** 2 + 2 * off) / 6)
    a, b, d = c["c11"] - q, c["c22"] - q, c["c33"] - q
    det = a * (b * d - c["c23"] ** 2) - c["c12"] * (c["c12"] * d - c["c23"] * c["c13"]) + c["c13"] * (c["c12"] * c["c23"] - b * c["c13"])
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(det, 2 * p * p * p), F.lit(1.0))))
    angle = F.acos(r) / 3
    high, low = q + 2 * p * F.cos(angle), q + 2 * p * F.cos(angle + 2 * math.pi / 3)
    return [low, 3 * q - high - low, high]


def displaced_images(atoms: DataFrame, ops: DataFrame, cells: DataFrame, share: float = 0.5) -> DataFrame:
    """atoms under every operation: op, cartesian c11..c23, e1..e3 (smallest first), u_eq and semi axes a1..a3.

    atoms: structure and u11..u23 of the file, with ops and cells as in crystals.py. An image's tensor is B U B', B
    taking the file's axes, turned by the operation, to cartesian ones in one step. Semi axes, of the ellipsoid that
    holds a share of the density, are null where the tensor isn't one (an eigenvalue not above 1e-9).
    """
    rows = atoms.join(ops, "structure").join(basis(cells), "structure")
    m = {(1, 1): F.col("m11"), (1, 2): F.col("m12"), (1, 3): F.col("m13"), (2, 2): F.col("m22"), (2, 3): F.col("m23"), (3, 3): F.col("m33")}
    rows = rows.withColumns({f"__b{i}{j}": sum(m[i, k] * F.col(f"r{k}{j}") for k in range(i, 4)) / F.col(f"h{j}") for i in (1, 2, 3) for j in (1, 2, 3)})
    u = lambda p, q: F.col(f"u{min(p, q)}{max(p, q)}")
    rows = rows.withColumns({f"c{i}{j}": sum(F.col(f"__b{i}{p}") * F.col(f"__b{j}{q}") * u(p, q) for p in (1, 2, 3) for q in (1, 2, 3)) for i, j in PLACES})
    rows = rows.withColumns(dict(zip(("e1", "e2", "e3"), eigenvalues({n: F.col(n) for n in NAMES}))))
    scale = dist.chi2_ppf(share, 3) ** 0.5
    axes = {f"a{k}": F.when(F.col("e1") > 1e-9, scale * F.sqrt(f"e{k}")) for k in (1, 2, 3)}
    return rows.withColumns(axes | {"u_eq": (F.col("c11") + F.col("c22") + F.col("c33")) / 3}).select(*atoms.columns, "op", *NAMES, "e1", "e2", "e3", "u_eq", "a1", "a2", "a3")


def _eigenvector(rows: DataFrame, names: list[str], value: str, out: str) -> DataFrame:
    """rows with a unit vector out1..out3 of a tensor's eigenvalue: the longest product of two rows of tensor less value; null where all vanish."""
    c = {n: F.col(m) for n, m in zip(NAMES, names)}
    row = [[_at(c, i, j) - (F.col(value) if i == j else 0) for j in (1, 2, 3)] for i in (1, 2, 3)]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    products = [F.struct(*[v.alias(n) for n, v in zip("xyz", cross(row[i], row[j]))]) for i, j in ((0, 1), (0, 2), (1, 2))]
    size = lambda p: F.sqrt(p["x"] ** 2 + p["y"] ** 2 + p["z"] ** 2)
    ranked = F.transform(F.array(*products), lambda p: F.struct(size(p).alias("n"), p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z")))
    rows = rows.withColumn("__p", F.array_max(ranked))
    scale = sum(F.abs(c[n]) for n in NAMES)
    return rows.withColumns({f"{out}{k}": F.when(F.col("__p.n") > 1e-14 * scale * scale, F.col(f"__p.{a}") / F.col("__p.n")) for k, a in zip((1, 2, 3), "xyz")}).drop("__p")


def _across(a: str) -> list[Column]:
    """A unit vector at right angles to one in columns: its product with the axis of the input that is least along it."""
    v = [F.col(f"{a}{k}") for k in (1, 2, 3)]
    first = (F.abs(v[0]) <= F.abs(v[1])) & (F.abs(v[0]) <= F.abs(v[2]))
    second = F.abs(v[1]) <= F.abs(v[2])
    pick = lambda x, y, z: F.when(first, x).when(second, y).when(v[0].isNotNull(), z)
    made = [pick(F.lit(0.0), -v[2], v[1]), pick(v[2], F.lit(0.0), -v[0]), pick(-v[1], v[0], F.lit(0.0))]
    size = F.sqrt(made[0] ** 2 + made[1] ** 2 + made[2] ** 2)
    return [m / size for m in made]


def view_axes(atoms: DataFrame, sight: DataFrame | None = None, key: str = "structure") -> DataFrame:
    """A row per structure: key, mx, my, mz (the centre), axes x1..x3, y1..y3, z1..z3, spreads w1 >= w2 >= w3, code, severity.

    atoms: key and cartesian x, y, z. z is the line of sight: the direction of least spread, or that of `sight` (key,
    s1, s2, s3). x is the direction of most spread across it, and y makes them right-handed, so nothing is mirrored.
    The sign of x, and of z unless it is given, is that which makes the third moment along it positive: then turning a
    structure turns its axes with it and leaves the coordinates seen along them as they are. Where that moment
    vanishes the largest weight is positive. code is degenerate (WARN) where the second spread is 0.85 of the first or
    more and sight isn't given, single where fewer than two places differ (axes are those of the input), else unique. Atoms on a line, or as far
    spread one way as another, leave directions open: those are set by the axes of the input.
    """
    mean = atoms.groupBy(key).agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"], *[(F.covar_pop(a, b) * F.count("*")).alias(n) for n, (a, b) in zip(NAMES, (("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z")))])
    rows = mean.withColumns(dict(zip(("w3", "w2", "w1"), eigenvalues({n: F.col(n) for n in NAMES}))))
    if sight is None:
        rows = _eigenvector(rows, NAMES, "w3", "z")
        rows = _eigenvector(rows, NAMES, "w1", "x")
    else:
        size = F.sqrt(F.col("s1") ** 2 + F.col("s2") ** 2 + F.col("s3") ** 2)
        rows = rows.join(sight, key, "left").withColumns({f"z{k}": F.when(size > 0, F.col(f"s{k}") / size) for k in (1, 2, 3)}).drop("s1", "s2", "s3")
        c = {n: F.col(n) for n in NAMES}
        along = {i: sum(_at(c, i, k) * F.col(f"z{k}") for k in (1, 2, 3)) for i in (1, 2, 3)}
        whole = sum(along[i] * F.col(f"z{i}") for i in (1, 2, 3))
        flat = {f"f{i}{j}": _at(c, i, j) - F.col(f"z{i}") * along[j] - along[i] * F.col(f"z{j}") + F.col(f"z{i}") * F.col(f"z{j}") * whole for i, j in PLACES}
        rows = rows.withColumns(flat)
        rows = rows.withColumn("__top", eigenvalues({n: F.col(f"f{n[1:]}") for n in NAMES})[2])
        rows = _eigenvector(rows, [f"f{n[1:]}" for n in NAMES], "__top", "x").drop("__top", *flat)
    # a direction that the spreads leave open is taken across the other, or from the input
    for a, other in (("z", "x"), ("x", "z")):
        rows = rows.withColumns({f"{a}{k}": F.coalesce(f"{a}{k}", v) for k, v in zip((1, 2, 3), _across(other))})
    rows = rows.withColumn("single", F.col("w1") <= 0).withColumns({f"{a}{k}": F.coalesce(f"{a}{k}", F.lit(float(k == p))) for p, a in ((1, "x"), (3, "z")) for k in (1, 2, 3)})
    # x at right angles to z to the last digit
    dot = sum(F.col(f"x{k}") * F.col(f"z{k}") for k in (1, 2, 3))
    rows = rows.withColumns({f"x{k}": F.col(f"x{k}") - dot * F.col(f"z{k}") for k in (1, 2, 3)})
    size = F.sqrt(F.col("x1") ** 2 + F.col("x2") ** 2 + F.col("x3") ** 2)
    rows = rows.withColumns({f"x{k}": F.col(f"x{k}") / size for k in (1, 2, 3)})
    at = lambda a: sum((F.col(c) - F.col(f"m{c}")) * F.col(f"{a}{k}") for k, c in zip((1, 2, 3), "xyz"))
    seen = atoms.select(key, *"xyz").join(rows, key)
    third = seen.groupBy(key).agg(*[f(at(a) ** 3).alias(f"__{n}{a}") for a in "xz" for f, n in ((F.sum, "t"), (lambda v: F.sum(F.abs(v)), "s"))])
    largest = lambda a: F.element_at(F.array_sort(F.array(*[F.struct((-F.round(F.abs(F.col(f"{a}{k}")), 9)).alias("n"), F.lit(k).alias("k"), F.col(f"{a}{k}").alias("v")) for k in (1, 2, 3)])), 1)["v"]
    sign = lambda a: F.when(F.abs(F.col(f"__t{a}")) > EVEN * F.col(f"__s{a}"), F.signum(f"__t{a}")).otherwise(F.when(largest(a) < 0, -1.0).otherwise(1.0))
    rows = rows.join(third, key).withColumns({"__gx": sign("x"), "__gz": sign("z") if sight is None else F.lit(1.0)})
    rows = rows.withColumns({f"{a}{k}": F.col(f"{a}{k}") * F.col(f"__g{a}") for a in "xz" for k in (1, 2, 3)})
    x, z = ([F.col(f"{a}{k}") for k in (1, 2, 3)] for a in "xz")
    rows = rows.withColumns({"y1": z[1] * x[2] - z[2] * x[1], "y2": z[2] * x[0] - z[0] * x[2], "y3": z[0] * x[1] - z[1] * x[0]})
    alike = (F.lit(sight is None)) & (F.col("w2") >= DEGENERATE * F.col("w1"))
    code = F.when(F.col("single"), "single").when(alike, "degenerate").otherwise("unique")
    rows = rows.withColumn("code", code).withColumn("severity", F.when(F.col("code") == "degenerate", "WARN").otherwise("INFO"))
    return rows.select(key, "mx", "my", "mz", *[f"{a}{k}" for a in "xyz" for k in (1, 2, 3)], "w1", "w2", "w3", "code", "severity")


def rolled(axes: DataFrame, vectors: DataFrame, key: str = "structure") -> DataFrame:
    """axes turned about the line of sight until the mean of vectors (key, v1, v2, v3), seen across it, lies along x.

    Where they cancel, or there are none, x stays: their mean must be over 0.3 of the larger sum of its parts. rolled says which.
    """
    at = lambda a: sum(F.col(f"v{k}") * F.col(f"{a}{k}") for k in (1, 2, 3))
    sums = vectors.join(axes, key).groupBy(key).agg(F.sum(at("x")).alias("__x"), F.sum(at("y")).alias("__y"), F.greatest(F.sum(F.abs(at("x"))), F.sum(F.abs(at("y")))).alias("__all"))
    size = F.sqrt(F.col("__x") ** 2 + F.col("__y") ** 2)
    rows = axes.join(sums, key, "left").withColumn("rolled", F.coalesce(size > 0.3 * F.col("__all"), F.lit(False)))
    c, s = (F.when(F.col("rolled"), F.col(v) / size).otherwise(o) for v, o in (("__x", 1.0), ("__y", 0.0)))
    turned = {f"x{k}": c * F.col(f"x{k}") + s * F.col(f"y{k}") for k in (1, 2, 3)} | {f"y{k}": c * F.col(f"y{k}") - s * F.col(f"x{k}") for k in (1, 2, 3)}
    return rows.withColumns(turned).drop("__x", "__y", "__all")


def tilted(axes: DataFrame, elevation: float = 0.0, azimuth: float = 0.0, roll: float = 0.0) -> DataFrame:
    """axes nudged in the frame of view by degrees: first about y (azimuth), then x (elevation), then z (roll)."""
    (ce, se), (ca, sa), (cr, sr) = ((math.cos(math.radians(v)), math.sin(math.radians(v))) for v in (elevation, azimuth, roll))
    about_y = [[ca, 0.0, sa], [0.0, 1.0, 0.0], [-sa, 0.0, ca]]
    about_x = [[1.0, 0.0, 0.0], [0.0, ce, -se], [0.0, se, ce]]
    about_z = [[cr, -sr, 0.0], [sr, cr, 0.0], [0.0, 0.0, 1.0]]
    times = lambda a, b: [[sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)] for i in range(3)]
    m = times(about_z, times(about_x, about_y))
    return axes.withColumns({f"{a}{k}": sum(m[i][j] * F.col(f"{b}{k}") for j, b in enumerate("xyz")) for i, a in enumerate("xyz") for k in (1, 2, 3)})


def seen(atoms: DataFrame, axes: DataFrame, key: str = "structure") -> DataFrame:
    """atoms with u, v, w: their places from the centre along x (right), y (up) and z (towards the eye)."""
    rows = atoms.join(axes, key)
    at = lambda a: sum((F.col(c) - F.col(f"m{c}")) * F.col(f"{a}{k}") for k, c in zip((1, 2, 3), "xyz"))
    return rows.select(*[atoms[c] for c in atoms.columns], at("x").alias("u"), at("y").alias("v"), at("z").alias("w"))
