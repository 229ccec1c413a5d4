"""Many crystal structures at once, with lattice images: neighbours, bonds, molecules and hydrogen bonds.

cells: structure, a, b, c, alpha, beta, gamma. ops: structure, op, r11..r33, t1..t3. atoms: structure, idx, label, sym,
x, y, z (fractions), occ, assembly, grp. Every join is keyed by structure and a bucket inside its cell, so a structure
with many atoms spreads over tasks. Only images that a reach over the cell's border asks for are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from . import graph
from .structure import ACCEPTORS, ANGLE, BOND_TOLERANCE, CONTACT_ANGLE, COVALENT, DISORDERED, DONORS, LONGEST_DA, NEUTRON, OTHER_VAN_DER_WAALS, OUTLYING, SHORTEST, VAN_DER_WAALS, distance_class, lookup

#: Operations of a structure at most, so that idx and op make one number.
MOST_OPS = 200
OFFSET = ("du", "dv", "dw")
_BASIS = ("m11", "m12", "m13", "m22", "m23", "m33", "h1", "h2", "h3")


def basis(cells: DataFrame) -> DataFrame:
    """structure, the cell vectors m11..m33 (the first along x, the second in the xy plane) and heights h1..h3."""
    ca, cb, cg = (F.cos(F.radians(c)) for c in ("alpha", "beta", "gamma"))
    sg = F.sin(F.radians("gamma"))
    n = (ca - cb * cg) / sg
    w = F.sqrt(F.greatest(F.lit(0.0), 1 - cb * cb - n * n))
    heights = [F.col("a") * sg * w / F.sin(F.radians("alpha")), F.col("b") * sg * w / F.sin(F.radians("beta")), F.col("c") * w]
    m = [F.col("a"), F.col("b") * cg, F.col("c") * cb, F.col("b") * sg, F.col("c") * n, F.col("c") * w]
    return cells.select("structure", *[v.cast("double").alias(k) for k, v in zip(_BASIS, [*m, *heights])])


def sites(atoms: DataFrame, ops: DataFrame, cells: DataFrame) -> DataFrame:
    """All images within the cell: atoms with site, op, x, y, z in [0, 1), the whole cells su, sv, sw added to get there, and the cell's basis.

    Of images of one element at one place to two decimals the first stays, by idx and operation. An atom whose
    structure has no cell or no operations has no sites.
    """
    images = atoms.join(ops, "structure")
    for i, (c, s) in enumerate(zip("xyz", ("su", "sv", "sw")), 1):
        v = F.col(f"r{i}1") * F.col("x") + F.col(f"r{i}2") * F.col("y") + F.col(f"r{i}3") * F.col("z") + F.col(f"t{i}")
        down = F.floor(v + 1e-9)
        images = images.withColumns({f"n{c}": F.round(v - down, 9), s: (-down).cast("int")})
    key = [F.pmod(F.round(100 * F.col(f"n{c}")).cast("int"), F.lit(100)).alias(f"k{c}") for c in "xyz"]
    kept = [c for c in atoms.columns if c not in "xyz"]
    images = images.select(*kept, "op", (F.col("idx") * MOST_OPS + F.col("op")).alias("site"), *[F.col(f"n{c}").alias(c) for c in "xyz"], "su", "sv", "sw", *key)
    # dealt out by all keys: else Spark keeps what a join by structure left, and a large structure stays in one task
    images = images.repartition("structure", "sym", "kx", "ky", "kz")
    first = F.row_number().over(Window.partitionBy("structure", "sym", "kx", "ky", "kz").orderBy("idx", "op"))
    return images.withColumn("__k", first).filter("__k = 1").drop("__k", "kx", "ky", "kz").join(basis(cells), "structure").repartition("structure", "site")


def _buckets(axis: int, radius: float) -> Column:
    """Buckets of a cell along an axis, each at least twice the radius high where the cell is."""
    return F.greatest(F.lit(1), F.floor(F.col(f"h{axis}") / (2 * radius)).cast("int"))


def periodic_pairs(left: DataFrame, right: DataFrame, radius: float, keep_left: list[str], keep_right: list[str]) -> DataFrame:
    """structure, l, r (structs of the columns asked for), du, dv, dw and d: right sites, moved by whole cells, near left ones.

    Each right site goes to the buckets that a box around its reach touches, eight on average in a large cell; a bucket
    beyond the border stands for an image. Cells lower than the radius reach over several of their own.
    """
    a = left.select("structure", F.struct(*keep_left).alias("l"), *[F.col(c).alias(f"l{c}") for c in "xyz"], *[F.col(m) for m in _BASIS[:6]], *[F.least(F.floor(F.col(c) * _buckets(k, radius)), _buckets(k, radius) - 1).cast("int").alias(f"b{k}") for k, c in enumerate("xyz", 1)])
    b = right.select("structure", F.struct(*keep_right).alias("r"), *"xyz", "h1", "h2", "h3")
    for k, (c, o) in enumerate(zip("xyz", OFFSET), 1):
        n, reach = _buckets(k, radius), radius / F.col(f"h{k}") + 1e-9
        touched = F.sequence(F.floor((F.col(c) - reach) * n).cast("int"), F.floor((F.col(c) + reach) * n).cast("int"))
        b = b.withColumn("__at", F.explode(touched)).withColumns({f"b{k}": F.pmod("__at", n), o: (-F.floor(F.col("__at") / n)).cast("int")}).drop("__at")
    b = b.withColumns({f"r{c}": F.col(c) + F.col(o) for c, o in zip("xyz", OFFSET)}).drop(*"xyz", "h1", "h2", "h3")
    pairs = a.join(b, ["structure", "b1", "b2", "b3"])
    x, y, z = (F.col(f"r{c}") - F.col(f"l{c}") for c in "xyz")
    d2 = (F.col("m11") * x + F.col("m12") * y + F.col("m13") * z) ** 2 + (F.col("m22") * y + F.col("m23") * z) ** 2 + (F.col("m33") * z) ** 2
    return pairs.select("structure", "l", "r", *OFFSET, F.sqrt(d2).alias("d")).filter(F.col("d") <= radius)


def _once() -> Column:
    """Of the two ways to say that two sites are near, the one from the smaller site; of a site and its image the later."""
    return (F.col("l.site") < F.col("r.site")) | ((F.col("l.site") == F.col("r.site")) & (F.struct(*OFFSET) > F.struct(*[F.lit(0).alias(o) for o in OFFSET])))


def disorder_clusters(placed: DataFrame) -> DataFrame:
    """structure, label, cluster: labels of one cluster exclude each other.

    Linked are part-occupied sites of one element nearer than 0.9 angstrom, and the atoms of an assembly that has
    several groups (atoms with a group but no assembly share one). Links chain, so an exclusion is an equal cluster.
    """
    part = placed.filter("occ < 0.999")
    near = periodic_pairs(part, part, DISORDERED, ["site", "label", "sym"], ["site", "label", "sym"])
    near = near.filter(_once() & (F.col("l.sym") == F.col("r.sym")) & (F.col("d") < DISORDERED)).select("structure", F.col("l.label").alias("a"), F.col("r.label").alias("b"))
    tagged = placed.filter(F.col("grp").isNotNull() & ~F.col("grp").isin(".", "", "?")).select("structure", "label", F.coalesce("assembly", F.lit(".")).alias("assembly"), "grp")
    several = tagged.groupBy("structure", "assembly").agg(F.min("label").alias("a"), F.min("grp").alias("lo"), F.max("grp").alias("hi")).filter("lo <> hi")
    named = tagged.join(several, ["structure", "assembly"]).select("structure", "a", F.col("label").alias("b"))
    node = lambda c: F.struct("structure", F.col(c).alias("label"))
    links = near.unionByName(named).filter("a <> b").select(node("a").alias("src"), node("b").alias("dst"))
    found = graph.components(links)
    roots = found.select(F.col("label").alias("node"), "label").distinct()
    return found.unionByName(roots).select("node.*", F.col("label.label").alias("cluster"))


def with_clusters(placed: DataFrame, clusters: DataFrame) -> DataFrame:
    return placed.join(clusters, ["structure", "label"], "left")


def _excluded() -> Column:
    return F.coalesce((F.col("l.cluster") == F.col("r.cluster")) & (F.col("l.label") != F.col("r.label")), F.lit(False))


def periodic_bonds(placed: DataFrame) -> DataFrame:
    """Bonds of each structure, once each: structure, i, j (sites), label_i, label_j, du, dv, dw (of j), d, expected, outlying.

    placed are sites() with a cluster. A site may be bonded to its own image. The reach is that of the largest element
    in the table.
    """
    radii = placed.select("sym").distinct().agg(F.max(lookup(F.col("sym"), COVALENT))).first()[0]  # a row for each element
    reach = 2 * (radii or 0.7) + BOND_TOLERANCE
    kept = ["site", "label", "sym", "occ", "cluster"]
    pairs = periodic_pairs(placed, placed, reach, kept, kept).filter(_once() & (F.col("d") > SHORTEST))
    pairs = pairs.withColumn("expected", lookup(F.col("l.sym"), COVALENT) + lookup(F.col("r.sym"), COVALENT))
    bonded = (F.col("d") <= F.col("expected") + BOND_TOLERANCE) & ~((F.col("l.occ") < 1) & (F.col("r.occ") < 1) & (F.col("d") < DISORDERED)) & ~_excluded()
    return pairs.filter(bonded).select(
        "structure", F.col("l.site").alias("i"), F.col("r.site").alias("j"), F.col("l.label").alias("label_i"), F.col("r.label").alias("label_j"), *OFFSET, "d", "expected",
        (F.abs(F.col("d") - F.col("expected")) > OUTLYING).alias("outlying"),
    )


def molecules(placed: DataFrame, bonds: DataFrame) -> DataFrame:
    """structure, site, molecule (its smallest site), du, dv, dw, dimension: each site's cell in the molecule around the smallest.

    The molecule is a component of the graph of sites whose edges carry whole-cell offsets. dimension is 0 for a
    molecule that closes: its atoms are these images. It is 1 to 3 for chains, layers and frameworks, which come back
    to a site in another cell and never end; their offsets are null, as no image of theirs is the whole.
    """
    node = lambda c: F.struct("structure", F.col(c).alias("site"))
    found, periods = graph.offset_components(bonds.select(node("i").alias("src"), node("j").alias("dst"), *OFFSET))
    labels = found.select("node.*", F.col("root.site").alias("molecule"), *OFFSET)
    ranks = graph.period_ranks(periods).select(F.col("root.structure").alias("structure"), F.col("root.site").alias("molecule"), "rank")
    out = placed.select("structure", "site").join(labels, ["structure", "site"], "left").withColumn("molecule", F.coalesce("molecule", "site"))
    dimension = F.coalesce("rank", F.lit(0))
    return out.join(ranks, ["structure", "molecule"], "left").select("structure", "site", "molecule", *[F.when(dimension == 0, F.coalesce(o, F.lit(0))).alias(o) for o in OFFSET], dimension.alias("dimension"))


def complete(seeds: DataFrame, found: DataFrame) -> DataFrame:
    """The whole molecules around seeds (structure, site, du, dv, dw): structure, site, du, dv, dw, molecule, once each.

    found is molecules(). Two seeds in one image of a molecule give it once, seeds in different images each theirs.
    A seed in a network gives nothing; such molecules have a dimension.
    """
    closed = found.filter("dimension = 0").select("structure", "site", "molecule", *[F.col(o).alias(f"m{o}") for o in OFFSET])
    moved = seeds.join(closed, ["structure", "site"]).select("structure", "molecule", *[(F.col(o) - F.col(f"m{o}")).alias(f"s{o}") for o in OFFSET]).distinct()
    return moved.join(closed, ["structure", "molecule"]).select("structure", "site", *[(F.col(f"s{o}") + F.col(f"m{o}")).alias(o) for o in OFFSET], "molecule")


def symmetry_code(op: Column, shifts: list[Column]) -> Column:
    """n_pqr of an image by operation (from 0) and whole cells; '.' for the atom itself."""
    text = F.concat((op + 1).cast("string"), F.lit("_"), *[(s + 5).cast("string") for s in shifts])
    return F.when((op == 0) & (shifts[0] == 0) & (shifts[1] == 0) & (shifts[2] == 0), ".").otherwise(text)


def hydrogen_bond_images(placed: DataFrame, angle_min: float = ANGLE) -> DataFrame:
    """Donor, hydrogen and acceptor triples over all images: structure, donor, hydrogen, acceptor, da, ha, angle, kind, strength, code.

    A hydrogen of the cell belongs to its nearest heavier atom in any cell, if that is a bonded donor; it is moved to
    the neutron length along the bond. kind is disorder where donor and acceptor exclude each other, far beyond the sum
    of radii, else by angle hbond, contact or bent. code is the acceptor's symmetry code as seen from the hydrogen's
    cell. Triples of the same three labels and distance to two decimals are given once for each kind, by the first hydrogen,
    acceptor and offset. placed are sites() with a cluster.
    """
    kept = ["site", "label", "sym", "x", "y", "z", "cluster"]
    heavy, hydrogens = placed.filter("sym <> 'H'"), placed.filter("sym = 'H'")
    limit = max(COVALENT[s] for s in DONORS) + COVALENT["H"] + BOND_TOLERANCE
    near = periodic_pairs(hydrogens, heavy, limit, ["site", "label", "x", "y", "z", *_BASIS], kept)
    owned = near.groupBy("structure", "l.site").agg(F.min(F.struct("d", F.col("r.site").alias("to"), *OFFSET, "l", "r")).alias("o")).select("structure", "o.*")
    owned = owned.filter(F.col("r.sym").isin(*DONORS) & (F.col("d") > SHORTEST) & (F.col("d") <= lookup(F.col("r.sym"), COVALENT) + COVALENT["H"] + BOND_TOLERANCE))
    # from here on places are seen from the donor's own cell; the hydrogen's cell is `home` away from it
    donors = owned.select(
        "structure", F.col("r.site").alias("dsite"), F.col("r.label").alias("label"), F.col("r.sym").alias("sym"), F.col("r.cluster").alias("cluster"), *[F.col(f"r.{c}").alias(c) for c in "xyz"],
        F.col("l.site").alias("hsite"), F.col("l.label").alias("hydrogen"), "d", *[(F.col(f"l.{c}") - F.col(f"r.{c}") - F.col(o)).alias(f"h{c}") for c, o in zip("xyz", OFFSET)], *[F.col(o).alias(f"home_{o}") for o in OFFSET], *[F.col(f"l.{m}").alias(m) for m in _BASIS],
    )
    mine = ["dsite", "label", "sym", "cluster", "hsite", "hydrogen", "d", "hx", "hy", "hz", *[f"home_{o}" for o in OFFSET], *[c for c in "xyz"], *_BASIS[:6]]
    pairs = periodic_pairs(donors, heavy.filter(F.col("sym").isin(*ACCEPTORS)), LONGEST_DA, mine, [*kept, "op", "su", "sv", "sw"])
    pairs = pairs.filter(F.col("d") >= SHORTEST)

    def cartesian(f: list[Column]) -> list[Column]:
        m = {k: F.col(f"l.{k}") for k in _BASIS[:6]}
        return [m["m11"] * f[0] + m["m12"] * f[1] + m["m13"] * f[2], m["m22"] * f[1] + m["m23"] * f[2], m["m33"] * f[2]]

    size = lambda v: F.sqrt(sum(x * x for x in v))
    stretch = lookup(F.col("l.sym"), NEUTRON) / F.col("l.d")
    dh = [stretch * v for v in cartesian([F.col(f"l.h{c}") for c in "xyz"])]
    da = cartesian([F.col(f"r.{c}") + F.col(o) - F.col(f"l.{c}") for c, o in zip("xyz", OFFSET)])
    ha = [a - h for a, h in zip(da, dh)]
    cosine = ratio(sum(-h * v for h, v in zip(dh, ha)), size(dh) * size(ha))
    pairs = pairs.withColumns({"ha": size(ha), "angle": F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))})
    far = F.col("ha") > lookup(F.col("r.sym"), VAN_DER_WAALS, OTHER_VAN_DER_WAALS) + VAN_DER_WAALS["H"]
    kind = F.when(_excluded(), "disorder").when(far, "far").when(F.col("angle") >= angle_min, "hbond").when(F.col("angle") >= CONTACT_ANGLE, "contact").otherwise("bent")
    shifts = [F.col(f"r.{s}") + F.col(o) + F.col(f"l.home_{o}") for s, o in zip(("su", "sv", "sw"), OFFSET)]
    rows = pairs.select(
        "structure", F.col("l.label").alias("donor"), F.col("l.hydrogen").alias("hydrogen"), F.col("r.label").alias("acceptor"), F.col("d").alias("da"), "ha", "angle", kind.alias("kind"),
        distance_class(F.col("d")).alias("strength"), symmetry_code(F.col("r.op"), shifts).alias("code"), F.struct(F.col("l.hsite").alias("h"), F.col("r.site").alias("a"), *[(F.col(o) + F.col(f"l.home_{o}")).alias(o) for o in OFFSET]).alias("order"),
    )
    measured = lambda c: F.when(F.col("kind") != "disorder", F.col(c)).alias(c)
    first = F.row_number().over(Window.partitionBy("structure", "donor", "hydrogen", "acceptor", "kind", F.round("da", 2)).orderBy("order"))
    return rows.withColumn("__k", first).filter("__k = 1").select("structure", "donor", "hydrogen", "acceptor", "da", measured("ha"), measured("angle"), "kind", "strength", "code")
