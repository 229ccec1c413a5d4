"""Graphs given as edge tables: connected components, transitive closure, growth by shells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (src, dst) -> node, label: the smallest node reachable. Nodes without an edge and the smallest don't appear.

    Alternates large-star and small-star steps: each turns every neighbourhood into a star around its smallest node,
    so long chains shrink by halves. A step is two shuffles of the edges; partial aggregation finds a busy node's
    minimum and the join back may be split, so no neighbourhood meets in one task. Ends when no edge changes.
    """
    edges = materialize(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct(), "edges")

    def signature(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())

    seen = signature(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u <> v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = materialize(small.filter("u <> v").distinct(), "small-star")
        before, seen = seen, signature(edges)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def closure(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Transitive closure of undirected edges (src, dst), without pairs of a node with itself; paths double each round.

    For small groups of alternatives: its size is that of all pairs within components, by definition.
    """
    pairs = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    pairs = materialize(pairs.filter("src <> dst").distinct(), "closure")
    n = pairs.count()
    for _ in range(max_rounds):
        step = pairs.alias("a").join(pairs.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        pairs = materialize(pairs.unionByName(step.filter("src <> dst")).distinct(), "closure")
        before, n = n, pairs.count()
        if n == before:
            return pairs
    raise RuntimeError(f"closure did not settle in {max_rounds} rounds")


def shells(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Nodes within depth steps of start (node): node, shell (steps from the nearest start)."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = start.select("node").distinct().withColumn("shell", F.lit(0))
    front = seen
    for k in range(1, depth + 1):
        found = both.join(front, both.src == front.node).select(F.col("dst").alias("node")).distinct()
        front = materialize(found.join(seen, "node", "left_anti").withColumn("shell", F.lit(k)), "shell")
        seen = seen.unionByName(front)
    return seen


def offset_components(edges: DataFrame, max_rounds: int = 60) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, du, dv, dw) of a periodic graph, dst lying that many cells from src -> nodes, periods.

    nodes: node, root (the smallest node reachable) and the cell du, dv, dw of the node when the root's is 0; nodes
    without an edge don't appear. periods: root, du, dv, dw, the offsets with which ways around come back to where they
    began; together they span all such. A component without periods is finite.

    Large and small stars as in components(), with edges that carry the sum of offsets along the way that they stand
    for. Where two ways between two nodes differ, the smaller offset stays and the difference is a period.
    """
    names = ("du", "dv", "dw")
    offset = lambda f: F.struct(*[f(n).alias(n) for n in names])
    plus = lambda a, b, sign=1: offset(lambda n: F.col(f"{a}.{n}") + sign * F.col(f"{b}.{n}"))
    down = F.col("src") > F.col("dst")
    raw = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"), offset(lambda n: F.when(down, F.col(n)).otherwise(-F.col(n))).alias("t"))
    raw = materialize(raw.distinct(), "offset-edges")
    nought = offset(lambda n: F.lit(0))
    periods = [raw.filter(F.col("u") == F.col("v")).filter(F.col("t") != nought).select(F.col("u").alias("node"), "t")]

    def settle(e: DataFrame, tag: str) -> DataFrame:
        """One edge between two nodes; what the others differ by goes to periods."""
        e = materialize(e.filter("u <> v").distinct(), tag)
        one = e.groupBy("u", "v").agg(F.min("t").alias("t"), F.count("*").alias("ways"))
        many = one.filter("ways > 1").select("u", "v", F.col("t").alias("least"))
        periods.append(e.join(many, ["u", "v"]).filter("t <> least").select(F.col("u").alias("node"), plus("t", "least", -1).alias("t")).distinct())
        return one.drop("ways")

    def signature(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v", "t")), F.sum(F.pmod(F.xxhash64("v", "u", "t"), F.lit(1 << 31)))).first())

    e = materialize(settle(raw, "offset-edges"), "offset-star")
    seen = signature(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), offset(lambda n: -F.col(f"t.{n}")).alias("t")))
        itself = F.struct(F.col("u").alias("v"), nought.alias("t"))
        least = both.groupBy("u").agg(F.min(F.struct("v", "t")).alias("m")).select(F.col("u").alias("w"), F.least("m", itself).alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m.v").alias("v"), plus("m.t", "t", -1).alias("t"))
        large = materialize(settle(large, "offset-large"), "offset-large")
        least = large.groupBy("u").agg(F.min(F.struct("v", "t")).alias("m")).withColumnRenamed("u", "w")
        turned = F.array(F.struct("u", F.col("m.v").alias("v"), F.col("m.t").alias("t")), F.struct(F.col("v").alias("u"), F.col("m.v").alias("v"), plus("m.t", "t", -1).alias("t")))
        small = large.join(least, F.col("u") == F.col("w")).select(F.explode(turned).alias("e")).select("e.*")
        e = materialize(settle(small, "offset-small"), "offset-star")
        before, seen = seen, signature(e)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    placed = e.select(F.col("u").alias("node"), F.col("v").alias("root"), *[(-F.col(f"t.{n}")).alias(n) for n in names])
    roots = placed.select(F.col("root").alias("node"), "root", *[F.lit(0).alias(n) for n in names]).distinct()
    nodes = placed.unionByName(roots)
    every = periods[0]
    for p in periods[1:]:
        every = every.unionByName(p)
    every = materialize(every.distinct(), "periods")
    return nodes, every.join(nodes.select("node", "root"), "node", "left").select(F.coalesce("root", "node").alias("root"), "t.*").distinct()


def period_ranks(periods: DataFrame) -> DataFrame:
    """root, rank: in how many directions (1 to 3) the offsets of each root go."""
    cross = lambda a, b: [F.col(f"{a}.{p}") * F.col(f"{b}.{q}") - F.col(f"{a}.{q}") * F.col(f"{b}.{p}") for p, q in (("dv", "dw"), ("dw", "du"), ("du", "dv"))]
    rows = periods.select("root", F.struct("du", "dv", "dw").alias("t")).filter("t.du <> 0 or t.dv <> 0 or t.dw <> 0")
    one = rows.groupBy("root").agg(F.min("t").alias("first"))
    x, y, z = cross("first", "t")
    two = rows.join(one, "root").filter((x != 0) | (y != 0) | (z != 0)).groupBy("root").agg(F.min("t").alias("second"))
    x, y, z = cross("first", "second")
    three = rows.join(one, "root").join(two, "root").filter(x * F.col("t.du") + y * F.col("t.dv") + z * F.col("t.dw") != 0).select("root").distinct()
    step = lambda df: df.select("root", F.lit(1).alias("k"))
    return step(one).unionByName(step(two)).unionByName(step(three)).groupBy("root").agg(F.sum("k").cast("int").alias("rank"))
