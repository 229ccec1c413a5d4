"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

The ring is cut into CELLS equal cells; a key lies in the cell of its id's MD5, a virtual node in that of its own name.
Each cell prefers the shards in the order in which a walk clockwise meets their virtual nodes. Keys fill shards cell by
cell; where a shard is full, the keys left over go on to the next shard clockwise that has room, round by round. All
this runs on counts of cells, whose number is a parameter, so the rows themselves are only counted, ranked in their
cell and looked up.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

CELLS = 1 << 14
VIRTUAL_NODES = 128
#: Rows of a cell that one task may rank; a cell with more, such as that of an id that a third of the rows repeat, is ranked in lanes.
LANE_ROWS = 1 << 18


def _cell(key: Column) -> Column:
    """The cell of a key: the first 16 bits of its MD5, cut down to CELLS."""
    return F.floor(F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("int") / ((1 << 16) // CELLS)).cast("int")


def ring(spark: SparkSession, shards: int, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """cell, prefers (all shards, in the order in which a walk clockwise from the cell meets them).

    Its size follows from the parameters alone. A shard's virtual nodes are the same however many shards there are.
    """
    name = F.concat_ws("#", F.lit("shard"), "shard", "node")
    nodes = spark.range(shards * virtual_nodes, numPartitions=1).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("node"))
    places = nodes.select("shard", F.md5(name).alias("point"), _cell(name).alias("at")).groupBy("shard", "at").agg(F.min("point").alias("point"))
    # the first node's walk starts behind the last one, a turn earlier
    prior = F.coalesce(F.lag("at").over(Window.partitionBy("shard").orderBy("at")), F.max("at").over(Window.partitionBy("shard")) - CELLS)
    walk = places.withColumn("prior", prior).withColumn("seen", F.explode(F.sequence(F.col("prior") + 1, F.col("at"))))
    met = walk.select(F.pmod("seen", F.lit(CELLS)).alias("cell"), F.struct((F.col("at") - F.col("seen")).alias("steps"), "point", "shard").alias("m"))
    return met.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["shard"]).alias("prefers"))


def _rounds(counts: DataFrame, n: int, quotas: list[int]) -> DataFrame:
    """Segments cell, low, high, shard, start: keys low..high-1 of a cell go to slots from start on of the shard.

    counts has cell, n and prefers. Each round sends what is left to the next shard with room, in the order of cells;
    a shard keeps what its quota has room for. A round that leaves keys over fills a shard, so there are as many
    rounds as shards at most. Of a round the driver sees one number a shard.
    """
    left = counts.select("cell", "prefers", F.lit(0).cast("long").alias("low"), F.col("n").alias("high"))
    used, done = [0] * len(quotas), []
    while sum(used) < n or not done:
        spare = [s for s, quota in enumerate(quotas) if used[s] < quota]
        by_shard = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("to") + 1)
        ahead = Window.partitionBy("to").orderBy("cell", "low").rowsBetween(Window.unboundedPreceding, -1)
        asking = left.withColumn("to", F.element_at(F.filter("prefers", lambda s: s.isin(spare)), 1))
        asking = asking.withColumn("begin", by_shard(used) + F.coalesce(F.sum(F.col("high") - F.col("low")).over(ahead), F.lit(0)))
        room = F.greatest(F.lit(0), F.least(F.col("high") - F.col("low"), by_shard(quotas) - F.col("begin")))
        cut = materialize(asking.withColumn("mid", F.col("low") + room), "ring-round")
        done.append(cut.filter("mid > low").select("cell", "low", F.col("mid").alias("high"), F.col("to").alias("shard"), F.col("begin").alias("start")))
        left = cut.filter("high > mid").select("cell", "prefers", F.col("mid").alias("low"), "high")
        for r in cut.groupBy("to").agg(F.sum(F.col("mid") - F.col("low")).alias("n")).collect():
            used[r["to"]] += r["n"]
    return reduce(DataFrame.unionByName, done)


def assign(rows: DataFrame, shards: int = 16, slack: float = 0.0, virtual_nodes: int = VIRTUAL_NODES, id_col: str = "doc_id") -> DataFrame:
    """rows with shard (0 and up) and slot (gapless from 0 in each shard), by the rows' ids.

    Without slack each shard gets as many rows as any other, or one more; with slack s up to (1 + s) times its share,
    rounded up, so that fewer keys overflow and fewer move when shards are added. Rows of one id start from one place
    of the ring and stay together but where a shard fills up between them; a null id counts as an empty one. Within a
    cell keys come by MD5 and id; equal ids, and cells of more than LANE_ROWS rows, by their place in the input, which
    is written down once, so that a repeated task gives the same. Columns named shard or slot are replaced; an empty
    table gives no rows. Rows are shuffled once, by cell and lane.
    """
    spark = rows.sparkSession
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    own = [c for c in rows.columns if c not in ("shard", "slot")]
    kept = materialize(rows.select(F.struct(*own).alias("row"), F.md5(key).alias("point"), _cell(key).alias("cell"), F.monotonically_increasing_id().alias("place")), "ring-rows")
    sizes = kept.groupBy("cell").agg(F.count("*").alias("n"))
    cells = materialize(sizes.join(ring(spark, shards, virtual_nodes), "cell"), "ring-cells")
    n = cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    segments = _rounds(cells, n, [math.ceil(n * (1 + slack) / shards) if slack else n // shards + (k < n % shards) for k in range(shards)])
    # a row for each cell or each lane of one, so at most CELLS plus a row for LANE_ROWS rows
    busy = cells.filter(F.col("n") > LANE_ROWS).select("cell", F.ceil(F.col("n") / LANE_ROWS).alias("lanes"))
    lane = F.when(F.col("lanes").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("place"), "lanes"))
    dealt = kept.join(F.broadcast(busy), "cell", "left").withColumn("lane", lane).drop("lanes")
    lanes = dealt.join(F.broadcast(busy.select("cell")), "cell", "left_semi").groupBy("cell", "lane").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("cell").orderBy("lane")) - F.col("n")
    offsets = lanes.select("cell", "lane", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("cell", "lane").orderBy("point", f"row.{id_col}", "place")) - 1
    ranked = dealt.withColumn("inside", inside).join(F.broadcast(offsets), ["cell", "lane"], "left").withColumn("rank", F.col("inside") + F.coalesce("before", F.lit(0)))
    # a segment for each cell, and a cut one for each shard and round at most
    found = ranked.alias("r").join(F.broadcast(segments).alias("g"), (F.col("r.cell") == F.col("g.cell")) & F.col("r.rank").between(F.col("g.low"), F.col("g.high") - 1))
    return found.select("r.row.*", F.col("g.shard"), (F.col("g.start") + F.col("r.rank") - F.col("g.low")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16, slack: float = 0.0, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """A row per row of docs: doc_id, size (bytes of the text in UTF-8 plus 1; null: 1), text_crc32, shard, slot.

    Texts are read once, to be measured, and not shuffled. Copies of a text are rows like any other: a group of them
    that holds a third of the rows can't lie in one of 16 equally full shards. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return assign(slim, shards, slack, virtual_nodes)
