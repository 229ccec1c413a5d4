"""SimHash near dedup with a bound on similarity: texts whose sets of word shingles have a Jaccard index of at least it.

Fingerprints alone can't tell texts that are just similar enough, which differ in some ten bits, from others, and a
search within so many bits over all fingerprints would be one over all pairs. So it is done where it can succeed:

1. A shard is a rare shingle. A set's prefix is its rarest shingles, so many that two sets of the wanted similarity
   share one of them whatever the order of rarity is (prefix filtering).
2. A BK-tree of each shard's fingerprints links those within the radius, as a forest, so copies never become all pairs.
3. Each connected group's sets are sent once to blocks of bounded size and compared exactly, those first that are near
   in a BK-tree; texts that are linked already aren't compared again.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import keep_one, materialize, slices, text_sum
from .simhash import ALL_BITS, BKTree, fingerprint_of, shingle_hashes
from .sketch import in_sketch, sketch

#: Differing bits up to which fingerprints are looked at. At a similarity of 0.8 some 9.7 bits differ, 2.9 being one
#: standard deviation, so that a pair lies beyond this with a chance of less than one in a thousand.
RADIUS = 20
#: Bits of a shingle's hash by which its text count is kept, and cells of counts that go from task to task as one row.
CELL_BITS, ROW_CELLS = 22, 1 << 12
#: Members of a shard in one tree and of a block; a larger shard or group is dealt into blocks.
MOST_IN_TREE, MOST_IN_BLOCK = 1024, 256
#: Shingles in a block, about.
MOST_SHINGLES = 1 << 21
_SLACK = 1e-9


def shingle_set(raw: bytes, size: int) -> np.ndarray:
    """The different XXH64 of a text's shingles in order; empty for a text without words."""
    return np.unique(shingle_hashes(raw, size))


def prefix(hashes: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest of a set: sets of at least the similarity share one of these."""
    n = len(hashes)
    p = n - ceil(similarity * n - _SLACK) + 1 if n else 0
    return hashes[np.lexsort((hashes, counts[hashes >> np.uint64(64 - CELL_BITS)]))[:p]]


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - _SLACK:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - _SLACK


def _raw(value: pa.Scalar) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def _common(docs: DataFrame, size: int) -> np.ndarray:
    """How often the shingles of all texts fall on each cell; the order by it sets the speed and never the result."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, np.int32)
        for batch in slices(batches):
            for v in batch.column("text"):
                np.add.at(counts, shingle_set(_raw(v), size) >> np.uint64(64 - CELL_BITS), 1)
        rows = counts.reshape(-1, ROW_CELLS)
        some = np.flatnonzero(rows.any(axis=1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([rows[i].tobytes() for i in some], pa.binary())], names=["row", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(ROW_CELLS, np.int64)
        for batch in batches:
            done = []
            for row, counts in zip(batch.column("row").to_pylist(), batch.column("counts")):
                if row != at:
                    done.append((at, total))
                    at, total = row, np.zeros(ROW_CELLS, np.int64)
                total += np.frombuffer(counts.as_buffer(), np.int32)
            yield _counted(done)
        yield _counted([(at, total)])

    made = docs.select("text").mapInArrow(count, "row int, counts binary")
    found = made.repartition("row").sortWithinPartitions("row").mapInArrow(add, "row int, counts binary").toArrow()
    counts = np.zeros(((1 << CELL_BITS) // ROW_CELLS, ROW_CELLS), np.int32)
    for row, raw in zip(found["row"].to_pylist(), found["counts"].to_pylist()):
        counts[row] = np.frombuffer(raw, np.int32)
    return counts.ravel()


def _counted(rows: list[tuple[int | None, np.ndarray]]) -> pa.RecordBatch:
    rows = [(row, np.minimum(n, 2**31 - 1).astype(np.int32).tobytes()) for row, n in rows if row is not None]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["row", "counts"])


def _signatures(docs: DataFrame, similarity: float, size: int) -> DataFrame:
    """A row per row: doc_id, sum (of the text), key (of its set), and the set's n, fp (each shingle once) and prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(_common(docs, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in slices(batches):
            sets = [shingle_set(_raw(v), size) for v in batch.column("text")]
            prints = np.fromiter((fingerprint_of(s) for s in sets), np.uint64, len(sets)).view(np.int64)
            keys = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets), np.uint64, len(sets)).view(np.int64)
            least = pa.array([prefix(s, counts, similarity).view(np.int64) for s in sets], pa.list_(pa.int64()))
            n = pa.array([len(s) for s in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sum"), pa.array(keys), n, pa.array(prints), least], names=["doc_id", "sum", "key", "n", "fp", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_sum().alias("sum"), "text").mapInArrow(run, f"doc_id {kind}, sum long, key long, n int, fp long, prefix array<bigint>")


def _shards(rows: DataFrame) -> DataFrame:
    """rows (see _signatures) -> token, key, fp, members: shingles that the prefixes of several sets have, with the sets.

    Copies of one set count as often as they occur until the sieve is through; then sets are counted.
    """
    shared = materialize(rows.select(F.explode("prefix").alias("token")).groupBy("token").count().filter("count > 1").select("token"), "shared-shingles")
    sieve = sketch(rows.sparkSession, shared, "token")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sieve.value
        for batch in batches:
            tokens = batch.column("prefix")
            owner, token = tokens.value_parent_indices().to_numpy(), tokens.flatten().to_numpy()
            keep = in_sketch(words, token)
            at = pa.array(owner[keep])
            yield pa.RecordBatch.from_arrays([pa.array(token[keep]), batch.column("key").take(at), batch.column("fp").take(at)], names=["token", "key", "fp"])

    members = rows.select("key", "fp", "prefix").mapInArrow(run, "token long, key long, fp long")
    members = materialize(members.groupBy("token", "key").agg(F.min("fp").alias("fp")), "members")
    sizes = members.groupBy("token").agg(F.count("*").alias("members")).filter("members > 1")
    return materialize(members.join(sizes, "token"), "shards")


def _forest(members: list[tuple[int, int]], radius: int) -> list[tuple[int, int]]:
    """Links (key, key) of fingerprints (key, fp) within the radius that join what isn't joined."""
    tree, root, links = BKTree(), list(range(len(members))), []
    for i, (key, fp) in enumerate(members):
        for j in tree.near(fp, radius):
            a, b = _top(root, i), _top(root, j)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((key, members[j][0]))
        tree.add(fp)
    return links


def _visits(members: list[tuple[int, int, bool]], visitors: list[tuple[int, int]], radius: int) -> list[tuple[int, int]]:
    """Links of visitors to members (key, fp, far) within the radius; those of the members not far are joined already."""
    tree, links = BKTree(), []
    for _, fp, _ in members:
        tree.add(fp)
    for key, fp in visitors:
        joined = False
        for j in tree.near(fp, radius):
            other, _, far = members[j]
            if other != key and (far or not joined):
                joined |= not far
                links.append((key, other))
    return links


def _top(root: list[int], i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["src", "dst"])


def _bits(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _near(shards: DataFrame, radius: int) -> DataFrame:
    """Links between fingerprints within the radius in each shard, with the same components as all such links.

    A shard of few members has one tree. In a larger one all members first meet one of them; those beyond the radius
    of it, few if the shard is of copies, then meet trees of all the shard's blocks.
    """

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for members in batch.column("members").to_pylist():
                found.update(_forest([(m["key"], m["fp"]) for m in members], radius))
            yield _links(list(found))

    listed = F.array_sort(F.collect_list(F.struct("key", "fp"))).alias("members")
    # one tree for all shingles of the same sets
    small = shards.filter(F.col("members") <= MOST_IN_TREE).groupBy("token").agg(listed).select("members").distinct()
    near = small.mapInArrow(trees, "src long, dst long")
    large = shards.filter(F.col("members") > MOST_IN_TREE)
    if large.isEmpty():
        return near
    hubs = large.groupBy("token").agg(F.min(F.struct("key", "fp")).alias("hub")).select("token", F.col("hub.key").alias("hub"), F.col("hub.fp").alias("hub_fp"))
    met = materialize(large.join(hubs, "token").withColumn("far", _bits("fp", "hub_fp") > radius), "hubs")
    star = met.filter("not far and key <> hub").select(F.col("key").alias("src"), F.col("hub").alias("dst"))
    met = met.withColumn("blocks", F.ceil(F.col("members") / MOST_IN_TREE))
    each = met.filter("far").select("token", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "key", "fp")
    lists = met.groupBy("token", F.pmod(F.xxhash64("key"), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("key", "fp", "far")).alias("members"))
    salt = F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).alias("salt")
    visitors = each.groupBy("token", "block", salt).agg(F.collect_list(F.struct("key", "fp")).alias("visitors"))

    def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for members, visitors in zip(batch.column("members").to_pylist(), batch.column("visitors").to_pylist()):
                found.update(_visits([(m["key"], m["fp"], m["far"]) for m in members], [(m["key"], m["fp"]) for m in visitors], radius))
            yield _links(list(found))

    far = visitors.join(lists, ["token", "block"]).select("members", "visitors").mapInArrow(meetings, "src long, dst long")
    return near.unionByName(star).unionByName(far)


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """wanted (of, of_sum, ...) with hashes: the sets of those rows, made again from their texts.

    A sketch of the wanted rows keeps the other texts where they are.
    """
    mark = lambda a, b: F.xxhash64(a, b)
    sieve = sketch(docs.sparkSession, wanted.select(mark("of", "of_sum").alias("mark")), "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sieve.value
        for batch in batches:
            for part in slices([batch.filter(pa.array(in_sketch(words, batch.column("mark").to_numpy())))]):
                sets = pa.array([shingle_set(_raw(v), size).tobytes() for v in part.column("text")], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("sum"), sets], names=["doc_id", "sum", "hashes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_sum().alias("sum"), "text").withColumn("mark", mark("doc_id", "sum"))
    made = rows.mapInArrow(run, f"doc_id {kind}, sum long, hashes binary")
    known = made.join(wanted, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("sum") == F.col("of_sum")))
    return known.drop("doc_id", "sum", "of", "of_sum").dropDuplicates(["key"])  # rows may repeat id and text


class _Block:
    """Members of one block with their sets; links are what joins members that aren't joined."""

    def __init__(self, similarity: float, radius: int) -> None:
        self.similarity, self.radius = similarity, radius
        self.tree, self.keys, self.sets, self.root, self.links = BKTree(), [], [], [], []

    def add(self, key: int, fp: int, hashes: np.ndarray, part: int) -> None:
        """A member that is only met by others."""
        self.tree.add(fp)
        self.keys.append(key)
        self.sets.append(hashes)
        self.root.append(part)

    def meet(self, key: int, fp: int, hashes: np.ndarray, at: int) -> None:
        near = self.tree.near(fp, self.radius)
        for j in sorted(near, key=lambda j: (self.tree.values[j] ^ fp & ALL_BITS).bit_count()):
            a, b = _top(self.root, at), _top(self.root, j)
            if a != b and similar(hashes, self.sets[j], self.similarity):
                self.root[max(a, b)] = min(a, b)
                self.links.append((key, self.keys[j]))


def _in_blocks(rows: DataFrame, similarity: float, radius: int) -> DataFrame:
    """rows (part, block, role, key, fp, hashes, label) -> links. Role 0 meets nothing, 1 and 2 meet what came before.

    Role 1 are members of the block, which are then met; role 2 come from elsewhere and meet members of other labels.
    """
    order = ["part", "block", "role", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        block = _Block(similarity, radius)
        roots: dict[int, int] = {}
        for batch in batches:
            out: list[tuple[int, int]] = []
            for part, number, role, key, fp, label, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "role", "key", "fp", "label", "hashes"))):
                if at != (part, number):
                    out += block.links
                    at, block, roots = (part, number), _Block(similarity, radius), {}
                hashes = np.frombuffer(raw, np.uint64)
                own = len(block.root)
                if role < 2:
                    # members that share a label are joined from the start
                    root = own if label is None else roots.setdefault(label, own)
                    block.add(key, fp, hashes, root)
                    if role == 1 and label is None:
                        block.meet(key, fp, hashes, own)
                else:
                    if label not in roots:
                        roots[label] = own
                        block.root.append(own)  # of a label that no member has
                    block.meet(key, fp, hashes, roots[label])
            yield _links(out)
        yield _links(block.links)

    return rows.repartition("part", "block").sortWithinPartitions(*order).select("part", "block", "role", "key", "fp", "label", "hashes").mapInArrow(run, "src long, dst long")


def _similar_links(docs: DataFrame, rows: DataFrame, similarity: float, size: int, radius: int) -> DataFrame | None:
    """rows (see _signatures) -> src, dst (keys of sets): links with the same components as all similar pairs."""
    shards = _shards(rows)
    found = components(_near(shards, radius))
    group = found.select(F.col("node").alias("key"), F.col("label").alias("part")).unionByName(found.select(F.col("label").alias("key"), F.col("label").alias("part")).distinct())
    shares = shards.groupBy("key").agg(F.count("*").alias("shares"))
    named = rows.groupBy("key").agg(F.min(F.struct("doc_id", "sum", "fp", "n")).alias("one"))
    named = materialize(named.join(group, "key").join(shares, "key").select("key", "part", "shares", "one.*"), "groups")
    # the member that shares most is the likely original, which all others are compared with first
    parts = named.groupBy("part").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"), F.max_by("key", F.struct("shares", "key")).alias("hub"))
    blocks = F.greatest(F.ceil(F.col("members") / MOST_IN_BLOCK), F.ceil(F.col("shingles") / MOST_SHINGLES)).cast("int")
    # written, so that a join may split the rows of a large group
    parts = materialize(parts.select("part", "hub", blocks.alias("blocks")), "parts")
    wanted = named.join(parts, "part").select("key", "part", "hub", "blocks", "fp", F.col("doc_id").alias("of"), F.col("sum").alias("of_sum"))
    sets = materialize(_sets(docs, materialize(wanted, "wanted"), size), "sets")
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    unlabelled = lambda df, role: df.select("part", "block", F.lit(role).alias("role"), "key", "fp", "hashes", F.lit(None).cast("long").alias("label"))
    hubs = unlabelled(sets.filter("key = hub").withColumn("block", every), 0)
    links = materialize(_in_blocks(hubs.unionByName(unlabelled(sets.filter("key <> hub").withColumn("block", block), 1)), similarity, radius), "links")
    split = sets.filter("blocks > 1")
    if split.isEmpty():
        return links
    # across blocks: only members outside the largest component of their group visit the other blocks
    label = components(links)
    now = split.join(label, F.col("key") == F.col("node"), "left").withColumn("label", F.coalesce("label", "key")).drop("node")
    now = materialize(now.withColumn("block", block), "labelled")
    most = now.groupBy("part", "label").agg(F.count("*").alias("n")).groupBy("part").agg(F.max_by("label", F.struct("n", "label")).alias("most"))
    most = materialize(most, "largest")
    rest = now.join(most, "part").filter("label <> most").withColumn("block", every)
    columns = ["part", "block", "role", "key", "fp", "hashes", "label"]
    across = now.withColumn("role", F.lit(0)).select(*columns).unionByName(rest.withColumn("role", F.lit(2)).select(*columns))
    return links.unionByName(materialize(_in_blocks(across, similarity, radius), "links-across"))


def drop_similar(docs: DataFrame, similarity: float = 0.8, size: int = 5, radius: int = RADIUS) -> DataFrame:
    """docs with all its columns, one row of each component of texts of at least the similarity.

    Texts are lower-cased (A-Z) and cut at ASCII white space; a text's set is that of its shingles of `size` words (a
    shorter text is one shingle). Texts are linked if the Jaccard index of their sets is at least `similarity` and
    their fingerprints differ in at most `radius` bits. Texts without words are linked with each other. Of a component
    the row with the smallest doc_id stays; a row without an id stays only where none has one, and of rows that repeat
    id and text one stays.
    """
    rows = materialize(_signatures(docs, similarity, size), "signatures")
    label = components(_similar_links(docs, rows, similarity, size, radius))
    parts = rows.select("doc_id", "sum", "key").join(label, F.col("key") == F.col("node"), "left")
    return keep_one(docs, parts.select("doc_id", "sum", F.coalesce("label", "key").alias("part")))
