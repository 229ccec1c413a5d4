"""SimHash near-dedup: 64-bit fingerprints, BK-trees inside pigeonhole shards, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import keep_one, materialize, text_sum

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ALL_BITS = (1 << 64) - 1
_SPACES = bytes([*range(9, 14), 32])
_ONE_SPACE = bytes(32 if b in _SPACES else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Shingles hashed at once; bounds memory on very long texts.
_BLOCK = 1 << 16
#: A shard with more fingerprints is dealt again by its free bits, so that one tree holds at most 2 ** 18 at radius 2.
MOST_IN_SHARD = 2048


def _majority(hashes: np.ndarray, counts: np.ndarray) -> None:
    counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def _shingle_blocks(raw: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of a text's shingles in blocks; none for a text without words."""
    words = raw.translate(_ONE_SPACE).split(b" ")
    words = [w for w in words if w]
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    n = max(1, len(words) - size + 1)
    stops = stops[size - 1 :] if len(words) >= size else stops[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        yield np.array([digest(line[a:b], 42) for a, b in zip(starts[at : min(n, at + _BLOCK)], stops[at : at + _BLOCK])], np.uint64)


def shingle_hashes(raw: bytes, size: int) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *_shingle_blocks(raw, size)])


def fingerprint(raw: bytes, size: int = 3) -> int:
    """A bit is 1 if set in over half of the shingles' XXH64 (seed 42); 0 for a text without words."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in _shingle_blocks(raw, size):
        _majority(hashes, counts)
        n += len(hashes)
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits).view(np.uint64)[0])


def fingerprint_of(hashes: np.ndarray) -> int:
    """The same from all of a text's shingle hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        _majority(hashes[at : at + _BLOCK], counts)
    return int(np.packbits((2 * counts > len(hashes)).astype(np.uint8)).view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(v.as_buffer().to_pybytes() if v.is_valid else b"", size) for v in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _blocks(n: int) -> list[tuple[int, int]]:
    """64 bits cut into n runs: (shift, width)."""
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _masks(radius: int) -> list[int]:
    """Bits at most `radius` apart in fingerprints agree under one of these masks: all but `radius` of radius + 3 blocks.

    Each mask fixes 38 bits or more at radius 2, so what a shard can hold is bounded by the bits left free.
    """
    n = radius + 3
    parts = [((1 << w) - 1) << s for s, w in _blocks(n)]
    return [sum(keep) for keep in combinations(parts, n - radius)]


def _free_masks(mask: int, radius: int) -> list[int]:
    """A second dealing of one shard: the bits that mask leaves free in radius + 1 runs, one of which must agree."""
    free = [b for b in range(64) if not mask >> b & 1]
    n = radius + 1
    return [sum(1 << b for b in free[len(free) * i // n : len(free) * (i + 1) // n]) for i in range(n)]


def _deal(prints: DataFrame, masks: list[int], k: str, part: str, *keys: str) -> DataFrame:
    each = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(masks)])
    rows = prints.select("fp", *keys, F.explode(each).alias("m"))
    return rows.select("fp", *keys, F.col("m.k").alias(k), F.col("fp").bitwiseAND(F.col("m.mask")).alias(part))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class BKTree:
    """Children are keyed by integer Hamming distance to the parent; a search follows only edges within the radius.

    Fingerprints may be given signed or not: their 64 bits are compared.
    """

    def __init__(self) -> None:
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        value &= ALL_BITS
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            edges = self.edges[at]
            if len(edges) <= 2 * radius + 1:
                todo += [to for e, to in edges.items() if d - radius <= e <= d + radius]
            else:
                todo += [edges[e] for e in range(d - radius, d + radius + 1) if e in edges]
        return found

    def add(self, value: int) -> int:
        value &= ALL_BITS
        self.values.append(value)
        self.edges.append({})
        new = len(self.values) - 1
        at = 0
        while new:
            d = (self.values[at] ^ value).bit_count()
            if d not in self.edges[at]:
                self.edges[at][d] = new
                break
            at = self.edges[at][d]
        return new


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links of one shard's different fingerprints as a forest: (value, smallest value of its tree)."""
    tree, root = BKTree(), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    values = sorted(values)
    for value in values:
        near = tree.near(value, radius)
        new = tree.add(value)
        root.append(new)
        for i in near:
            a, b = top(i), top(new)
            root[max(a, b)] = min(a, b)
    return [(v, values[top(i)]) for i, v in enumerate(values) if top(i) != i]


def _links_in_shards(prints: DataFrame, radius: int) -> DataFrame:
    """Different fingerprints -> src, dst with the same connected components as all links within the radius.

    Every fingerprint goes to one shard for each mask; a shard is searched by one BK-tree. Fingerprints alone under
    their mask are dropped by a count before anything is gathered, and a crowded shard is dealt again.
    """
    dealt = _deal(prints, _masks(radius), "k", "part")
    sizes = dealt.groupBy("k", "part").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = materialize(dealt.join(sizes, ["k", "part"]), "shards")
    light = crowded.filter(F.col("n") <= MOST_IN_SHARD).groupBy("k", "part").agg(F.collect_list("fp").alias("fps")).select("fps")
    heavy = crowded.filter(F.col("n") > MOST_IN_SHARD)
    shards = light
    if not heavy.isEmpty():
        for k, mask in enumerate(_masks(radius)):
            again = _deal(heavy.filter(F.col("k") == k).select("fp", "part"), _free_masks(mask, radius), "j", "sub", "part")
            shards = shards.unionByName(again.groupBy("part", "j", "sub").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for fps in batch.column("fps").to_pylist():
                out += shard_links(fps, radius)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["src", "dst"])

    return shards.mapInArrow(run, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 2, size: int = 3) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Texts are lower-cased (A-Z), cut at ASCII white space into words and hashed by shingles of `size` words, repeats
    included; a shorter text is one shingle; a text without words (null, empty, blank) has fingerprint zero and is
    linked like any other. Fingerprints that differ in `radius` bits or fewer are linked; component_id is the
    smallest doc_id reachable, itself included. Equal fingerprints are joined before the search, so copies cost
    one entry. Null ids take part but never name a component unless it has no other. Rows that repeat stay rows.
    """
    rows = materialize(with_fingerprints(docs, size), "fingerprints")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    label = components(_links_in_shards(prints, radius))
    named = prints.join(label, prints.fp == label.node, "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    ids = materialize(named.join(least, "label").select(F.col("fp").alias("print"), "component_id"), "component-ids")
    return rows.join(ids, F.col("fp") == F.col("print")).select("doc_id", hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def hex_print(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def drop_near_copies(docs: DataFrame, radius: int = 2, size: int = 3) -> DataFrame:
    """docs with all its columns, one row of each component (see near_duplicates): that with the smallest doc_id.

    Rows are told apart by id and text. A row without an id stays only where none of its component has one; of rows
    that repeat id and text one stays.
    """
    keyed = docs.select(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", text_sum().alias("sum")).alias("doc_id"), "text")
    found = near_duplicates(keyed, radius, size)
    return keep_one(docs, found.select("doc_id.doc_id", "doc_id.sum", F.col("component_id").alias("part")))
