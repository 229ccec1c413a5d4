"""Repeated-substring removal: distributed prefix doubling over the positions that a sieve leaves.

A position's rank at length h names the h bytes that start there; equal ranks mean equal bytes.

Sieve. Ranking every position would move many times the corpus. Of each window of consecutive positions that one
string of the threshold's length spans, the position whose bytes (half the threshold) hash smallest is its anchor. The
choice depends on the string's bytes alone, so equal strings have their anchor at the same place and none is missed.
Strings whose anchor's bytes occur once are unique. All strings of one anchor lie in a stretch around it; if stretches
around equal anchors are equal throughout, all their strings are repeated. One of each kind of the other stretches goes on.

Doubling. The first rank of every position left names a quarter of the threshold. Spark sorts the pairs (rank at p, rank
at p + h) by range over the cluster; a pair's place among the different pairs is the rank at 2h, made of its place in the
task and of the counts of the tasks before it. Positions with a unique pair retire, the rest go on at twice the offset
until their rank spans the threshold. Position breaks ties in the sort, so equal pairs spread over tasks like any rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices
from .sketch import in_sketch, sketch

THRESHOLD = 200
#: Bytes of text that the kernel handles at once, with some 100 bytes of memory for each; longer texts are cut with an
#: overlap.
BLOCK = 1 << 18
#: Bytes of stretches whose positions are named at once.
NAMED = 1 << 18

_U = np.uint64
#: Low bits of a comparison key that hold the place; over all the places of a block with its overlap.
_PLACE_BITS = 24
_TABLES = np.random.default_rng(20_011).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASES = [0x5851F42D4C957F2D, 0x9E3779B97F4A7C15]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> _U(31))
    x *= _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n + 1:
        size = max(n + 1, 2 * BLOCK)
        base = _BASES[which]
        forth, back = np.full(size, base, _U), np.full(size, pow(base, -1, 1 << 64), _U)
        forth[0] = back[0] = 1
        have = _POWERS[which] = np.multiply.accumulate(forth), np.multiply.accumulate(back)
    return have


class Hasher:
    """Hashes any stretch of some bytes in constant time from running sums of a polynomial modulo 2 ** 64."""

    def __init__(self, data: np.ndarray, which: int = 0) -> None:
        n = len(data)
        forth, self.back = _powers(which, n)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(_TABLES[which][data] * forth[:n], out=self.sums[1:])

    def every(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:-size]) * self.back[:n])

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return _mix((self.sums[last] - self.sums[first]) * self.back[first])


def anchors(texts: list[np.ndarray], threshold: int) -> tuple[np.ndarray, ...]:
    """Over texts laid end to end: rank at half the threshold, stretch hash, text number, anchor, first, last start.

    first and last are the range of places, within the text, at which strings with this anchor start.
    """
    half = threshold // 2
    width = threshold - half + 1
    data = np.concatenate(texts)
    lengths = np.array([len(t) for t in texts])
    begin = np.cumsum(lengths) - lengths
    h = Hasher(data)
    rank = h.every(half)
    least = ((rank >> _U(_PLACE_BITS)) << _U(_PLACE_BITS)) | np.arange(len(rank), dtype=_U)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    at = (least & _U((1 << _PLACE_BITS) - 1)).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, begin, 1)
    np.add.at(inside, begin + lengths - threshold + 1, -1)
    inside = np.cumsum(inside[: len(at)], dtype=np.int8).astype(bool)
    new = np.ones(len(at) + 1, bool)
    new[1:-1] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])
    edge = np.flatnonzero(new)
    first, last = edge[:-1], edge[1:] - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    anchor = at[first]
    stretch = h.of(first, last + threshold) ^ _mix((anchor - first).astype(_U))
    text = np.searchsorted(begin, anchor, "right") - 1
    return rank[anchor], stretch, text, anchor - begin[text], first - begin[text], last - begin[text]


def _blocks(raws: list[bytes], threshold: int, block: int) -> Iterator[tuple[list[int], list[int], list[np.ndarray]]]:
    """Groups of texts, long ones cut so that each starting place is in one part: row numbers, offsets, bytes.

    A part also has the places around it that choosing anchors looks at, so that cuts don't change what is found: the
    strings of a part are those that start in it, each with its own bytes only.
    """
    rows, offsets, parts, size = [], [], [], 0
    for i, raw in enumerate(raws):
        if len(raw) < threshold:
            continue
        data = np.frombuffer(raw, np.uint8)
        for at in range(0, len(data) - threshold + 1, block):
            part = data[at : at + block + threshold - 1]
            if size and size + len(part) > block:
                yield rows, offsets, parts
                rows, offsets, parts, size = [], [], [], 0
            rows.append(i)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield rows, offsets, parts


def _raw(batch: pa.RecordBatch) -> list[bytes]:
    return [v.as_buffer().to_pybytes() if v.is_valid else b"" for v in batch.column("text")]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _ranks(docs: DataFrame, threshold: int, block: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for _, _, parts in _blocks(_raw(batch), threshold, block):
                rank, stretch = anchors(parts, threshold)[:2]
                yield pa.RecordBatch.from_arrays([_signed(rank), _signed(stretch)], names=["rank", "stretch"])

    return docs.select("text").mapInArrow(run, "rank long, stretch long")


def _places(docs: DataFrame, threshold: int, sieve, block: int) -> DataFrame:
    """Anchors whose rank is in the sketch, with their text and range of starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sieve.value
        for batch in slices(batches):
            for rows, offsets, parts in _blocks(_raw(batch), threshold, block):
                rank, stretch, text, anchor, first, last = anchors(parts, threshold)
                keep = in_sketch(words, rank)
                rank, stretch, text, anchor, first, last = (x[keep] for x in (rank, stretch, text, anchor, first, last))
                row, shift = pa.array(np.array(rows, np.int64)[text]), np.array(offsets, np.int64)[text]
                yield pa.RecordBatch.from_arrays(
                    [_signed(rank), _signed(stretch), batch.column("id").take(row), batch.column("sum").take(row)]
                    + [pa.array((x + shift).astype(np.int32)) for x in (anchor, first, last)],
                    names=["rank", "stretch", "id", "sum", "anchor", "first", "last"],
                )

    return docs.mapInArrow(run, "rank long, stretch long, id long, sum long, anchor int, first int, last int")


def _place_key(ids: np.ndarray, sums: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return _mix(_mix(ids.astype(np.int64).view(_U) ^ _mix(sums.astype(np.int64).view(_U))) ^ anchor.astype(_U))


def _place_keys(places: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = _place_key(*(b.column(c).to_numpy() for c in ("id", "sum", "anchor")))
            yield pa.RecordBatch.from_arrays([_signed(key)], names=["key"])

    return places.select("id", "sum", "anchor").mapInArrow(run, "key long")


def _stretches(docs: DataFrame, threshold: int, sieve, block: int) -> DataFrame:
    """Anchors whose place is in the sketch, with the bytes of their stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sieve.value
        for batch in slices(batches):
            ids, sums = batch.column("id").to_numpy(), batch.column("sum").to_numpy()
            raws = _raw(batch)
            for rows, offsets, parts in _blocks(raws, threshold, block):
                _, _, text, anchor, first, last = anchors(parts, threshold)
                row, shift = np.array(rows, np.int64)[text], np.array(offsets, np.int64)[text]
                keep = np.flatnonzero(in_sketch(words, _place_key(ids[row], sums[row], anchor + shift)))
                row, anchor, first, last = row[keep], (anchor + shift)[keep], (first + shift)[keep], (last + shift)[keep]
                held = [raws[r][a : b + threshold] for r, a, b in zip(row.tolist(), first.tolist(), last.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(sums[row]), pa.array(anchor.astype(np.int32)), pa.array(first.astype(np.int32)), pa.array(held, pa.binary())], names=["id", "sum", "anchor", "first", "held"])

    return docs.mapInArrow(run, "id long, sum long, anchor int, first int, held binary")


def _first_ranks(held: list[bytes], threshold: int) -> tuple[np.ndarray, ...]:
    """Of every position in the stretches that starts a string: whose it is, its place there, and three ranks.

    The ranks name the first quarter, the second quarter and the last half of the string.
    """
    quarter, half = -(-threshold // 4), -(-threshold // 2)
    data = np.frombuffer(b"".join(held), np.uint8)
    lengths = np.array([len(x) for x in held])
    counts = lengths - threshold + 1
    owner = np.repeat(np.arange(len(held)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(np.cumsum(lengths) - lengths, counts) + place
    h = Hasher(data)
    short, long = h.every(quarter), h.every(half)
    return owner, place, short[at], short[at + half - quarter], long[at + threshold - half]


def _named(stretches: DataFrame, threshold: int) -> DataFrame:
    """stretches (no, held) -> a row per position: no, place, rank and next (a quarter each), then (the last half)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "held", NAMED):
            if not part.num_rows:
                continue
            owner, place, a, b, c = _first_ranks(part.column("held").to_pylist(), threshold)
            yield pa.RecordBatch.from_arrays([part.column("no").take(pa.array(owner)), pa.array(place.astype(np.int32)), _signed(a), _signed(b), _signed(c)], names=["no", "place", "rank", "next", "then"])

    return stretches.select("no", "held").mapInArrow(run, "no long, place int, rank long, next long, then long")


_RERANKED = "part int, no long, place int, local long, again boolean, then long, edge struct<rank: long, next: long>"


def _rerank(positions: DataFrame) -> DataFrame:
    """positions (no, place, rank, next, then) -> no, place, rank, then of those whose pair (rank, next) isn't unique.

    The new rank is the pair's place among all different pairs in sorted order. A task streams its sorted rows and
    knows equal neighbours; it also passes on its first and last row with the pair, by which the driver adds up
    the tasks' counts and sees pairs that run on from one task to the next.
    """
    spark = positions.sparkSession
    order = ["rank", "next", "no", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: pa.Table | None = None  # the last row of the batch before, until its next neighbour is known
        before: tuple[int, int] | None = None
        local = 0
        for batch in _batches_and_end(batches):
            table = pa.Table.from_batches([batch]) if batch is not None and batch.num_rows else None
            if batch is not None and table is None:
                continue
            table = held if table is None else table if held is None else pa.concat_tables([held, table])
            if table is None:
                return
            rank, following = table["rank"].to_numpy(), table["next"].to_numpy()
            same = (rank[1:] == rank[:-1]) & (following[1:] == following[:-1])
            opens = before is None
            like_before = before is not None and before == (rank[0], following[0])
            numbers = local + np.cumsum(np.r_[not opens and not like_before, ~same])
            again = np.r_[like_before, same] | np.r_[same, False]
            ends = batch is None
            n = len(rank) if ends else len(rank) - 1
            edge = np.zeros(len(rank), bool)
            edge[0], edge[-1] = opens, ends
            if not ends:
                held, again[-1] = table.slice(n), False
            keep = np.flatnonzero((again | edge)[:n])
            if n:
                before, local = (rank[n - 1], following[n - 1]), int(numbers[n - 1])
            if len(keep):
                rows = table.take(pa.array(keep))
                pairs = pa.array([{"rank": r, "next": f} if e else None for r, f, e in zip(rank[keep].tolist(), following[keep].tolist(), edge[keep].tolist())], pa.struct([("rank", pa.int64()), ("next", pa.int64())]))
                columns = [pa.array(np.full(len(keep), part, np.int32)), rows["no"], rows["place"], pa.array(numbers[keep]), pa.array(again[keep]), rows["then"], pairs]
                yield from pa.table(columns, names=["part", "no", "place", "local", "again", "then", "edge"]).to_batches()

    sorted_ = positions.repartitionByRange(*order).sortWithinPartitions(*order)
    made = materialize(sorted_.mapInArrow(run, _RERANKED), "reranked")
    starts = spark.createDataFrame(_starts(made.filter("edge is not null").select("part", "local", "edge.rank", "edge.next", "again").collect()), "of int, start long, first_again boolean, last_again boolean, last long")
    rows = made.join(F.broadcast(starts), F.col("part") == F.col("of"))  # a row for each task of the sort
    again = F.col("again") | (F.col("first_again") & (F.col("local") == 0)) | (F.col("last_again") & (F.col("local") == F.col("last")))
    return rows.filter(again).select("no", "place", (F.col("start") + F.col("local")).alias("rank"), "then")


def _batches_and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _starts(edges: list) -> list[tuple]:
    """Of each task's first and last row: the rank at which its pairs start and whether its end pairs run on."""
    tasks: dict[int, list] = {}
    for e in sorted(edges, key=lambda e: (e["part"], e["local"])):
        tasks.setdefault(e["part"], []).append(e)
    out, start, last = [], 0, None
    pair = lambda e: (e["rank"], e["next"])
    for part in sorted(tasks):
        first, end = tasks[part][0], tasks[part][-1]
        runs_on = last is not None and last == pair(first)
        if runs_on:
            start -= 1
            out[-1][3] = True
        out.append([part, start, runs_on, False, end["local"]])
        start += end["local"] + 1
        last = pair(end)
    return [tuple(x) for x in out]


def _doubled(stretches: DataFrame, threshold: int) -> DataFrame:
    """stretches (no, held) -> no, place: positions whose string of `threshold` bytes some other position has too."""
    halves = _rerank(_named(stretches, threshold))
    whole = _rerank(halves.select("no", "place", "rank", F.col("then").alias("next"), F.lit(0).cast("long").alias("then")))
    return whole.select("no", "place")


def _runs(places: str) -> Column:
    """Sorted places -> the first and last of each run of neighbours."""
    first = F.filter(places, lambda x, i: (i == 0) | (F.get(places, i - 1) != x - 1))
    last = F.filter(places, lambda x, i: (i == F.size(places) - 1) | (F.get(places, i + 1) != x + 1))
    return F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), b.alias("last")))


def repeated_spans(docs: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """docs (id, sum, text) -> id, sum, begin, end: byte spans covered by strings of `threshold` bytes that recur."""
    spark = docs.sparkSession
    ranks = _ranks(docs, threshold, block).groupBy("rank").agg(F.count("*").alias("n"), (F.min("stretch") != F.max("stretch")).alias("mixed"))
    ranks = materialize(ranks.filter("n > 1").select("rank", "mixed"), "ranks")
    places = _places(docs, threshold, sketch(spark, ranks, "rank"), block)
    places = materialize(places.join(ranks, "rank"), "places")
    span = lambda rows: rows.select("id", "sum", F.col("first").alias("begin"), (F.col("last") + threshold).alias("end"))

    mixed = places.filter("mixed")
    one = F.min(F.struct("id", "sum", "anchor", "first")).alias("one")
    kinds = mixed.groupBy("rank", "stretch").agg(F.count("*").alias("n"), one).select("rank", "stretch", "n", "one.*")
    kinds = materialize(kinds, "kinds")
    # by place, which no two have in common: those of one kind, copies of a passage, would meet in one task
    copied = mixed.join(kinds.filter("n = 1"), ["id", "sum", "anchor", "first"], "left_anti")
    settled = span(places.filter("not mixed")).unionByName(span(copied))

    held = _stretches(docs, threshold, sketch(spark, _place_keys(kinds), "key"), block)
    known = kinds.select("id", "sum", "anchor", "first", "n").join(held, ["id", "sum", "anchor", "first"])
    stretches = materialize(known.select(F.monotonically_increasing_id().alias("no"), "id", "sum", "first", "n", "held"), "stretches")
    found = _doubled(stretches, threshold).groupBy("no").agg(F.sort_array(F.collect_list("place")).alias("places"))
    found = found.join(stretches.filter("n = 1").select("no", "id", "sum", "first"), "no").select("id", "sum", F.col("first").alias("at"), F.explode(_runs("places")).alias("run"))
    return settled.unionByName(found.select("id", "sum", (F.col("at") + F.col("run.first")).alias("begin"), (F.col("at") + F.col("run.last") + threshold).alias("end")))


def _keyed(docs: DataFrame) -> DataFrame:
    """id stands for a null doc_id too; sum tells rows apart that share an id but not a text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("sum"), text.alias("text"))


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, with_text: bool = False, block: int = BLOCK) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, and spans (and kept).

    Each text is taken as UTF-8 bytes. A byte goes if some string of `threshold` bytes that covers it also starts
    anywhere else, in the same text or another; strings never cross texts, and all are judged on the input. n_spans
    counts maximal removed runs. with_text adds kept, the remaining bytes. Null texts are empty; texts below the
    threshold stay whole; rows that repeat remove each other's strings like any copies, and rows that share an id are
    judged by their own texts. Empty tables give no rows; other columns are ignored.
    """
    keyed = _keyed(docs.select("doc_id", "text"))
    spans = repeated_spans(keyed.select("id", "sum", "text"), threshold, block)
    # a set, so that rows that share both id and text add up to one text's spans in whatever number they come
    by_text = spans.groupBy("id", "sum").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("spans"))
    by_text = materialize(by_text.select(F.col("id").alias("span_id"), F.col("sum").alias("span_sum"), "spans"), "spans")
    joined = keyed.join(by_text, (F.col("id") == F.col("span_id")) & (F.col("sum") == F.col("span_sum")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            numbers, digests, kept_texts, merged = [], [], [], []
            for raw, spans in zip(_raw(batch), batch.column("spans")):
                runs: list[list[int]] = []
                for begin, end in _pairs(spans):
                    if runs and begin <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], end)
                    else:
                        runs.append([begin, end])
                kept = raw
                if runs:
                    edges = [0, *(x for r in runs for x in r), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                numbers.append((len(raw), len(raw) - len(kept), len(runs)))
                digests.append(hashlib.sha256(kept).hexdigest())
                merged.append([{"begin": a, "end": b} for a, b in runs])
                if with_text:
                    kept_texts.append(kept)
            columns = [batch.column("doc_id"), *(pa.array([n[i] for n in numbers], pa.int64()) for i in range(3)), pa.array(digests, pa.string()), pa.array(merged, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept_texts, pa.binary())] * with_text, names=names + ["kept"] * with_text)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin: int, end: int>>"
    return joined.mapInArrow(run, schema + ", kept binary" * with_text)


def _pairs(spans: pa.Scalar) -> list[tuple[int, int]]:
    if not spans.is_valid:
        return []
    flat = spans.values.flatten()
    return list(zip(flat[0].to_pylist(), flat[1].to_pylist()))
