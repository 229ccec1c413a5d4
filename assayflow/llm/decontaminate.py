"""Benchmark decontamination: Aho-Corasick automata over test items' word windows; each text is read once.

A benchmark of up to SHARD_BYTES is one automaton. A larger one is dealt over several of that size, since an automaton
takes some hundred times its text in memory; the plan is the same: one pass over the texts, in which a task runs the
automata over its texts one after another. The driver never holds more than one shard's items.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

WINDOW = 13
#: Bytes of benchmark text in one automaton. A larger benchmark is dealt over several automata, each about this.
SHARD_BYTES = 4_000_000
#: Bytes of text that a task takes through all automata before it reads on; with several, each is built anew for these.
SCANNED = 1 << 26
#: The same where one automaton holds the whole benchmark.
SLICE = 1 << 21
#: Characters that are no part of a word become a space, A-Z become a-z; bytes of multi-byte characters stay.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TOKEN = re.compile(rb"[^ ]+")

Item = tuple[str | None, str]
Built = tuple[dict[bytes, int], ahocorasick.Automaton | None]
_BUILT: dict[str, Built] = {}


def words(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_WORDS).split()


def build(items: list[Item], window: int) -> Built:
    """Word numbers from 1 and the automaton over the windows, each holding (words, numbers of its items)."""
    numbers: dict[bytes, int] = {}
    windows: dict[tuple[int, ...], set[int]] = {}
    for i, (_, text) in enumerate(items):
        seq = tuple(numbers.setdefault(w, len(numbers) + 1) for w in words(text))
        for at in range(max(1, len(seq) - window + 1)) if seq else ():
            windows.setdefault(seq[at : at + window], set()).add(i)
    if not windows:
        return numbers, None
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for seq, found in windows.items():
        automaton.add_word(seq, (len(seq), tuple(found)))
    automaton.make_automaton()
    return numbers, automaton


class Shards:
    """A benchmark's items in broadcasts of bounded size, and their automata in the task that asks for them."""

    def __init__(self, parts: list[Broadcast], window: int) -> None:
        self.parts, self.window = parts, window

    @property
    def scanned(self) -> int:
        """Bytes of text whose words a task holds at once: few, unless automata are built anew for each lot."""
        return SCANNED if len(self.parts) > 1 else SLICE

    def built(self, k: int) -> tuple[list[Item], Built]:
        """The kth shard's items and automaton. A worker keeps the last one that it built."""
        items = self.parts[k].value
        key = hashlib.md5(repr((self.window, items)).encode()).hexdigest()
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = build(items, self.window)
        return items, _BUILT[key]

    def scan(self, texts: list[list[bytes]]) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
        """Of each text's words: merged spans that windows of any shard cover, and the ids of the items found."""
        covered: list[list[tuple[int, int]]] = [[] for _ in texts]
        ids: list[set[str]] = [set() for _ in texts]
        for k in range(len(self.parts)):
            items, built = self.built(k)
            for i, seq in enumerate(texts):
                hits, found = spans(seq, built)
                covered[i] = merged(covered[i] + hits) if covered[i] and hits else covered[i] or hits
                ids[i].update(items[j][0] for j in found if items[j][0] is not None)
        return covered, ids


def merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(hits):
        if out and out[-1][1] >= first:
            out[-1] = out[-1][0], max(out[-1][1], last)
        else:
            out.append((first, last))
    return out


def spans(seq: list[bytes], built: Built) -> tuple[list[tuple[int, int]], set[int]]:
    """Merged [first, last) word spans covered by windows, and the numbers of the items found."""
    numbers, automaton = built
    found: set[int] = set()
    if automaton is None or not seq:
        return [], found
    get = numbers.get
    joined: list[list[int]] = []
    for end, (size, items) in automaton.iter(tuple([get(w, 0) for w in seq])):
        found.update(items)
        first = end + 1 - size
        while joined and joined[-1][1] >= first:
            first = min(first, joined.pop()[0])
        joined.append([first, end + 1])
    return [(a, b) for a, b in joined], found


_SCAN = "n_words long, spans array<struct<first: long, last: long>>, items array<string>, chars array<struct<first: long, last: long>>"
_PAIRS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _raw(value: pa.Scalar) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def _scan(docs: DataFrame, shards: Shards) -> DataFrame:
    """docs (doc_id, text) with n_words, word spans, the same spans in characters of the text as given, and item ids."""
    schema = pa.schema([("doc_id", docs_type(docs)), ("n_words", pa.int64()), ("spans", _PAIRS), ("items", pa.list_(pa.string())), ("chars", _PAIRS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=shards.scanned):
            flat = [_raw(v).translate(_WORDS) for v in batch.column("text")]
            texts = [f.split() for f in flat]
            covered, ids = shards.scan(texts)
            chars = [_in_characters(_raw(v), f, hits) if hits else [] for v, f, hits in zip(batch.column("text"), flat, covered)]
            pairs = lambda x: pa.array([[{"first": a, "last": b} for a, b in s] for s in x], _PAIRS)
            columns = [pa.array([len(t) for t in texts], pa.int64()), pairs(covered), pa.array([sorted(i) for i in ids], pa.list_(pa.string())), pairs(chars)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], schema=schema)

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_SCAN}")


def docs_type(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)


def _in_characters(raw: bytes, flat: bytes, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    places = [m.span() for m in _TOKEN.finditer(flat)]
    lead = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # characters begun up to and with each byte
    return [(int(lead[places[a][0]]) - 1, int(lead[places[b - 1][1] - 1])) for a, b in hits]


def shards_of(benchmark: DataFrame, window: int, shard_bytes: int, nameless: bool) -> Shards:
    """The items, read to the driver and broadcast a bounded shard at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    items = items if nameless else items.filter("item_id is not null")
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = int(total // shard_bytes) + 1
    parts = []
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()  # about shard_bytes
        parts.append(spark.sparkContext.broadcast(sorted(((r.item_id, r.text) for r in rows), key=lambda x: (x[0] is None, x[0] or "", x[1]))))
    return Shards(parts, window)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, nameless: bool = False) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, chars.

    Words are lower-cased runs of letters, digits and characters beyond ASCII. An item's windows are its runs of
    `window` words; an item of fewer words, but not none, is one window. A word inside any occurrence is hit.
    contaminated: n_hit > 0 and 20 * n_hit >= n_words. spans are hit words, chars the same places in the text as it
    was given. Null and empty texts have no words; items that are null or have no words match nothing; items that
    repeat an item_id count once. An item without an item_id is ignored, unless `nameless`: then the words of its
    windows are hit as any other's, and only n_items and items_sha256 leave it out. Rows that repeat are scanned each.
    Other columns are ignored. Texts never leave their task, for a benchmark of any size.
    """
    found = _scan(docs.select("doc_id", "text"), shards_of(benchmark, window, shard_bytes, nameless))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["last"] - s["first"])
    found = found.withColumn("n_hit", n_hit)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "spans", "chars",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, nameless: bool = False) -> DataFrame:
    """docs with all its columns, without rows that decontaminate() marks; filtered where they are read."""
    shards = shards_of(benchmark, window, shard_bytes, nameless)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=shards.scanned):
            texts = [words(_raw(v)) for v in batch.column("text")]
            hit = [sum(b - a for a, b in hits) for hits in shards.scan(texts)[0]]
            yield batch.filter(pa.array([not (n and 20 * n >= len(t)) for n, t in zip(hit, texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
