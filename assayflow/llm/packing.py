"""Best-fit packing: token pieces go online into a bounded number of open bins, kept in a bitset keyed by free space."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

CAPACITY = 4096
END_ID = 1
#: Bins that one shard keeps open. Pieces arrive longest first, so this many long ones wait for short ones.
OPEN_BINS = 4096
#: Pieces that one shard packs on average. A shard leaves less than one bin's space unused beyond what best fit does.
SHARD_PIECES = 16_384
#: Bytes of text in which each different word is looked up once.
SLICE = 1 << 22
#: Words whose ids a Python worker remembers in each of two generations, beyond a slice's; some 200 bytes each.
REMEMBERED = 200_000

_LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿ"
#: Of such a word the tokenizer makes one piece from the letters and one from the signs, whatever stands around it.
_PLAIN = re.compile(f"([{_LETTERS}]*)([.,;:!?%&$#*|]*)")


#: A point or comma between a letter and white space is a piece of its own, so that a blank before it changes no ids.
_STOP = re.compile(rb"(?<=[a-z])([.,])(?=[ \n])")


def _loosened(text: bytes) -> bytes:
    """Fewer different words with the same ids: A-Z in lower case, stops apart; what may be a special token stays."""
    return text if b"<|" in text else _STOP.sub(rb" \1", text.lower())


class WordIds:
    """Token ids of white-space separated words as little-endian uint32 bytes, remembered by word.

    The tokenizer drops white space and never joins across it, so a text's ids are its words' ids in order. New plain
    words are lower-cased, cut into letters and signs, and sent through the tokenizer's merges many at a time, told
    apart by the end-of-word tokens; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole, self.merges = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {b"": b""}
        self.older: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}

    def texts(self, texts: list[bytes]) -> list[bytes]:
        """Each different word is looked up once; Arrow numbers the words and numpy lays their ids end to end."""
        split = pc.split_pattern(pa.array([_loosened(t).replace(b"\n", b" ") for t in texts], pa.large_binary()), " ")
        coded = split.flatten().dictionary_encode()
        different = coded.dictionary.to_pylist()
        if len(self.words) > REMEMBERED:
            # words that occur again are taken over, so that frequent ones are never learnt anew
            self.older, self.words = self.words, {b"": b""}
        own = list(map(self.words.get, different))
        new = []
        for i in [i for i, x in enumerate(own) if x is None]:
            if (known := self.older.get(different[i])) is None:
                new.append(i)
            else:
                own[i] = self.words[different[i]] = known
        self._learn([different[i] for i in new])
        for i in new:
            own[i] = self.words[different[i]]
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        word = coded.indices.to_numpy()
        lengths = sizes[word]
        ends = np.r_[0, np.cumsum(lengths)]
        at = np.repeat((np.cumsum(sizes) - sizes)[word] - ends[:-1], lengths)
        at += np.arange(len(at))
        raw = np.frombuffer(b"".join(own), "<u4")[at].tobytes()
        edges = (4 * ends[split.offsets.to_numpy()]).tolist()
        return [raw[a:b] for a, b in zip(edges, edges[1:])]

    def _learn(self, new: list[bytes]) -> None:
        letters, signed, other = [], [], []
        match = _PLAIN.fullmatch
        for raw in new:
            if raw.isalpha():
                letters.append(raw)
            elif m := match(word := raw.decode()):
                signed.append((raw, m[1].lower(), m[2]))
            else:
                other.append((raw, word))
        if len(self.parts) > REMEMBERED:
            self.parts = {"": b""}
        low = [w.decode().lower() for w in letters]
        self._parts({*low, *(x for _, a, b in signed for x in (a, b))} - self.parts.keys())
        parts = self.parts
        self.words.update(zip(letters, map(parts.__getitem__, low)))
        self.words.update((raw, parts[a] + parts[b]) for raw, a, b in signed)
        for (raw, _), e in zip(other, self.whole.encode_batch([word for _, word in other], add_special_tokens=False)):
            self.words[raw] = np.array(e.ids, "<u4").tobytes()

    def _parts(self, new: set[str]) -> None:
        parts = list(new)
        for at in range(0, len(parts), 4096):
            some = parts[at : at + 4096]
            ids = np.array(self.merges.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):
                raise ValueError("the tokenizer does not mark the end of each word")
            raw, first = ids.tobytes(), 0
            for part, stop in zip(some, (stops * 4).tolist()):
                self.parts[part] = raw[first:stop]
                first = stop


_WORD_IDS: dict[str, WordIds] = {}
_PIECES = ["piece", "start", "length", "ids_crc32"]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """docs (doc_id, text) -> doc_id, piece, start, length, ids_crc32. tokenizer: a tokenizers JSON file on every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _WORD_IDS.setdefault(tokenizer, WordIds(tokenizer)) if tokenizer not in _WORD_IDS else _WORD_IDS[tokenizer]
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in slices(batches, most=SLICE):
            rows, out = [], []
            for i, raw in enumerate(ids_of.texts([v.as_buffer().to_pybytes() if v.is_valid else b"" for v in batch.column("text")])):
                raw += end
                for k, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    rows.append(i)
                    out.append((k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = [pa.array([x[j] for x in out], pa.int32() if j == 0 else pa.int64()) for j in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), *columns], names=["doc_id", *_PIECES])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """At most `most` open bins. Bit f of `free` is set while some open bin has f tokens free; full ones are closed."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most, self.free, self.open, self.made = capacity, most, 0, 0, 0
        self.bins: dict[int, list[int]] = {}

    def _take(self, space: int) -> int:
        at = self.bins[space].pop()
        if not self.bins[space]:
            self.free &= ~(1 << space)
        self.open -= 1
        return at

    def put(self, length: int) -> tuple[int, int]:
        """The bin with the least space that holds length, else a new one; (bin, offset)."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            at = self._take(space)
        else:
            space, at = self.capacity, self.made
            self.made += 1
        left = space - length
        if left:
            if self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            self.bins.setdefault(left, []).append(at)
            self.free |= 1 << left
            self.open += 1
        return at, self.capacity - space


def pack(cut: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces. cut must be a stored table: it is read more than once."""
    n = max(2, -(-cut.count() // shard_pieces))
    whole = F.col("length") >= capacity
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(n)).cast("long")).repartition(n, "shard")
    dealt = dealt.withColumn("whole", whole).sortWithinPartitions("shard", F.desc("length"), "doc_id", "piece", "ids_crc32")
    names = ["doc_id", *_PIECES]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, bins = None, OpenBins(capacity, open_bins)
        for frame in frames:
            places = []
            for own, length in zip(frame["shard"].tolist(), frame["length"].tolist()):
                if own != shard:
                    shard, bins = own, OpenBins(capacity, open_bins)
                at, offset = bins.put(length)
                places.append(((own << 40) | at, offset))
            out = frame[names].copy()
            out["sequence_id"], out["offset"] = [p[0] for p in places], [p[1] for p in places]
            yield out

    schema = f"doc_id {cut.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.mapInPandas(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, open_bins: int = OPEN_BINS) -> DataFrame:
    """docs (doc_id, text) packed into sequences of at most `capacity` tokens, a row per piece.

    A document is its token ids, then end_id; only longer ones are cut, into pieces of `capacity`, the last shorter.
    Columns: doc_id, piece (from 0), start (ids of the document before it), length, ids_crc32 (of the little-endian
    unsigned 32-bit ids), sequence_id, offset (gapless from 0). Null and empty texts are the single end_id. Pieces are
    dealt by hash to shards of equal load; each packs its own bins, longest first, ties by doc_id. Rows that repeat
    are packed each. A null doc_id is kept as null. An empty table gives no rows; other columns are ignored.
    """
    return pack(materialize(pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity, open_bins)
