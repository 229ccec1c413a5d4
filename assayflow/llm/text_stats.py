"""Statistics of a document's characters, words and lines, as inputs of a quality score."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np

_CLASSES = np.full(256, 7, np.int64)  # 0 lower, 1 upper, 2 digit, 3 blank, 4 line end, 5 sentence sign, 6 beyond ASCII, 7 other sign
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:'\"()-?")):
    _CLASSES[list(_bytes)] = _k
_CLASSES[128:] = 6

NAMES = [
    "lower", "upper", "digit", "blank", "line_end", "sentence_sign", "beyond_ascii", "other_sign", "exclaim", "bar",
    "log_bytes", "log_words", "log_lines", "word_length", "word_spread", "distinct_words", "top_word", "repeated_triples",
    "repeated_lines", "line_words", "words_with_signs", "squeezed", "longest_line", "stutter",
]


def stats(text: str | None) -> np.ndarray:
    """A vector in the order of NAMES; an empty text has zeros."""
    raw = (text or "").encode()
    out = np.zeros(len(NAMES))
    n = len(raw)
    if not n:
        return out
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    out[:8] = np.bincount(_CLASSES, seen, 8) / n
    out[8], out[9] = seen[33] / n, seen[124] / n
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    out[10], out[11], out[12] = np.log1p(n), np.log1p(len(words)), np.log1p(len(lines))
    out[13], out[14] = lengths.mean(), lengths.std()
    counts = Counter(words)
    out[15] = len(counts) / w
    out[16] = max(counts.values(), default=0) / w
    if len(words) > 3:
        triples = len(words) - 2
        out[17] = 1 - len(set(zip(words, words[1:], words[2:]))) / triples
    if lines:
        out[18] = 1 - len(set(lines)) / len(lines)
        out[22] = np.log1p(max(map(len, lines)))
    out[19] = np.log1p(len(words) / max(1, len(lines)))
    out[20] = sum(1 for x in words if not x[-1:].isalnum() and x[-1] < 128) / w
    out[21] = len(zlib.compress(raw, 1)) / n
    out[23] = sum(map(bytes.__eq__, words, words[1:])) / w
    return out
