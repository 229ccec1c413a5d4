"""A linear softmax over averaged subword embeddings, embeddings and softmax trained jointly in numpy.

A word's vector is the mean of its character n-grams' vectors (hashed to buckets), so a misspelling that was never
seen shares most of them with the word that was. A stretch of STRETCH neighbouring words, wherever it starts, has the
mean of its words' vectors; what a stretch lacks in a short text counts as words of no weight, so that one word weighs
the same in any text. A document is as toxic as its worst stretch, so that length does not dilute a few words.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

import numpy as np

#: A-Z become a-z; what is no letter, digit or part of a multi-byte character parts words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BUCKETS = 1 << 18
WIDTH = 8
SIZES = (3, 4, 5, 6)
STRETCH = 2
REMEMBERED = 400_000


def words(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_WORDS).split()


def grams(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all words, blanks marking word ends, and which word each belongs to."""
    line = np.frombuffer(b" " + b" ".join(vocabulary) + b" ", np.uint8).astype(np.uint32)
    blank = line == 32
    owner = np.cumsum(blank, dtype=np.int32) - 1
    buckets, owners = [], []
    code = line.copy()
    for n in range(2, max(SIZES) + 1):
        if len(line) < n:
            break
        code = code[: len(line) - n + 1] * np.uint32(0x01000193) ^ line[n - 1 :]
        inner = np.cumsum(blank, dtype=np.int32)
        clean = inner[n - 2 : len(line) - 1] - inner[: len(line) - n + 1] == 0 if n > 2 else np.ones(len(code), bool)
        if n in SIZES:
            at = np.flatnonzero(clean & ~(blank[: len(code)] & blank[n - 1 :] & (n <= 2)))
            mixed = code[at] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            buckets.append(((mixed ^ (mixed >> np.uint32(13))) % np.uint32(BUCKETS)).astype(np.int32))
            owners.append(owner[at])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(buckets), np.concatenate(owners)


def stretches(scores: np.ndarray) -> np.ndarray:
    """Mean scores of all stretches of a text's words, from running sums."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    size = min(STRETCH, len(scores))
    return (sums[size:] - sums[:-size]) / STRETCH


@dataclass
class SubwordModel:
    gram_scores: np.ndarray  # log-odds that each bucket's vector gives
    bias: float
    _known: dict[bytes, float] = field(default_factory=dict, repr=False)

    @classmethod
    def of(cls, at: list[int], score: list[float], bias: float) -> SubwordModel:
        scores = np.zeros(BUCKETS)
        scores[at] = score
        return cls(scores, bias)

    def word_scores(self, vocabulary: list[bytes]) -> np.ndarray:
        buckets, owners = grams(vocabulary)
        n = np.bincount(owners, minlength=len(vocabulary))
        return np.bincount(owners, self.gram_scores[buckets], len(vocabulary)) / np.maximum(n, 1)

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """A probability for each text; one without words has that of the bias alone."""
        split = [words(t) for t in texts]
        if len(self._known) > REMEMBERED:
            self._known.clear()
        new = list({w for seq in split for w in seq if w not in self._known})
        self._known.update(zip(new, self.word_scores(new).tolist()) if new else ())
        known = self._known
        worst = np.zeros(len(texts))
        for i, seq in enumerate(split):
            if seq:
                worst[i] = stretches(np.fromiter((known[w] for w in seq), float, len(seq))).max()
        return 1 / (1 + np.exp(-np.clip(worst + self.bias, -30, 30)))


def _evidence(y: np.ndarray, split: list[np.ndarray], n_words: int, buckets: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How strongly each bucket's n-grams point to label 1 (shrunk log-odds), and in how many word uses they occur."""
    uses = np.zeros((2, n_words))
    for label, seq in zip(y.tolist(), split):
        uses[label, np.unique(seq)] += 1
    seen = np.stack([np.bincount(owners_of, uses[k][owners], BUCKETS) for k, owners_of in ((0, buckets), (1, buckets))])
    share = seen.sum(1) / seen.sum()
    expected = 2 * share[:, None] + 1e-9
    odds = np.log((seen[1] + expected[1]) / (seen[1].sum() + 1)) - np.log((seen[0] + expected[0]) / (seen[0].sum() + 1))
    z2 = odds**2 / (1 / (seen[1] + expected[1]) + 1 / (seen[0] + expected[0]))
    return odds * z2 / (z2 + 9), seen.sum(0)


def _different(texts: list[str | None], y: np.ndarray) -> tuple[list[str | None], np.ndarray]:
    """Each text once, with its first label: copies would make the words of one text look telling."""
    first: dict[bytes, int] = {}
    for i, text in enumerate(texts):
        first.setdefault(b" ".join(words(text)), i)
    at = list(first.values())
    return [texts[i] for i in at], y[at]


def misspelt(word: bytes, rng: random.Random) -> bytes:
    """The word with one inner letter doubled, left out, swapped with the next or replaced; short words stay."""
    if len(word) < 4:
        return word
    i, how = rng.randrange(1, len(word) - 1), rng.randrange(4)
    if how == 0:
        return word[: i + 1] + word[i:]
    if how == 1:
        return word[:i] + word[i + 1 :]
    if how == 2:
        return word[:i] + word[i + 1 : i + 2] + word[i : i + 1] + word[i + 2 :]
    return word[:i] + rng.choice([b"a", b"e", b"i", b"o", b"u", b"0", b"1", b"3"]) + word[i + 1 :]


def train(texts: list[str | None], labels: np.ndarray, rounds: int = 8, batch: int = 64, rate: float = 0.1, least_uses: int = 3, misspell: float = 0.8, seed: int = 7, start: float = 1.0) -> SubwordModel:
    """Each round finds every document's worst stretch under the model so far and steps on them.

    The first embedding dimension starts from `start` times the n-grams' shrunk log-odds, so the first stretches are chosen well;
    n-grams of fewer than least_uses word uses keep a zero vector, since they could only be learnt by heart. Every
    document is learnt from a second time with a share of its words misspelt, whatever its label. Without both labels
    the model is a constant: the share of label 1, pulled towards a half. Texts that repeat are learnt from once.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.int64)
    prior = (y.sum() + 1) / (len(y) + 2)
    flat = SubwordModel(np.zeros(BUCKETS), float(np.log(prior / (1 - prior))))
    if len(set(y.tolist())) < 2:
        return flat
    texts, y = _different(texts, y)
    if len(set(y.tolist())) < 2:
        return flat
    spell, number, split = random.Random(seed), {}, []
    for copy in (0, 1) if misspell else (0,):
        for text in texts:
            seq = words(text)
            if copy:
                seq = [misspelt(w, spell) if spell.random() < misspell else w for w in seq]
            split.append(np.fromiter((number.setdefault(w, len(number)) for w in seq), np.int32, len(seq)))
        y = y if copy == 0 else np.concatenate([y, y])
    if not number:
        return flat
    ids = np.concatenate(split)
    buckets, owners = grams(list(number))
    order = np.argsort(owners, kind="stable")
    buckets, owners = buckets[order], owners[order]
    del order
    n_grams = np.bincount(owners, minlength=len(number))
    gram_begin = np.cumsum(n_grams) - n_grams
    lengths = np.array([len(seq) for seq in split])
    step = max(1, STRETCH // 2)
    n_stretches = np.where(lengths > 0, -(-np.maximum(1, lengths - step) // step), 0)
    doc = np.repeat(np.arange(len(split), dtype=np.int32), n_stretches)
    inner = np.arange(len(doc)) - np.repeat(np.cumsum(n_stretches) - n_stretches, n_stretches)
    text_begin = np.cumsum(lengths) - lengths
    opens = (text_begin[doc] + step * inner).astype(np.int32)
    closes = np.minimum(opens + STRETCH, (text_begin + lengths)[doc]).astype(np.int32)
    del inner
    evidence, seen = _evidence(y, split, len(number), buckets, owners)
    free = seen >= least_uses
    embed = (rng.uniform(-0.1 / WIDTH, 0.1 / WIDTH, (BUCKETS, WIDTH)) * free[:, None]).astype(np.float32)
    embed[:, 0] += start * evidence * free
    weights, bias = (rng.normal(size=(WIDTH, 2))).astype(np.float32), np.zeros(2, np.float32)
    weights[0] = -10, 10
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (weights, bias)]
    step = 0
    for turn in range(rounds):
        gram_scores = embed @ (weights[:, 1] - weights[:, 0])
        word_scores = np.bincount(owners, gram_scores[buckets], len(number)) / np.maximum(n_grams, 1)
        sums = np.concatenate([[0.0], np.cumsum(word_scores[ids])])
        worst = (sums[closes] - sums[opens]) / STRETCH
        if turn == 0:
            top = np.full(len(y), -np.inf)
            np.maximum.at(top, doc, worst)
            bias[1] = -np.quantile(top[np.isfinite(top)], 1 - prior)
        by_doc = np.lexsort((-worst, doc))
        rank = np.arange(len(doc)) - np.searchsorted(doc[by_doc], doc[by_doc])
        chosen = rng.permutation(by_doc[(rank == 0) | ((rank < 3) & (y[doc[by_doc]] == 0))])
        for first in range(0, len(chosen), batch):
            some = chosen[first : first + batch]
            size = (closes[some] - opens[some]).astype(np.int64)
            seg = np.repeat(np.arange(len(some)), size)
            word = ids[np.repeat(opens[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            n = n_grams[word]
            gram = buckets[np.repeat(gram_begin[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            share = np.repeat(1 / np.maximum(n, 1) / STRETCH, n).astype(np.float32)
            row = np.repeat(seg, n)
            begin = np.searchsorted(row, np.arange(len(some)))
            hidden = np.add.reduceat(embed[gram] * share[:, None], begin)
            logits = hidden @ weights + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[doc[some]]] -= 1
            p /= len(some)
            back = p @ weights.T
            touched, place = np.unique(gram, return_inverse=True)
            pull = np.stack([np.bincount(place, share * back[row, k], len(touched)) for k in range(WIDTH)], 1).astype(np.float32)
            embed[touched] -= rate * len(some) * pull * free[touched, None]
            step += 1
            for value, (m, v), grad in ((weights, state[0], hidden.T @ p), (bias, state[1], p.sum(0))):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad**2 - v)
                value -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return SubwordModel((embed @ (weights[:, 1] - weights[:, 0])).astype(np.float64), float(bias[1] - bias[0]))
