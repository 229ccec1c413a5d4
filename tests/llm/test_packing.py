import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from assayflow.llm import packing
from assayflow.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def path():
    return tokenizer_path()


@pytest.fixture(scope="module")
def reference(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


TEXTS = ["Hello, World!! it's 42 o'clock", "", None, "naïve ÀÉ éx", "a b\tc\x1cd\nE", "''s 'll don't", "日本語 text", "x" * 3000, "İstanbul ΣΑΣ ß", "<|endoftext|> a<|endoftext|>b", "%%% *** word&&& $$$", "12345 6.7e8", "́ lone ​ zero", "End. Stop, ok.. hm., a.b c, ,d É, x.\ny,\n", "<|ENDOFTEXT|> Up. E\u0301 I\u0307 K. ﬀ, ǅ."]


def test_word_ids_equal_the_tokenizers(path, reference):
    ids = packing.WordIds(path)
    got = ids.texts([(t or "").encode() for t in TEXTS] * 2)
    for t, raw in zip(TEXTS * 2, got):
        assert np.frombuffer(raw, "<u4").tolist() == reference(t)[:-1], t


def test_forgetting_words_changes_nothing(path, reference, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    ids = packing.WordIds(path)
    for t in TEXTS:
        assert np.frombuffer(ids.texts([(t or "").encode()])[0], "<u4").tolist() == reference(t)[:-1]


def test_words_that_recur_are_kept_while_others_go(path, reference, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    ids, learnt = packing.WordIds(path), []
    learn = ids._learn
    ids._learn = lambda new: (learnt.extend(new), learn(new))
    for k in range(40):
        text = "the common cat " + " ".join(f"word{20 * k + i}x" for i in range(20))
        assert np.frombuffer(ids.texts([text.encode()])[0], "<u4").tolist() == reference(text)[:-1]
        assert len(ids.words.keys() | ids.older.keys()) <= 2 * (50 + 24)
    assert [learnt.count(w) for w in (b"the", b"common", b"cat", b"word0x")] == [1, 1, 1, 1]


def test_a_word_is_looked_up_once_in_a_slice(path, reference):
    class Counted(dict):
        looked_up = 0

        def __getitem__(self, key):
            self.looked_up += 1
            return super().__getitem__(key)

        def get(self, key, default=None):
            self.looked_up += 1
            return super().get(key, default)

    ids = packing.WordIds(path)
    ids.words = Counted(ids.words)
    texts = ["the cat, the dog and the cat.\nThe end. " * 500, "", "the end " * 300]
    got = ids.texts([t.encode() for t in texts])
    assert [np.frombuffer(raw, "<u4").tolist() for raw in got] == [reference(t)[:-1] for t in texts]
    assert ids.words.looked_up <= 40
    assert ids.texts([]) == []


def test_pieces_and_sequences(spark, path, reference):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice(["tion", "word,", "é", "the"]) for _ in range(rng.randint(0, 90))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "null id", 2), (3, texts[3], 1)], "doc_id long, text string, length int")
    rows = packing.pack_documents(docs, path, capacity=32, open_bins=8).collect()
    want = []
    for i, t in [*enumerate(texts), (None, "null id"), (3, texts[3])]:
        e = reference(t)
        want += [(i, k // 32, k, len(e[k : k + 32]), zlib.crc32(np.array(e[k : k + 32], "<u4").tobytes())) for k in range(0, len(e), 32)]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 32
    assert len(held) <= 1.15 * sum(r.length for r in rows) / 32 + 4


def test_best_fit_and_the_fullest_closes_first():
    bins = packing.OpenBins(10, 2)
    assert [bins.put(x) for x in (6, 7)] == [(0, 0), (1, 0)]
    assert bins.put(3) == (1, 7)  # the least space that holds it; the bin is full and closes
    assert bins.put(8) == (2, 0)  # open: 0 (4 free), 2 (2 free)
    assert bins.put(9) == (3, 0)  # bin 2 was the fullest and closed
    assert bins.put(2) == (0, 6) and bins.put(1) == (3, 9)


def test_empty_table(spark, path):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0
