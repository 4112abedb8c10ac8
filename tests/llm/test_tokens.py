import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from zonarium.llm import tokens as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("high", [1, 2, 300, 50257, 1 << 33, 1 << 63])
def test_round_trip(high):
    rng = np.random.default_rng(high % 97)
    for n in (0, 1, 2, 59, 60, 61, 5000):
        ids = np.minimum(rng.integers(0, high, n, dtype=np.uint64), rng.integers(0, high, n, dtype=np.uint64) >> rng.integers(0, 40, n, dtype=np.uint64))
        words = T.pack(ids)
        assert len(words) <= 2 * n and (T.unpack(words, n) == ids).all()


def texts():
    rng = random.Random(1)
    bits = ["the", "The", "é", "straße", "don't", "it's", " ", "  ", "\n", "\t", "a.", ",", ".", "12", "x1", " ", "中文", "🙂", "é.", "…", "'s", "<|endoftext|>", "word.\nNext", "_", "　", "ﬁ.", "Êtaß", "naïve***", "%%%", "a&&b", "x²", "ª", "z'll-", "Nr.\nÜber-12", "\x1c", "²³", "ßé.,"]
    out = [None, "", " ", "  a", "a ", "a  b", "\n x", "a  b", "a  b", "<|endoftext|>", "x <|endoftext|> y"]
    return out + ["".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(60))) for _ in range(300)]


def test_encoder_equals_library():
    t = Tokenizer.from_file(PATH)
    e = T.Encoder(PATH, room=20)
    for x in texts():
        assert np.frombuffer(e.encode(x or ""), "<u4").tolist() == t.encode(x or "", add_special_tokens=False).ids, repr(x)


def test_texts_together_equal_library():
    """Texts encoded by their different words, in chunks of any size; a word of several parts is not remembered whole."""
    t = Tokenizer.from_file(PATH)
    all_ = [x or "" for x in texts()] + ["one two.\nThree, two.\nThree, größer, größer.\nÜber one", "", "same " * 500 + "end"]
    for limit in (1, 300, 1 << 23):
        e = T.Encoder(PATH, room=20)
        got = list(e.encode_many(all_, limit))
        assert [x.tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in all_]
    assert list(e.encode_many([])) == []
    e = T.Encoder(PATH)
    list(e.encode_many(["a one, two.\nThree one,"]))
    assert {"one", "two"} <= set(e.words) <= {"a", "one", "two"}


def test_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 128)
    t = Tokenizer.from_file(PATH)
    rows = [(i * 7 % 1009, x, 1) for i, x in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    manifest = T.write_shards(df, PATH, str(tmp_path), shard_bytes=3000)
    assert manifest.count() > 1
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in T.read_back(manifest).collect()}
    at = 0
    for d, x, _ in sorted(rows, key=lambda r: r[0]):
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        assert got.pop(d) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not got


def test_empty_and_repeated(spark):
    assert T.token_shards(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    df = spark.createDataFrame([(None, "b"), (3, "a b"), (3, "a"), (3, "a")], "doc_id long, text string")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in T.token_shards(df, PATH).collect())
    assert got == [(0, None, 2), (2, 3, 2), (4, 3, 2), (6, 3, 3)]
