"""Token-id shards in a Simple-8b file format.

All numbers of a file are little-endian:

    b"ZNS8B\\x001\\n" | words of all blocks | block table | document table | tail
    block table:    per block: first word (u64), number of words (u32), number of ids (u32)
    document table: three arrays: doc_ids (i64), 1 where doc_id is null (u8), numbers of ids (u64)
    tail:           number of blocks, number of documents, offset of the block table (3 x u64)

A word's top four bits select how many ids of how many bits the other sixty hold; selector 15 is the escape: the next
word holds one id of up to 64 bits whole. A block holds up to BLOCK ids and starts at a word, so any block can be
decoded alone, all words of one selector at a time.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MAGIC = b"ZNS8B\x001\n"
BLOCK = 1 << 16
#: Bytes of texts whose words are looked up together.
CHUNK = 1 << 23
#: (ids in a word, bits of each) by selector; 15 is the escape.
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15
#: Bits of small ids.
_SIZES = np.frexp(np.arange(1 << 16, dtype=float))[1].astype(np.int8)
_BLOCKS = np.dtype([("word", "<u8"), ("words", "<u4"), ("ids", "<u4")])


def pack(ids: np.ndarray) -> np.ndarray:
    """The words of one block: each takes as many ids as its selector's width allows, a short last word is filled with zeros."""
    v = np.ascontiguousarray(ids, C.U64)
    n = len(v)
    if not n:
        return np.zeros(0, C.U64)
    chosen = np.full(n, ESCAPE, np.int8)
    if v.max() < len(_SIZES):
        size = _SIZES[v]
    else:
        # Bits of each id; frexp is exact up to 2**53 and rounds only what no selector but the widest could hold.
        size = np.frexp(v.astype(float))[1].astype(np.int8)
        size[(v >> C.U64(53)) != 0] = 60
        size[(v >> C.U64(60)) != 0] = 64
    most = int(size.max())
    for s in range(len(SELECTORS) - 1, -1, -1):
        count, bits = SELECTORS[s]
        if most <= bits:
            chosen[:] = s
            continue
        # Places from which `count` ids in a row are narrow enough; beyond the end all are.
        narrow = np.flatnonzero(size <= bits)
        narrow = np.concatenate([narrow, np.arange(n, n + count - 1)])
        starts = narrow[: len(narrow) - count + 1]
        starts = starts[narrow[count - 1 :] - starts == count - 1]
        if not len(starts):
            break
        chosen[starts] = s
    takes = np.array([c for c, _ in SELECTORS] + [0, 1])[chosen].tolist()
    at, starts = 0, []
    while at < n:
        starts.append(at)
        at += takes[at]
    start = np.array(starts)
    sel = chosen[start]
    where = np.arange(len(start)) + np.concatenate(([0], np.cumsum(sel == ESCAPE)[:-1]))
    words = np.zeros(len(start) + int((sel == ESCAPE).sum()), C.U64)
    padded = np.concatenate([v, np.zeros(64, C.U64)])
    for s in np.unique(sel).tolist():
        a, w = start[sel == s], where[sel == s]
        words[w] = C.U64(s) << C.U64(60)
        if s == ESCAPE:
            words[w + 1] = v[a]
            continue
        count, bits = SELECTORS[s]
        for k in range(count):
            words[w] |= padded[a + k] << C.U64(k * bits)
    return words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a block."""
    sel = (words >> C.U64(60)).astype(np.int64)
    if (sel == ESCAPE).any():
        # A word after an escape is data, whatever its top bits say.
        data = np.zeros(len(words), bool)
        for i in np.flatnonzero(sel == ESCAPE).tolist():
            if not data[i]:
                data[i + 1] = True
        where = np.flatnonzero(~data)
        sel = sel[where]
    else:
        where = np.arange(len(words))
    takes = np.array([c for c, _ in SELECTORS] + [0, 1])[sel]
    end = np.cumsum(takes)
    out = np.zeros(int(end[-1]) + 1 if len(end) else 1, C.U64)
    for s in np.unique(sel).tolist():
        at, w = (end - takes)[sel == s], where[sel == s]
        if s == ESCAPE:
            out[at] = words[w + 1]
            continue
        count, bits = SELECTORS[s]
        mask = C.U64((1 << bits) - 1)
        for k in range(count):
            out[at + k] = words[w] >> C.U64(k * bits) & mask
    return out[:n]


class ShardWriter:
    """Streams documents' ids into one shard file; the file takes its name only when it is complete."""

    def __init__(self, path: str) -> None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        self.path, self.out = path, open(path + ".part", "wb")
        self.out.write(MAGIC)
        self.waiting: list[np.ndarray] = []
        self.n, self.words, self.blocks, self.docs = 0, 0, [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.waiting.append(ids)
        self.n += len(ids)
        if self.n >= BLOCK:
            self._write(False)

    def _write(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        stop = len(ids) if last else len(ids) - len(ids) % BLOCK
        for at in range(0, stop, BLOCK):
            words = pack(ids[at : at + BLOCK])
            self.out.write(words.astype("<u8").tobytes())
            self.blocks.append((self.words, len(words), min(BLOCK, stop - at)))
            self.words += len(words)
        self.waiting, self.n = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self._write(True)
        at = self.out.tell()
        self.out.write(np.array(self.blocks, _BLOCKS).tobytes())
        self.out.write(np.array([d or 0 for d, _ in self.docs], "<i8").tobytes())
        self.out.write(bytes(d is None for d, _ in self.docs))
        self.out.write(np.array([n for _, n in self.docs], "<u8").tobytes())
        self.out.write(np.array([len(self.blocks), len(self.docs), at], "<u8").tobytes())
        self.out.flush()
        os.fsync(self.out.fileno())
        self.out.close()
        os.replace(self.path + ".part", self.path)


def read_shard(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids of each document of a shard, block by block."""
    with open(path, "rb") as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is not a token shard")
        f.seek(-24, os.SEEK_END)
        n_blocks, n_docs, at = np.frombuffer(f.read(24), "<u8").tolist()
        f.seek(at)
        blocks = np.frombuffer(f.read(n_blocks * _BLOCKS.itemsize), _BLOCKS)
        doc_ids = np.frombuffer(f.read(8 * n_docs), "<i8").tolist()
        null = f.read(n_docs)
        counts = np.frombuffer(f.read(8 * n_docs), "<u8").tolist()
        have, k = [np.zeros(0, C.U64)], 0
        ready = 0
        for d, missing, n in zip(doc_ids, null, counts, strict=True):
            while ready < n:
                b = blocks[k]
                f.seek(len(MAGIC) + 8 * int(b["word"]))
                have.append(unpack(np.frombuffer(f.read(8 * int(b["words"])), "<u8").astype(C.U64), int(b["ids"])))
                ready += int(b["ids"])
                k += 1
            buffer = np.concatenate(have) if len(have) > 1 else have[0]
            yield (None if missing else d), buffer[:n]
            have, ready = [buffer[n:]], ready - n


class _Memory(dict):
    """What `make` gives for each key, in two generations of up to `room` keys: a full one replaces the one before it."""

    def __init__(self, make, room: int) -> None:
        self.make, self.room, self.before = make, room, {}

    def __missing__(self, key: str) -> bytes:
        made = (self.before and self.before.get(key)) or self.make(key)
        if len(self) >= self.room:
            self.before = dict(self)
            self.clear()
        self[key] = made
        return made


class Encoder:
    """Ids of texts by the tokenizers library, each distinct word being encoded once.

    A space between two non-space characters always begins a new pre-token of this byte-level BPE, so a text's ids are
    those of its words, all but the first with a leading space. Words of letters, digits and ASCII marks other than the
    apostrophe fall into runs of one kind, each a pre-token that goes to the library's model; all other words go to the
    library whole, as do texts that hold the string of an added token. Memories of words are bounded by `room`.
    """

    def __init__(self, path: str, room: int = 450_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model.tokenize
        # The characters that byte-level BPE writes bytes as: those of Latin-1 that show, and others for the rest.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.bytes = {b: chr(b if b in shown else next(rest)) for b in range(256)}
        letters = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u01ba"
        runs = f"[{letters}]+|[0-9]+|[!-&(-/:-@\\[-`{{-~]+"
        self.simple, self.runs = re.compile(f"(?:{runs})+(?:\n(?:{runs})+)*"), re.compile(f"\n|{runs}")
        # Most words: letters, marks after them, and after a new line (a pre-token of its own) such a word again.
        marks = "[!-&(-/:-@\\[-`{-~]+"
        self.common = re.compile(f"([{letters}]+)({marks})?(?:\n([{letters}]+)({marks})?)?").fullmatch
        self.letters = str.maketrans({c: c.encode().decode("latin-1").translate(self.bytes) for c in map(chr, range(128, 512))})
        self.packs = [struct.Struct(f"<{n}I").pack for n in range(64)]
        self.gaps = re.compile(r"\s\s")
        self.words = _Memory(self.word, room)
        self.tokens = _Memory(self.token, room)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def token(self, piece: str) -> bytes:
        """One pre-token."""
        if not piece.isascii() or piece == "\n":
            piece = piece.encode().decode("latin-1").translate(self.bytes)
        elif piece[0] == " ":
            piece = "Ġ" + piece[1:]
        return self.packed(piece)

    def packed(self, shown: str) -> bytes:
        """The ids of one pre-token as byte-level BPE writes it."""
        ids = [t.id for t in self.model(shown)]
        return self.packs[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids)

    def word(self, word: str) -> bytes:
        """A word with a space before it."""
        if word.isalpha() and word.isascii():
            return self.packed("Ġ" + word)
        if found := self.common(word):
            return self.parts(word, *found.groups())
        if not self.simple.fullmatch(word):
            return self.whole(" " + word)
        first, *rest = self.runs.findall(word)
        if not rest:
            return self.token(" " + word)
        return self.words[first] + b"".join(map(self.tokens.__getitem__, rest))

    def parts(self, word: str, head: str, marks: str | None, head2: str | None, marks2: str | None) -> bytes:
        """A common word with a space before it."""
        if marks is None and head2 is None:
            return self.packed("Ġ" + word.translate(self.letters))
        out = self.words[head]
        if marks:
            out += self.tokens[marks]
        if head2:
            out += self.tokens["\n"] + self.tokens[head2]
            if marks2:
                out += self.tokens[marks2]
        return out

    def look_up(self, words: list[str]) -> list[bytes]:
        """Different words with a space before them; those of several parts are not remembered, only their parts."""
        known, common, parts, out = self.words, self.common, self.parts, []
        for w in words:
            x = known.get(w)
            if x is None:
                found = None if w.isalpha() else common(w)
                x = parts(w, *found.groups()) if found else known[w]
            out.append(x)
        return out

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        if text[:1].isspace() or text[-1:].isspace() or self.gaps.search(text):
            # Longer runs of white space belong to the words beside them.
            first, *rest = re.split(r"(?<=\S) (?=\S)", text)
        else:
            first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self.words.__getitem__, rest))

    def encode_many(self, texts: list[str], limit: int = CHUNK) -> Iterator[np.ndarray]:
        """The ids of each text, by the different words of up to `limit` characters of texts; longer ones go alone."""
        for lo, hi in C.groups_of(np.array([len(t) for t in texts]), limit):
            out, plain = {}, []
            for i in range(lo, hi):
                t = texts[i]
                if len(t) > limit or any(s in t for s in self.special) or t[:1].isspace() or t[-1:].isspace() or self.gaps.search(t):
                    out[i] = np.frombuffer(self.encode(t), "<u4")
                else:
                    plain.append(i)
            split = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
            ends, words = split.offsets.to_numpy().astype(np.int64), split.flatten().dictionary_encode()
            piece = words.indices.to_numpy().copy()
            # A text's first word has no space before it.
            first = ends[:-1]
            alone = [self.whole(texts[i].partition(" ")[0]) for i in plain]
            piece[first] = len(words.dictionary) + np.arange(len(plain))
            pieces = self.look_up(words.dictionary.to_pylist()) + alone
            size = np.array([len(x) for x in pieces], np.int32) // 4
            begin, size = (np.cumsum(size, dtype=np.int32) - size)[piece], size[piece]
            at = np.cumsum(size, dtype=np.int32)
            where = np.repeat(begin - at + size, size)
            where += np.arange(len(where), dtype=np.int32)
            ids = np.frombuffer(b"".join(pieces), "<u4")[where]
            bounds = np.concatenate(([0], at))[ends].tolist()
            out.update((i, ids[a:b]) for i, a, b in zip(plain, bounds[:-1], bounds[1:], strict=True))
            yield from (out[i] for i in range(lo, hi))


_encoders: dict[str, Encoder] = {}
_MANIFEST = "shard int, file string, n_docs long, n_tokens long"


def _write(tokenizer: str, folder: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, Encoder(tokenizer))
        shard, out, tokens, docs = TaskContext.get().partitionId(), None, 0, 0
        end = np.array([end_id], "<u4")
        for whole in batches:
            for lo, hi in C.groups_of(np.diff(C.text_bytes(whole)[1]), CHUNK):
                batch = whole.slice(lo, hi - lo)
                texts = [text or "" for text in C.column(batch, "text")]
                for doc_id, ids in zip(C.column(batch, "doc_id"), encoder.encode_many(texts), strict=True):
                    out = out or ShardWriter(f"{folder}/{shard:06d}-{uuid.uuid4().hex}.zns")
                    out.add(doc_id, np.concatenate((ids, end)))
                    tokens, docs = tokens + len(ids) + 1, docs + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([out.path]), pa.array([docs]), pa.array([tokens])], names=["shard", "file", "n_docs", "n_tokens"])

    return write


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, shard_bytes: int = 32 << 20) -> DataFrame:
    """Writes docs' ids in ascending doc_id order (null first) and returns the manifest: shard, file, n_docs, n_tokens, start.

    Shards are ranges of doc_id from sampled splitters. A file is named by the attempt that wrote it, and the committed
    manifest names one attempt's file for each shard. The manifest has a row for each shard, so its running sum is cheap.
    A text that holds the string of an added token gets that token's id, as the library's defaults say.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranged = source.repartitionByRange(max(1, -(-size // shard_bytes)), "doc_id").sortWithinPartitions("doc_id", "text")
    made = C.materialize(ranged.mapInArrow(_write(tokenizer, C.local_path(folder), end_id), _MANIFEST), "manifest").orderBy("shard").collect()
    at, rows = 0, []
    for r in made:
        rows.append((r.shard, r.file, r.n_docs, r.n_tokens, at))
        at += r.n_tokens
    return spark.createDataFrame(rows, _MANIFEST + ", start long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for file, start in zip(C.column(batch, "file"), C.column(batch, "start"), strict=True):
            rows = []
            for doc_id, ids in read_shard(file):
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
                if len(rows) == 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


def read_back(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the shard files."""
    n = manifest.count()
    return manifest.repartition(max(1, n), "shard").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0) -> DataFrame:
    """Encode, write and read back: one row per row of docs, rows of equal doc_id in text order; null text is empty."""
    folder = folder or C.fresh_path(docs.sparkSession, "tokens")
    return read_back(write_shards(docs, tokenizer, folder, end_id))
