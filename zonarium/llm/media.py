"""Media columns: payloads as grey images in content-addressed tar shards, with metadata from header-only range reads.

A payload is a whole number of 24 x 24 tiles of 8-bit samples: an image 24 samples wide. It is stored as a PNG whose
name in the tar is its own digest, once in each shard. Rows carry the digest, the offset and the length; width, height
and depth come from a range read of the first 33 bytes of the stored form, everything else from the samples read back.
"""

from __future__ import annotations

import hashlib
import io
import os
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SIDE = 24
UNIT = SIDE * SIDE
HEADER = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The UTF-8 bytes padded with 255 to a positive multiple of 576, and their length before."""
    raw = (text or "").encode()
    size = max(1, -(-len(raw) // UNIT)) * UNIT
    return raw + b"\xff" * (size - len(raw)), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(samples: bytes, level: int = 1) -> bytes:
    """An 8-bit grey PNG, 24 samples wide; rows are stored without prediction, as text has none to gain."""
    rows = np.zeros((len(samples) // SIDE, SIDE + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(-1, SIDE)
    head = struct.pack(">IIBBBBB", SIDE, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, from the first 33 bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG header")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def decode_png(stored: bytes) -> bytes:
    width, height, bits = png_header(stored[:HEADER])
    at, data = HEADER, []
    while at < len(stored):
        size, kind = struct.unpack(">I4s", stored[at : at + 8])
        if kind == b"IDAT":
            data.append(stored[at + 8 : at + 8 + size])
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width * bits // 8 + 1)
    if rows[:, 0].any():
        raise ValueError("rows with prediction are not written here")
    return rows[:, 1:].tobytes()


def feature_of(samples: bytes) -> str:
    """Mean, deviation, entropy in bits and the shares of sample values below 64, 128 and 192, to fixed digits."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    n, value = len(samples), np.arange(256)
    mean = float((counts * value).sum()) / n
    deviation = float((counts * (value - mean) ** 2).sum() / n) ** 0.5
    p = counts[counts > 0] / n
    shares = [float(counts[a : a + 64].sum()) / n for a in (0, 64, 128)]
    return f"mean={mean:.4f};sd={deviation:.4f};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.4f};" + "q=" + ",".join(f"{s:.4f}" for s in shares)


_WRITE_SQL = "doc_id long, shard string, digest string, offset long, length long, n_bytes long"


def _write(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tar, path, have = None, "", {}
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch, rows = whole.slice(lo, 500), []
                for doc_id, text in zip(C.column(batch, "doc_id"), C.column(batch, "text"), strict=True):
                    if tar is None:
                        os.makedirs(folder, exist_ok=True)
                        path = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tar"
                        tar = tarfile.open(path, "w", format=tarfile.USTAR_FORMAT)
                    samples, n_bytes = payload_of(text)
                    address = hashlib.sha256(samples).digest()
                    if address not in have:
                        stored = encode_png(samples)
                        digest = hashlib.sha256(stored).hexdigest()
                        info = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
                        info.size = len(stored)
                        at = tar.offset + tarfile.BLOCKSIZE
                        tar.addfile(info, io.BytesIO(stored))
                        have[address] = (digest, at, len(stored))
                    rows.append((doc_id, path, *have[address], n_bytes))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "shard", "digest", "offset", "length", "n_bytes"])
        if tar:
            tar.close()

    return write


def store_media(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, shard, digest, offset, length, n_bytes: writes the payloads, one tar shard for each input partition.

    Each attempt has a file of its own, which the committed rows name. Equal payloads are stored once in a shard; copies
    in different shards stay, as meeting by digest would move every payload.
    """
    folder = C.local_path(folder or C.fresh_path(docs.sparkSession, "media"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return C.materialize(source.mapInArrow(_write(folder), _WRITE_SQL), "media-index")


_FILL = ["shard", "digest", "offset", "length", "width", "height", "bits"]


class _Tar:
    def __init__(self) -> None:
        self.path, self.file = None, None

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path != self.path:
            if self.file:
                self.file.close()
            self.path, self.file = path, open(path, "rb")
        return os.pread(self.file.fileno(), length, offset)


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tar = _Tar()
    for batch in batches:
        heads = [png_header(tar.read(p, o, HEADER)) for p, o in zip(C.column(batch, "shard"), C.column(batch, "offset"), strict=True)]
        width, height, bits = zip(*heads, strict=True) if heads else ((), (), ())
        extra = [pa.array(c, pa.int64()) for c in (width, height, bits)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "width", "height", "bits"])


def fill_metadata(index: DataFrame) -> DataFrame:
    """index with width, height and bits, read from 33 bytes of each stored payload."""
    return index.mapInArrow(_headers, index.schema.simpleString()[7:-1].replace(":", " ") + ", width long, height long, bits long")


_FEATURES = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("width", pa.int64()), ("height", pa.int64())]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tar = _Tar()
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            stored = tar.read(r["shard"], r["offset"], r["length"])
            digest = hashlib.sha256(stored).hexdigest()
            if digest != r["digest"]:
                raise ValueError(f"{r['shard']} at {r['offset']}: the stored bytes do not have the digest {r['digest']}")
            samples = decode_png(stored)
            rows.append((r["doc_id"], r["n_bytes"], len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(stored), digest, f"{r['width']}x{r['height']}x{r['bits']};" + feature_of(samples), r["width"], r["height"]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), _FEATURES, strict=True)], names=[n for n, _ in _FEATURES])


def media_features(index: DataFrame) -> DataFrame:
    """One row per row of index: digests and features of what the shards hold, read back by range."""
    return fill_metadata(index).mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long")


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Store docs' texts as media and read their columns back; null text is empty, doc_id may be null or repeated."""
    return media_features(store_media(docs, folder))
