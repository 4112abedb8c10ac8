"""What the operators share: shared-folder tables, Arrow text columns as byte arrays, vectorised hashes, components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: An odd base and its inverse modulo 2**64, for the prefix hash.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=U64) | U64(1)
_powers: dict[int, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only where that is unset and Spark runs in one process, a folder of this process's own, removed when it ends.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="zonarium-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/zonarium/{name}-{uuid.uuid4().hex}"


def local_path(path: str) -> str:
    """The path as the operating system names it; the shared folder must be mounted on every executor."""
    return path[7:] if path.startswith("file://") else path[5:] if path.startswith("file:") else path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs neither recompute it nor depend on an executor."""
    spark = df.sparkSession
    df.write.parquet(path := fresh_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string column, the offsets of its rows in them, and which rows are not null."""
    a = batch.column(column)
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    n, wide = len(a), pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type)
    bufs = a.buffers()
    offsets = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[a.offset : a.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and len(bufs[2]) else np.zeros(0, np.uint8)
    valid = np.ones(n, bool) if not a.null_count else ~np.asarray(a.is_null().to_numpy(zero_copy_only=False), bool)
    return data, offsets, valid


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).to_pylist()


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 14, 1 << int(n - 1).bit_length()) if n > 1 else 1 << 14
        have = np.full(size, base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] = sum of table[data[t]] * BASE**t for i <= t < j; any piece's hash comes from two entries."""
    h = np.empty(len(data) + 1, U64)
    h[0] = 0
    np.cumsum(_TABLE[data] * powers(len(data)), out=h[1:])
    return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit words; writes into its argument."""
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def pieces_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the pieces start..end of what h is the prefix hash of; equal bytes give equal hashes wherever they stand."""
    x = h[end] - h[start]
    x *= powers(len(h), BASE_INVERSE)[start]
    x += (end - start).astype(U64) * U64(0xA24BAED4963EE407)
    return mix(x)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each of the len(v) - width + 1 windows, by block-wise running minima."""
    n = len(v)
    if n < width or width < 1:
        return v[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(v.dtype).max, v.dtype)
    padded[:n] = v
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


#: Bytes of words for matching: letters and digits, and all bytes of characters beyond ASCII.
WORD_BYTE = np.array([chr(b).isalnum() or b > 127 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the lower-cased words of consecutive rows, and where each row's words begin.

    offsets are those of the rows in data, of which the part from the first to the last is looked at; starts and ends
    count from the first.
    """
    d = LOWER[data[offsets[0] : offsets[-1]]]
    off = offsets - offsets[0]
    inside = np.concatenate([WORD_BYTE[d], [False]])
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = off[:-1][off[:-1] < len(d)]
    begins[at] = inside[at]
    start = np.flatnonzero(begins)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | begins[1:]
    end = np.flatnonzero(stop) + 1
    return start, end, pieces_hash(prefix_hash(d), start, end), np.searchsorted(start, off)


def groups_of(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive runs of rows, each of at most limit bytes or of one row."""
    i, n = 0, len(lengths)
    ends = np.cumsum(lengths)
    while i < n:
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield i, j
        i = j


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node, component: the smallest node that each node of the undirected edges (a, b) reaches.

    Alternating large-star and small-star steps (Kiveris et al., 2014): the number of rounds grows with the
    logarithm of the number of nodes, and no step gathers a component anywhere. A hub's neighbours are only
    aggregated by min and joined, which partial aggregation and adaptive skew handling split. Each round is a
    table in the shared folder.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        if now.isEmpty():
            break
        # Large star: each node's larger neighbours are linked to the least of it and its neighbours.
        near = both(now)
        least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: each node's neighbours that are not larger, and itself, are linked to the least of them.
        small = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = small.groupBy("a").agg(F.min("b").alias("m"))
        joined = small.join(least, "a")
        now = materialize(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "star")
        after = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(after) == before:
            break
        before = tuple(after)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


STORE_SCHEMA = "rid long, file string, offset long, length long, n_bytes long"


class Blobs:
    """Appends zstd-compressed payloads to one file of the shared folder; each task attempt has a file of its own.

    A row's pointer (file, offset, length) is emitted by the same attempt that wrote the file, so a pointer that a
    committed table holds always names a complete file, whatever attempts were lost or repeated.
    """

    def __init__(self, folder: str, partition: int) -> None:
        import zstandard

        os.makedirs(folder, exist_ok=True)
        self.path = f"{folder}/{partition:06d}-{uuid.uuid4().hex}.blobs"
        self.out, self.at, self.pack = open(self.path, "wb"), 0, zstandard.ZstdCompressor(level=3).compress

    def add(self, payload: bytes) -> tuple[int, int]:
        z = self.pack(payload)
        self.out.write(z)
        self.at += len(z)
        return self.at - len(z), len(z)

    def flush(self) -> None:
        self.out.flush()

    def close(self) -> None:
        self.out.flush()
        os.fsync(self.out.fileno())
        self.out.close()


class BlobReader:
    """Range reads of payloads by pointer; keeps one file open, as rows come file by file."""

    def __init__(self) -> None:
        import zstandard

        self.path, self.file, self.unpack = None, None, zstandard.ZstdDecompressor().decompress

    def get(self, path: str, offset: int, length: int) -> bytes:
        if path != self.path:
            self.close()
            self.path, self.file = path, open(path, "rb")
        return self.unpack(os.pread(self.file.fileno(), length, offset))

    def close(self) -> None:
        if self.file:
            self.file.close()
            self.path = self.file = None


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str, others: list[str]) -> Iterator[tuple[int, dict[str, list]]]:
    """The groups of equal key in rows that come sorted by it, across batch boundaries."""
    pending: dict[str, list] = {c: [] for c in others}
    now = None
    for batch in batches:
        k = batch.column(key).to_numpy()
        cols = {c: batch.column(c) for c in others}
        edges = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]))
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if i == j:
                continue
            if now is not None and k[i] != now:
                yield now, pending
                pending = {c: [] for c in others}
            now = int(k[i])
            for c in others:
                pending[c].extend(cols[c].slice(int(i), int(j - i)).to_pylist())
    if now is not None:
        yield now, pending
