"""Exact removal of repeated byte strings, by sorting sampled suffixes in range partitions.

Every suffix of the corpus with 400 bytes of context would be 400 times the input, so suffixes are sampled by
content: of each 400-byte string, the position of its least 200-byte hash (leftmost on ties) is the one whose suffix
is sorted. Equal strings choose equal positions, so they meet under the same key. The consecutive strings of a
document that choose one position form a run.

1. Keys that occur once in the corpus are dropped: no string under them repeats.
2. Equal runs repeat as a whole, known by two independent hashes of 64 bits.
3. The other runs under a shared key, one of each text, are fetched and range-partitioned by the leading 16 bytes of
   their suffixes, and by key; Spark samples the splitters. Each bucket is sorted by them, and the strings of each key
   by multikey quicksort with eight bytes as a character, until they differ from all others or are equal to the last
   byte. Splitters fall between keys, so no two equal strings stand on different sides of a boundary. Keys with more
   than hot_runs different runs are split into single strings and counted with partial aggregation instead, so that no
   group is gathered in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_POSITION = C.U64((1 << 24) - 1)
#: Texts are cut into overlapping pieces of this many strings, so that a position fits 24 bits and arrays stay small.
_PIECE = 1 << 20
_INDEX = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string()),
                    ("key", pa.list_(pa.int64())), ("run", pa.list_(pa.int64())), ("start", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("lead", pa.list_(pa.int32()))])
_INDEX_SQL = "doc_id long, rid long, file string, offset long, length long, n_bytes long, sha256 string, key array<long>, run array<long>, start array<long>, n array<int>, lead array<int>"


def runs_of(data: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """key, run hash, first start, number of starts, and how far the chosen position is from the first start."""
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(0, len(data) - length + 1), _PIECE):
        d = data[at : at + _PIECE + length - 1]
        h = C.prefix_hash(d)
        x = h[seed:] - h[:-seed]
        x *= C.powers(len(d), C.BASE_INVERSE)[: len(x)]
        C.mix(x)
        least = C.sliding_min((x & ~_POSITION) | np.arange(len(x), dtype=C.U64), length - seed + 1)
        chosen = (least & _POSITION).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        end = np.append(first[1:], len(chosen))
        lead = chosen[first] - first
        raw = d.tobytes()
        run = np.array([xxhash.xxh64_intdigest(raw[s:e], k) for s, e, k in zip(first.tolist(), (end - 1 + length).tolist(), lead.tolist(), strict=True)], C.U64)
        out.append((x[chosen[first]].view(np.int64), run.view(np.int64), first + at, (end - first).astype(np.int32), lead.astype(np.int32)))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.int32), z.astype(np.int32)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else [], kind))


def _index(length: int, seed: int, folder: str):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, n, blobs = TaskContext.get().partitionId(), 0, None
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                data, offsets, _ = C.text_bytes(batch)
                blobs = blobs or C.Blobs(folder, partition)
                rows, found = [], []
                for i in range(batch.num_rows):
                    d = data[offsets[i] : offsets[i + 1]]
                    found.append(runs_of(d, length, seed))
                    raw = d.tobytes()
                    rows.append((partition << 36 | n, *blobs.add(raw), len(raw), hashlib.sha256(raw).hexdigest()))
                    n += 1
                rid, at, size, n_bytes, sha = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(rid, pa.int64()), pa.array([blobs.path] * len(rid)), pa.array(at, pa.int64()), pa.array(size, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(sha), *(_lists([f[c] for f in found], k) for c, k in enumerate(kinds))], schema=_INDEX)
        if blobs:
            blobs.close()

    return build


_PIECES = pa.schema([("key", pa.int64()), ("run", pa.int64()), ("rid", pa.int64()), ("start", pa.int64()), ("lead", pa.int32()), ("alone", pa.bool_()), ("hot", pa.bool_()), ("piece", pa.binary()), ("lead1", pa.int64()), ("lead2", pa.int64())])
_PIECES_SQL = "key long, run long, rid long, start long, lead int, alone boolean, hot boolean, piece binary, lead1 long, lead2 long"


def _fetch(length: int):
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last, text = C.BlobReader(), None, b""
        for batch in batches:
            pieces, heads = [], []
            for rid, file, offset, size, start, n, lead in zip(*(C.column(batch, c) for c in ("rid", "file", "offset", "length", "start", "n", "lead")), strict=True):
                if rid != last:
                    last, text = rid, reader.get(file, offset, size)
                pieces.append(text[start : start + n - 1 + length])
                heads.append(text[start + lead : start + lead + 16].ljust(16, b"\0"))
            # As signed numbers that stand in the order of the bytes.
            words = (np.frombuffer(b"".join(heads), ">u8").astype(C.U64) ^ C.U64(1 << 63)).view(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(c).cast(_PIECES.field(c).type) for c in _PIECES.names[:-3]] + [pa.array(pieces, pa.binary()), pa.array(words[:, 0]), pa.array(words[:, 1])], schema=_PIECES)
        reader.close()

    return fetch


def _strings(piece: bytes, length: int, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each string of a run: its distance to the chosen position, and its hash mixed with that."""
    h = C.prefix_hash(np.frombuffer(piece, np.uint8))
    start = np.arange(len(piece) - length + 1)
    ahead = lead - start
    return ahead, C.pieces_hash(h, start, start + length) ^ C.mix(ahead.astype(C.U64) * C.U64(0x9E3779B97F4A7C15))


_SPANS = pa.schema([("rid", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])
_SPANS_SQL = "rid long, s long, e long"


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def repeated_strings(pieces: list[bytes], leads: list[int], length: int, seed: int) -> list[np.ndarray]:
    """Which strings of each run are in another one too, by multikey quicksort over characters of eight bytes.

    All parts of one depth are split at once, and parts of one string are done. Strings can be equal only where the
    chosen position stands at the same distance, and there its seed bytes are equal, so that these are not compared.
    """
    counts = [len(p) - length + 1 for p in pieces]
    begins = np.cumsum([0, *(len(p) for p in pieces[:-1])])
    data = np.frombuffer(b"".join(pieces) + bytes(8), np.uint8)
    word = np.zeros(len(data) - 7, C.U64)
    for k in range(8):
        word |= data[k : len(data) - 7 + k].astype(C.U64) << C.U64(56 - 8 * k)
    start = np.concatenate([b + np.arange(n) for b, n in zip(begins.tolist(), counts, strict=True)])
    ahead = np.concatenate([lead - np.arange(n) for lead, n in zip(leads, counts, strict=True)])
    open_, part = np.arange(len(start)), ahead - ahead.min()
    size = np.bincount(part)
    open_, part = open_[size[part] > 1], part[size[part] > 1]
    word >>= C.U64(64 - 8 * min(8, length))
    for at in [*range(0, length - 8, 8), max(0, length - 8)]:
        if not len(open_):
            break
        behind = ahead[open_]
        needed = (at < behind) | (at + 8 > behind + seed)
        if not needed.any():
            continue
        w = np.where(needed, word[start[open_] + at], C.U64(0))
        order = np.lexsort((w, part))
        w, sorted_part = w[order], part[order]
        new = np.concatenate(([True], (w[1:] != w[:-1]) | (sorted_part[1:] != sorted_part[:-1])))
        number = np.cumsum(new) - 1
        several = np.bincount(number)[number] > 1
        open_, part = open_[order][several], number[several]
    twice = np.zeros(len(start), bool)
    twice[open_] = True
    return np.split(twice, np.cumsum(counts)[:-1])


def _compare(length: int, seed: int):
    """Sorts the strings of each key's runs and marks those that have an equal neighbour in another run."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for _, g in C.sorted_groups(batches, "key", ["run", "rid", "start", "lead", "alone", "piece"]):
            keep = list({r: i for i, r in reversed(list(enumerate(g["run"])))}.values())
            if len(keep) < 2:
                continue
            for i, twice in zip(keep, repeated_strings([g["piece"][i] for i in keep], [g["lead"][i] for i in keep], length, seed), strict=True):
                if g["alone"][i]:
                    for s, e in zip(*_spans(twice), strict=True):
                        out.append((g["rid"][i], g["start"][i] + int(s), g["start"][i] + int(e) - 1 + length))
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_SPANS)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_SPANS)

    return compare


_STARTS = pa.schema([("key", pa.int64()), ("string", pa.int64()), ("run", pa.int64()), ("rid", pa.int64()), ("at", pa.int64()), ("alone", pa.bool_())])


def _explode(length: int):
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ahead, h = _strings(row["piece"], length, row["lead"])
                n = len(h)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["key"])), pa.array(h.view(np.int64)), pa.array(np.full(n, row["run"])), pa.array(np.full(n, row["rid"])), pa.array(row["start"] + np.arange(n)), pa.array(np.full(n, row["alone"]))], schema=_STARTS)

    return explode


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64())), ("kept", pa.binary())])


def merge_spans(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(pairs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _finish(with_text: bool):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = C.BlobReader()
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                rows = []
                for r in whole.slice(lo, 500).to_pylist():
                    spans = merge_spans([(x["s"], x["e"]) for x in r["marks"] or []])
                    kept, sha = b"", r["sha256"]
                    if spans or with_text:
                        text = reader.get(r["file"], r["offset"], r["length"])
                        cuts = [0, *(x for span in spans for x in span), len(text)]
                        kept = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                        sha = hashlib.sha256(kept).hexdigest()
                    rows.append((r["doc_id"], r["n_bytes"], sum(e - s for s, e in spans), len(spans), sha, [x for span in spans for x in span], kept if with_text else b""))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RESULT, strict=True)], schema=_RESULT)
        reader.close()

    return finish


def repeated_bytes(docs: DataFrame, length: int = 400, seed: int = 200, hot_runs: int = 4096, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept: one row per row of docs.

    Removes each byte covered by a length-byte string that also starts elsewhere in docs. A null text counts as
    empty; a null or repeated doc_id is kept as it is, rows of equal doc_id being different documents; other columns
    are not read. Removed bytes may cut a character in two, so `kept` (filled if with_text) is binary. Equality of
    whole runs, and of strings under hot keys, is by 128 bits of hash, of others by their bytes.
    """
    spark = docs.sparkSession
    folder = C.local_path(C.fresh_path(spark, "texts"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    index = C.materialize(source.mapInArrow(_index(length, seed, folder), _INDEX_SQL), "runs")
    runs = index.select("rid", F.explode(F.arrays_zip("key", "run", "start", "n", "lead")).alias("x")).select("rid", "x.*")
    shared = runs.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key")
    runs = C.materialize(runs.join(shared, "key"), "shared")
    kinds = runs.groupBy("key", "run").agg(F.count("*").alias("copies"), F.min("rid").alias("first"))
    kinds = C.materialize(kinds, "kinds")
    mixed = kinds.groupBy("key").agg(F.count("*").alias("d")).where("d > 1")
    whole = runs.join(kinds.where("copies > 1").select("key", "run"), ["key", "run"]).select("rid", F.col("start").alias("s"), (F.col("start") + F.col("n") - 1 + length).alias("e"))
    one = kinds.join(mixed, "key").select("key", "run", F.col("first").alias("rid"), (F.col("copies") == 1).alias("alone"), (F.col("d") > hot_runs).alias("hot"))
    one = runs.join(one, ["key", "run", "rid"]).join(index.select("rid", "file", "offset", "length"), "rid")
    pieces = C.materialize(one.sortWithinPartitions("rid").mapInArrow(_fetch(length), _PIECES_SQL), "pieces")
    part = pieces.where("not hot").repartitionByRange("lead1", "lead2", "key").sortWithinPartitions("lead1", "lead2", "key").mapInArrow(_compare(length, seed), _SPANS_SQL)
    single = pieces.where("hot").mapInArrow(_explode(length), "key long, string long, run long, rid long, at long, alone boolean")
    twice = single.groupBy("key", "string").agg((F.min("run") < F.max("run")).alias("twice")).where("twice").select("key", "string")
    hot = single.join(twice, ["key", "string"]).where("alone").select("rid", F.col("at").alias("s"), (F.col("at") + length).alias("e"))
    marks = whole.unionByName(part).unionByName(hot).groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("marks"))
    final = index.select("doc_id", "rid", "file", "offset", "length", "n_bytes", "sha256").join(marks, "rid", "left")
    return final.mapInArrow(_finish(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept binary")
