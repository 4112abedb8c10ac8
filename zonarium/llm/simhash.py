"""SimHash fingerprints of word shingles, and their exact linking by a binary-trie self-join.

Any two fingerprints that differ in at most d bits agree on at least b - d of b bit blocks, so each fingerprint is sent
to the buckets of its C(b, d) block choices, and every linked pair meets in one. Within a bucket the sorted fingerprints
are a binary trie: pairs of its nodes are walked together from the root, the bits in which the two sides differ are
added up, and a pair of nodes is dropped when they exceed d. Buckets above hot_bucket are split again on blocks of the
bits that are still free, so that no bucket's size follows the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_SPREAD = np.array([sum((i >> b & 1) << (8 * b) for b in range(8)) for i in range(256)], C.U64)
_CHUNK = 200_000


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text: a bit is set if it is set in over half of the shingle hashes."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return digest(joined, seed)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(tokens) - words + 1].tolist()
    end = end[words - 1 :].tolist()
    total = np.zeros(64, np.int64)
    for at in range(0, len(start), _CHUNK):
        h = np.array([digest(joined[i:j], seed) for i, j in zip(start[at : at + _CHUNK], end[at : at + _CHUNK], strict=True)], C.U64)
        lanes = _SPREAD[h.view(np.uint8).reshape(-1, 8)]
        # Up to 255 hashes add up in the byte lanes of a word without carrying over.
        lanes = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        total += lanes.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = 2 * total > len(start)
    return int(np.packbits(bits, bitorder="little").view(C.U64)[0])


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                fp = np.array([fingerprint(t, words, seed) for t in C.column(batch, "text")], C.U64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(fp.view(np.int64))], names=["doc_id", "h", "fp"])

    return run


def blocks_of(free: int, count: int) -> list[int]:
    """Masks of count consecutive blocks that divide the set bits of free."""
    bits = [i for i in range(64) if free >> i & 1]
    return [sum(1 << int(b) for b in part) for part in np.array_split(np.array(bits, dtype=object), count)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _spread(masks_of):
    """Each row once for every mask that masks_of(fixed bits) names, keyed by its bucket so far, the mask and its bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, fixed, bucket = (batch.column(c).to_numpy().view(C.U64) for c in ("fp", "fixed", "bucket"))
            for kind in np.unique(fixed).tolist():
                at = fixed == kind
                for i, mask in enumerate(masks_of(kind)):
                    key = C.mix(C.mix(fp[at] & C.U64(mask)) ^ (bucket[at] * C.U64(C.BASE)) ^ C.U64(i * 0x51ED270B + 1))
                    out = (fp[at], np.full(len(key), kind | mask, C.U64), key)
                    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in out], names=["fp", "fixed", "bucket"])

    return run


def trie_pairs(fp: np.ndarray, bounds: np.ndarray, budget: int, leaf: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j within the same slice of fp whose values differ in at most budget bits.

    bounds: where the slices begin and end; each is sorted. Node pairs of all slices are walked together, depth first
    in chunks, so that memory stays bounded.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    zeros = [np.concatenate(([0], np.cumsum((fp >> C.U64(b) & C.U64(1)) == 0))) for b in range(64)]
    a = np.flatnonzero(np.diff(bounds) > 1)
    stack = [(63, np.stack([bounds[a], bounds[a + 1], bounds[a], bounds[a + 1], np.zeros(len(a), np.int64)]))]
    while stack:
        bit, nodes = stack.pop()
        if nodes.shape[1] > 50_000:
            half = nodes.shape[1] // 2
            stack += [(bit, nodes[:, half:]), (bit, nodes[:, :half])]
            continue
        if not nodes.shape[1]:
            continue
        l1, r1, l2, r2, err = nodes
        done = ((r1 - l1) * (r2 - l2) <= leaf) | (bit < 0)
        if done.any():
            x1, y1, x2, y2 = (v[done] for v in (l1, r1, l2, r2))
            n = (y1 - x1) * (y2 - x2)
            which = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            i, j = x1[which] + k // (y2 - x2)[which], x2[which] + k % (y2 - x2)[which]
            ok = i < j
            i, j = i[ok], j[ok]
            near = np.bitwise_count(fp[i] ^ fp[j]) <= budget
            found.append((i[near], j[near]))
        l1, r1, l2, r2, err = (v[~done] for v in (l1, r1, l2, r2, err))
        if not len(l1):
            continue
        z = zeros[bit]
        m1, m2 = l1 + z[r1] - z[l1], l2 + z[r2] - z[l2]
        same = (l1 == l2) & (r1 == r2)
        parts = [(l1, m1, l2, m2, err), (m1, r1, m2, r2, err), (l1, m1, m2, r2, err + 1)]
        other = [v[~same] for v in (m1, r1, l2, m2, err + 1)]
        nodes = np.stack([np.concatenate(c) for c in zip(*parts, other, strict=True)])
        alive = (nodes[4] <= budget) & (nodes[1] > nodes[0]) & (nodes[3] > nodes[2])
        stack.append((bit - 1, nodes[:, alive]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _link(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by bucket; whole buckets are joined in portions, the last one waits for its rest.
        bucket, fp = np.zeros(0, np.int64), np.zeros(0, C.U64)

        def join(bucket: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((fp, bucket))
            bucket, fp = bucket[order], fp[order]
            bounds = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
            i, j = trie_pairs(fp, bounds, budget)
            pairs = np.unique(np.stack([fp[i], fp[j]], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], names=["a", "b"])

        for batch in batches:
            bucket = np.concatenate([bucket, batch.column("bucket").to_numpy()])
            fp = np.concatenate([fp, batch.column("fp").to_numpy().view(C.U64)])
            if len(bucket) >= 50_000 and bucket[0] != bucket[-1]:
                cut = int(np.searchsorted(bucket, bucket[-1]))
                yield join(bucket[:cut], fp[:cut])
                bucket, fp = bucket[cut:], fp[cut:]
        if len(bucket):
            yield join(bucket, fp)

    return run


def near_pairs(fps: DataFrame, budget: int = 4, blocks: int = 6, hot_bucket: int = 5000) -> DataFrame:
    """a < b as unsigned numbers: the pairs of the distinct values fp of fps that differ in at most budget bits."""
    every = (1 << 64) - 1
    first = [sum(c) for c in combinations(blocks_of(every, blocks), blocks - budget)]
    schema = "fp long, fixed long, bucket long"
    rows = fps.select("fp", F.lit(0).cast("long").alias("fixed"), F.lit(0).cast("long").alias("bucket"))
    out = None
    for level in range(12):
        masks_of = (lambda _: first) if level == 0 else (lambda fixed: blocks_of(every & ~fixed, budget + 1))
        spread = C.materialize(rows.mapInArrow(_spread(masks_of), schema), "buckets")
        sizes = C.materialize(spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        cold = spread.join(sizes.where(F.col("n") <= hot_bucket).select("bucket"), "bucket")
        pairs = cold.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_link(budget), "a long, b long")
        out = pairs if out is None else out.unionByName(pairs)
        hot = sizes.where(F.col("n") > hot_bucket).select("bucket")
        if hot.isEmpty():
            return out.distinct()
        rows = spread.join(hot, "bucket").select("fp", "fixed", "bucket")
    raise RuntimeError("buckets did not get small enough")


def _classes(docs: DataFrame, words: int, budget: int, seed: int, blocks: int, hot_bucket: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, fp) of each row, h being a hash of its text, and (fp, component, component_id) of each fingerprint."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    rows = C.materialize(source.mapInArrow(_fingerprints(words, seed), "doc_id long, h long, fp long"), "fingerprints")
    values = C.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "values")
    pairs = near_pairs(values.select("fp"), budget, blocks, hot_bucket)
    classes = C.components(pairs)
    values = values.join(classes, values.fp == classes.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    names = values.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows, values.join(names, "component").select("fp", "component", "component_id")


def simhash_classes(docs: DataFrame, words: int = 4, budget: int = 4, seed: int = 42, blocks: int = 6, hot_bucket: int = 5000) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of docs.

    Texts of fewer words than a shingle are one shingle; null texts and texts without words have fingerprint zero and
    are linked like any other. component_id is the smallest doc_id among all documents that links reach; a null doc_id
    never names a component unless all its members are null. Equal fingerprints are joined as one value, so copies cost
    one row. Other columns are not read.
    """
    rows, values = _classes(docs, words, budget, seed, blocks, hot_bucket)
    return rows.join(values, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = 4, budget: int = 4, seed: int = 42, blocks: int = 6, hot_bucket: int = 5000) -> DataFrame:
    """One row of docs of each component, with all its columns: that of the smallest doc_id.

    A null doc_id comes after all others; of rows of equal doc_id the one of least text hash stays, of repeated rows
    any one.
    """
    rows, values = _classes(docs, words, budget, seed, blocks, hot_bucket)
    first = rows.join(values, "fp").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "h")).alias("k"))
    first = C.materialize(first.select(F.col("k.doc_id").alias("_keep"), F.col("k.h").alias("_h")), "kept")
    same = lambda a, b: F.coalesce(F.col(a).cast("long"), F.lit(0)) == F.coalesce(F.col(b), F.lit(0))
    is_row = same("doc_id", "_keep") & F.col("doc_id").eqNullSafe(F.col("_keep")) & (F.xxhash64("text") == F.col("_h"))
    repeated = rows.groupBy("doc_id", "h").count().where("count > 1").select(F.col("doc_id").alias("_keep"), F.col("h").alias("_h"))
    matched = lambda a, b: a["_keep"].eqNullSafe(b["_keep"]) & (a["_h"] == b["_h"])
    once, twice = first.join(repeated, matched(first, repeated), "left_anti"), first.join(repeated, matched(first, repeated), "left_semi")
    kept = docs.join(once, is_row, "left_semi")
    if twice.isEmpty():
        return kept
    # Of rows repeated whole one is taken; copies of a hot row meet only as (doc_id, text hash) in a partial aggregate.
    again = docs.join(twice, is_row, "left_semi")
    flat = again.groupBy(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_a"), F.col("doc_id").isNull().alias("_b"), F.xxhash64("text").alias("_c")).agg(F.first(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("_row"))
    return kept.unionByName(flat.select("_row.*"))
