"""Benchmark decontamination by spaced-seed hashing.

Words are runs of letters, digits and non-ASCII characters, lower-cased in ASCII. A document and an item overlap where,
on one alignment without gaps, a window of min(overlap, words of the item) words agrees in at least `similarity` of
them. Seeds are fixed masks over word positions: the words at the other positions do not count. The masks of long
items (13 words and more) and of short ones are such that every window that satisfies the rule, wherever its
substitutions are, contains a place where one mask's words all agree; items under five words are their own seed. So
the search misses nothing, which the tests check for all placements of substitutions.

The benchmark's seeds go to every executor in blocks of at most `block_words` words (at least one item), one pass over
the documents for each block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LONG = ((0, 1, 2, 4, 5, 6), (0, 1, 2, 4, 7, 8))
SHORT = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 2, 3, 4), (0, 1, 2, 4))
OVERLAP, SIMILARITY = 13, 0.8
_FILTER_BITS = 22


def masks_for(words: int, overlap: int) -> tuple[tuple[int, ...], ...]:
    return LONG if min(words, overlap) >= 13 else SHORT if min(words, overlap) >= 5 else (tuple(range(min(words, overlap))),)


def seed_hash(words: np.ndarray, at: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    h = np.full(len(at), C.U64(sum(1 << o for o in mask)), C.U64)
    for o in mask:
        h = C.mix(h * C.U64(C.BASE) + words[at + o])
    return h


class Matcher:
    """The seeds of one block of items, and the overlaps of documents with them."""

    def __init__(self, items: list[tuple[int, str | None]], overlap: int = OVERLAP, similarity: float = SIMILARITY) -> None:
        self.overlap, self.similarity = overlap, similarity
        self.ids, self.words = [], []
        seeds: dict[tuple[int, ...], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for item_id, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            w = C.words_of(raw, np.array([0, len(raw)]))[2]
            if not len(w):
                continue
            for mask in masks_for(len(w), overlap):
                at = np.arange(len(w) - mask[-1])
                seeds.setdefault(mask, []).append((seed_hash(w, at, mask), np.full(len(at), len(self.ids)), at))
            self.ids.append(item_id)
            self.words.append(w)
        self.known = np.zeros(1 << _FILTER_BITS, bool)
        for w in self.words:
            self.known[(w >> C.U64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.seeds = {}
        for mask, parts in seeds.items():
            h, item, at = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.seeds[mask] = h[order], item[order], at[order]

    def _window(self, a: np.ndarray, b: np.ndarray, size: int) -> tuple[int, int, int] | None:
        """First place, length and agreements of the words that windows of enough agreement cover on one alignment."""
        need = min(self.overlap, size)
        if len(a) < need:
            return None
        same = a == b
        total = np.concatenate(([0], np.cumsum(same)))
        good = np.flatnonzero(total[need:] - total[:-need] >= math.ceil(self.similarity * need - 1e-9))
        if not len(good):
            return None
        cover = np.zeros(len(a) + 1, np.int64)
        np.add.at(cover, good, 1)
        np.add.at(cover, good + need, -1)
        covered = np.cumsum(cover)[:-1] > 0
        return int(good[0]), int(covered.sum()), int((same & covered).sum())

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first word, words, agreeing words): the longest overlap of each row and item."""
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        for lo, hi in C.groups_of(np.diff(offsets), 1 << 20):
            _, _, words, first = C.words_of(data, offsets[lo : hi + 1])
            known = self.known[(words >> C.U64(64 - _FILTER_BITS)).astype(np.int64)]
            seen = set()
            for mask, (h, item, at) in self.seeds.items():
                n = len(words) - mask[-1]
                if n <= 0:
                    continue
                maybe = known[:n].copy()
                for o in mask[1:]:
                    maybe &= known[o : o + n]
                place = np.flatnonzero(maybe)
                mine = seed_hash(words, place, mask)
                left, right = np.searchsorted(h, mine, "left"), np.searchsorted(h, mine, "right")
                for k in np.flatnonzero(right > left).tolist():
                    p = int(place[k])
                    row = int(np.searchsorted(first, p, "right")) - 1
                    begin, end = int(first[row]), int(first[row + 1])
                    if p + mask[-1] >= end:
                        continue
                    for s in range(int(left[k]), int(right[k])):
                        i, q = int(item[s]), int(at[s])
                        if (row, i, p - q) in seen:
                            continue
                        seen.add((row, i, p - q))
                        w = self.words[i]
                        a, b = max(begin, p - q), min(end, p - q + len(w))
                        found = self._window(words[a:b], w[a - p + q : b - p + q], len(w))
                        if found:
                            now = (a - begin + found[0], found[1], found[2])
                            key = (lo + row, i)
                            if key not in out or (now[2], -now[0]) > (out[key][2], -out[key][0]):
                                out[key] = now
        return [(row, i, *v) for (row, i), v in sorted(out.items())]


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks whose words sum to block_words at most, or of one item; one block at a time on the driver."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        n = len((r.text or "").encode()) // 2 + 1  # not fewer than its words
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += n
    if block:
        yield block


def _pairs(matcher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher.value
        for batch in batches:
            data, offsets, _ = C.text_bytes(batch)
            found = m.matches(data, offsets)
            rows = [f[0] for f in found]
            ids = [m.ids[f[1]] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(ids, pa.int64()), *(pa.array([f[k] for f in found], pa.int64()) for k in (2, 3, 4))], names=["doc_id", "item_id", "first_word", "n_words", "n_equal"])

    return run


def contaminations(docs: DataFrame, benchmark: DataFrame, overlap: int = OVERLAP, similarity: float = SIMILARITY, block_words: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, first_word, n_words, n_equal: one row for each row of docs and item that overlap.

    Null or wordless texts and items overlap nothing; null ids are carried; repeated rows each give their own rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, first_word long, n_words long, n_equal long"
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, block_words):
        matcher = spark.sparkContext.broadcast(Matcher(block, overlap, similarity))
        out = out.unionByName(source.mapInArrow(_pairs(matcher), schema))
    return out


def _clean(matcher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = C.text_bytes(batch)
            keep = [True] * batch.num_rows
            for row, *_ in matcher.value.matches(data, offsets):
                keep[row] = False
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def without_benchmarks(docs: DataFrame, benchmark: DataFrame, overlap: int = OVERLAP, similarity: float = SIMILARITY, block_words: int = 2_000_000) -> DataFrame:
    """The rows of docs that overlap no item, with all their columns."""
    for block in _blocks(benchmark, block_words):
        matcher = docs.sparkSession.sparkContext.broadcast(Matcher(block, overlap, similarity))
        docs = docs.mapInArrow(_clean(matcher), docs.schema)
    return docs
