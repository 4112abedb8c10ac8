"""Near-duplicate passages by compact windows.

Words are lower-cased runs of letters, digits and non-ASCII characters; a text's tokens are the hashes of its five-word
shingles, and two passages of at least 50 words are near duplicates if their token sets have a Jaccard similarity of at
least 0.8. A word put in, left out or changed costs such passages eight tokens or more that only one has, so passages
of that similarity have a stretch of 25 equal words (21 tokens): with b places where they differ they share m tokens,
m >= 4 * 8 b, in b + 1 stretches. (Passages that repeat their own shingles over and over are outside this argument.)

The values that are min-hashed are therefore seeds of 15 words, and compact windows are those of the Cartesian tree over
the seeds' hashes that span 11 seeds, which is 25 words: the stretches that begin in [l, c] and end in [c, r] have their
min-hash at seed c. Every stretch of 25 equal words has its least seed in both texts at the same word, so one hash
function finds all of them, where min-hashes of the passages themselves would need several and find nearly all. Windows
of equal min-hash are joined if what they span around c has room for a stretch in both.

Each window is joined with the first of its group, text pair by text pair, and the longest stretches around c are sought
that have the similarity, gaps included, and 50 words each. The windows that are not verified with the first text of
their group are grouped anew, again and again: each is compared with the first window of each class so far, until one
is similar, and else begins a class with it. So every two windows of equal min-hash are in one class by verified links,
or were told apart.

Equal texts are one text in all this. No group of windows is gathered: its first text comes from a partial aggregate,
the rest is an equi-join. Texts are read back by pointer from the shared folder.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C
from .suffix_dedup import _lists, merge_spans

WORDS, SHINGLE, SIMILARITY = 50, 5, 0.8
#: Words that passages of that length and similarity have in one stretch, words of a seed, and seeds of such a stretch.
STRETCH, SEED = 25, 15
WIDTH = STRETCH - SEED + 1
_PIECE = 1 << 22
#: Bits for how far a window reaches on either side of its seed, of which no more than WIDTH - 1 matters.
_BITS = 4
_REACH = (1 << _BITS) - 1
#: Tokens around a seed up to which it is remembered that they led to nothing.
_REPEATED = 1024
#: Tokens on either side of a seed in which windows grouped anew are compared: room for a passage of the least length.
_CONTEXT = 128
#: Windows with different tokens around them that a task compares with each other.
_GATHERED = 4096
#: Tokens of first texts that a verifying task keeps.
_HELD = 4_000_000


def shingles_of(words: np.ndarray, size: int) -> np.ndarray:
    """The hashes of all runs of size words, from the words' hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, C.U64)
    sums = np.concatenate((np.zeros(1, C.U64), np.cumsum(words * C.powers(len(words)))))
    return C.mix((sums[size:] - sums[:-size]) * C.powers(n, C.BASE_INVERSE) + C.U64(size))


def words_of(raw: bytes | np.ndarray) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else raw
    return C.words_of(data, np.array([0, len(data)]))[2]


def tokens_of(raw: bytes | np.ndarray) -> np.ndarray:
    """The shingle hashes of a text."""
    return shingles_of(words_of(raw), SHINGLE)


def compact_windows(values: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(l, c, r) of the Cartesian-tree nodes that span at least width values; the leftmost of equal values is the least.

    Only the least values of some stretch of that width can be such nodes, and between them lie all smaller values that
    bound them, so the tree is built over those alone.
    """
    n = len(values)
    if n < width:
        return []
    packed = (values & ~C.U64((1 << 24) - 1)) | np.arange(n, dtype=C.U64)
    least = C.sliding_min(packed, width)
    least = least[np.concatenate(([True], least[1:] != least[:-1]))]
    at = (least & C.U64((1 << 24) - 1)).astype(np.int64).tolist()
    v = least.tolist()
    left, right, stack = [0] * len(v), [n - 1] * len(v), []
    for i, x in enumerate(v):
        while stack and v[stack[-1]] > x:
            right[stack.pop()] = at[i] - 1
        left[i] = at[stack[-1]] + 1 if stack else 0
        stack.append(i)
    return list(zip(left, at, right, strict=True))


def windows_of(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compact windows of the texts whose words begin at first (and end where the next ones do): keys, places, and texts' ends.

    A place has the seed's place in its text and how far the window reaches on either side, no more than WIDTH - 1, in
    one word. As farther reaches do not matter, they come from comparing seeds with their neighbours, for all texts at
    once, and not from the tree, whose nodes these are.
    """
    keys, places, texts = [], [], []
    sizes = np.diff(first)
    for lo, hi in C.groups_of(sizes, _PIECE):
        for base in range(0, max(1, int(sizes[lo:hi].max(initial=0)) - STRETCH + 1), _PIECE) if hi - lo == 1 else (0,):
            begin, end = int(first[lo]) + base, min(int(first[hi]), int(first[lo]) + base + _PIECE + STRETCH - 1) if hi - lo == 1 else int(first[hi])
            part = words[begin:end]
            if len(part) < STRETCH:
                continue
            seeds = shingles_of(part, SEED)
            packed = (seeds & ~C.U64((1 << 24) - 1)) | np.arange(len(seeds), dtype=C.U64)
            # The text of each stretch, and its bounds as seeds.
            edges = np.clip(first[lo : hi + 1] - begin, 0, len(part))
            text = np.searchsorted(edges, np.arange(len(part) - STRETCH + 1), "right") - 1
            whole = (np.arange(len(text)) + STRETCH <= edges[text + 1]) & (sizes[lo + text] >= WORDS)
            least, text = C.sliding_min(packed, WIDTH)[whole], text[whole]
            if not len(least):
                continue
            new = np.concatenate(([True], least[1:] != least[:-1]))
            least, text = least[new], text[new]
            c = (least & C.U64((1 << 24) - 1)).astype(np.int64)
            reach = []
            for step, bound in ((-1, edges[text]), (1, edges[text + 1] - SEED)):
                far, on = np.zeros(len(c), np.int64), np.ones(len(c), bool)
                for k in range(1, WIDTH):
                    to = c + step * k
                    on &= (to >= bound) if step < 0 else (to <= bound)
                    on &= packed[np.clip(to, 0, len(packed) - 1)] > least
                    far += on
                reach.append(far)
            keys.append(seeds[c].view(np.int64))
            places.append((c - edges[text] + base) << (2 * _BITS) | reach[0] << _BITS | reach[1])
            texts.append(text + lo)
    none = np.zeros(0, np.int64)
    keys, places, texts = (np.concatenate(x) if x else none for x in (keys, places, texts))
    return keys, places, np.searchsorted(texts, np.arange(len(sizes)), "right")


_INDEX = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("n_words", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("key", pa.list_(pa.int64())), ("place", pa.list_(pa.int64()))])
_INDEX_SQL = "doc_id long, rid long, t1 long, t2 long, n_words long, file string, offset long, length long, key array<long>, place array<long>"


def _index(folder: str):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, n, blobs = TaskContext.get().partitionId(), 0, None
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                data, offsets, _ = C.text_bytes(batch)
                blobs = blobs or C.Blobs(folder, partition)
                *_, hashes, first = C.words_of(data, offsets)
                keys, places, ends = windows_of(hashes, first)
                ends, sizes = pa.array(np.concatenate(([0], ends)).astype(np.int32)), np.diff(first).tolist()
                rows = []
                for i in range(batch.num_rows):
                    raw = data[offsets[i] : offsets[i + 1]].tobytes()
                    x = xxhash.xxh128_intdigest(raw)
                    rows.append((partition << 36 | n, (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63), sizes[i], blobs.path, *blobs.add(raw)))
                    n += 1
                kinds = [f.type for f in _INDEX][1:8]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (keys, places))], schema=_INDEX)
        if blobs:
            blobs.close()

    return build


def _stretch(shared: np.ndarray, c: int) -> tuple[int, int]:
    """The stretch around c of most shared tokens, where one that is not outweighs four."""
    score = np.where(shared, 1, -4)
    right = int(np.argmax(np.cumsum(score[c:]))) + c
    left = c - int(np.argmax(np.cumsum(score[c::-1])))
    return left, right


def _same(x: np.ndarray, y: np.ndarray) -> int:
    """How many first values of both are the same."""
    n, at, step = min(len(x), len(y)), 0, 64
    while at < n:
        other = x[at : min(n, at + step)] != y[at : min(n, at + step)]
        if other.any():
            return at + int(other.argmax())
        at, step = at + step, step * 4
    return n


def equal_run(a: np.ndarray, b: np.ndarray, c: int, d: int) -> tuple[int, int, int, int]:
    """The run of equal tokens that holds token c of a and token d of b: begin and end in each."""
    left, right = _same(a[: c + 1][::-1], b[: d + 1][::-1]) - 1, _same(a[c:], b[d:])
    return c - left, c + right, d - left, d + right


def _among(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which values of x are in y, of which there are some."""
    have = np.sort(y)
    return have[np.minimum(np.searchsorted(have, x), len(have) - 1)] == x


def _span(shared: np.ndarray, c: int, loss: float) -> tuple[int, int]:
    """First and last place of all stretches around c that share loss times the tokens they do not, or more."""
    score = np.where(shared, 1, -loss)
    right, left = np.cumsum(score[c:]), np.cumsum(score[c::-1])
    least = score[c] - 1e-6
    return c - int(np.flatnonzero(left + right.max() >= least)[-1]), c + int(np.flatnonzero(right + left.max() >= least)[-1])


def _arm(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where an arm of a passage may end: steps from c in both texts, and tokens of both on the way there, in order.

    p and q are the steps from c of the tokens that both texts have, p ascending. The places are the ends of runs of
    equal tokens, and 0; the tokens on the way are those of the best chain of runs that ascends in both texts.
    """
    p, q = p[q > 0], q[q > 0]
    if not len(p):
        return np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
    cut = np.flatnonzero((np.diff(p) != 1) | (np.diff(q) != 1)) + 1
    begin, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(p)])) - 1
    p0, q0, p1, q1, n = p[begin], q[begin], p[end], q[end], end - begin + 1
    best = np.cumsum(n)
    for k in range(1, len(n)) if (q0[1:] <= q1[:-1]).any() else ():
        best[k] = n[k]
        before = best[:k][(q1[:k] < q0[k]) & (p1[:k] < p0[k])]
        if len(before):
            best[k] += before.max()
    zero = np.zeros(1, np.int64)
    return np.concatenate((zero, p1)), np.concatenate((zero, q1)), np.concatenate((zero, best))


def _padded(lo: int, hi: int, size: int, width: int) -> tuple[int, int]:
    """The stretch lo..hi (end excluded), widened to width tokens of size."""
    hi = min(size, max(hi, lo + width))
    return max(0, min(lo, hi - width)), hi


def near_passage(a: np.ndarray, b: np.ndarray, at: tuple[int, int, int], bt: tuple[int, int, int], width: int, similarity: float = SIMILARITY, grows: bool = False) -> tuple[int, int, int, int, bool, bool]:
    """The longest stretches around c, within the windows (c, left and right reach), of a similarity, width tokens or more.

    With m tokens of both and u of one only, the similarity is 0.8 or more as long as m >= 4 u, wherever in the stretches the
    gaps are: an arm that loses by a gap can be paid by the other one. Tokens at the ends count where width needs them.
    The last values say whether there are such stretches, and whether all that could belong to them lies within the
    windows, or ends with a text: then other c in the same run of equal tokens, in windows that are no wider, lead to
    the same ones. With grows, windows too narrow for that are not looked into.
    """
    a0, b0 = at[0] - at[1], bt[0] - bt[1]
    x, y, cx, cy = a[a0 : at[0] + at[2] + 1], b[b0 : bt[0] + bt[2] + 1], at[1], bt[1]
    loss = similarity / (1 - similarity)
    shared = _among(x, y)
    lx, rx = _span(shared, cx, loss)
    back = _among(y, x[lx : rx + 1])
    ly, ry = _span(back, cy, loss)
    inner = (lx > 0 or a0 == 0) and (ly > 0 or b0 == 0) and (rx < len(x) - 1 or a0 + rx == len(a) - 1) and (ry < len(y) - 1 or b0 + ry == len(b) - 1)
    none = (at[0], at[0] + 1, bt[0], bt[0] + 1, False, inner)
    if min(rx - lx, ry - ly) + 1 < width or grows and not inner:
        return none
    here, yonder = x[lx : rx + 1], y[ly : ry + 1]
    # Shared tokens pay for those of either text alone: half of them on each side.
    balance = _balance(here, _among(here, yonder), cx - lx, width, loss)
    if balance == -np.inf or balance + _balance(yonder, back[ly : ry + 1], cy - ly, width, loss) < -1e-6:
        return none
    # Where a token of x stands in y: nearest to the diagonal through c.
    order = np.argsort(y[ly : ry + 1], kind="stable")
    there = y[ly : ry + 1][order]
    first, last = np.searchsorted(there, here), np.searchsorted(there, here, "right")
    p = np.flatnonzero(first < last)
    q = order[first[p]] + ly - cy
    several = np.flatnonzero(last[p] - first[p] > 1)
    if len(several):
        rank, size = np.cumsum(np.concatenate(([0], there[1:] != there[:-1]))), len(order) + 1
        target = p[several] + lx - cx + cy - ly
        after = np.searchsorted(rank * size + order, rank[first[p[several]]] * size + np.clip(target, 0, size - 1))
        low = np.clip(after - 1, first[p[several]], last[p[several]] - 1)
        high = np.clip(after, first[p[several]], last[p[several]] - 1)
        q[several] = np.where(np.abs(order[low] - target) <= np.abs(order[high] - target), order[low], order[high]) + ly - cy
    p = p + lx - cx
    pr, qr, mr = _arm(p[p > 0], q[p > 0])
    pl, ql, ml = _arm(-p[p < 0][::-1], -q[p < 0][::-1])
    best = (0, 0.0)
    for i in range(0, len(pl), max(1, 200_000 // len(pr))):
        own = slice(i, i + max(1, 200_000 // len(pr)))
        nx, ny = np.maximum(pl[own, None] + pr + 1, width), np.maximum(ql[own, None] + qr + 1, width)
        m = ml[own, None] + mr + 1
        score = m - loss * (nx + ny - 2 * m)
        size = np.where(score >= -1e-6, nx + ny, 0)
        j, k = np.unravel_index(int(np.where(size == size.max(), score, -np.inf).argmax()), size.shape)
        if (int(size[j, k]), float(score[j, k])) > best:
            best = int(size[j, k]), float(score[j, k])
            sx, ex = _padded(cx - int(pl[i + j]), cx + int(pr[k]) + 1, len(x), width)
            sy, ey = _padded(cy - int(ql[i + j]), cy + int(qr[k]) + 1, len(y), width)
            found = sx, ex, sy, ey
    if best[0] and similar(x[found[0] : found[1]], y[found[2] : found[3]], similarity):
        return a0 + found[0], a0 + found[1], b0 + found[2], b0 + found[3], True, inner
    # Passages whose parts stand in another order, or repeat, may be similar without such a chain.
    lo, hi = _stretch(shared, cx)
    if hi - lo + 1 < width:
        return none
    t, f = _stretch(_among(y, x[lo : hi + 1]), cy)
    if f - t + 1 < width:
        return none
    lo, hi = _stretch(_among(x, y[t : f + 1]), cx)
    if hi - lo + 1 >= width and similar(x[lo : hi + 1], y[t : f + 1], similarity):
        return a0 + lo, a0 + hi + 1, b0 + t, b0 + f + 1, True, inner
    return none


def _sums(x: np.ndarray, y: np.ndarray, loss: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums before each place of x where a token that y has, anywhere, counts 1 and others -loss; least so far, and most to come."""
    sums = np.concatenate(([0.0], np.cumsum(np.where(_among(x, y), 1.0, -loss))))
    return sums, np.minimum.accumulate(sums[:-1]), np.maximum.accumulate(sums[:0:-1])[::-1]


def _widest(sums: tuple[np.ndarray, np.ndarray, np.ndarray], c: int) -> tuple[int, int]:
    """First and last place of all stretches around c, which both texts have, whose sum is not negative."""
    _, low, high = sums
    return min(c, int(np.searchsorted(-low, -high[c] - 1e-6))), max(c, int(np.searchsorted(-high, 1e-6 - low[c], "right")) - 1)


def dense(sums: tuple[np.ndarray, np.ndarray, np.ndarray], width: int) -> np.ndarray:
    """Which places of a text lie in a stretch of width or more of whose tokens so many are shared as a similar passage needs."""
    before, n = sums[0], len(sums[0]) - 1
    # The farthest end of a stretch from each place with a sum that is not negative.
    end = n - np.searchsorted(np.maximum.accumulate(before[::-1]), before[:-1] - 1e-6)
    begin = np.flatnonzero(end - np.arange(n) >= width)
    steps = np.bincount(begin, minlength=n + 1) - np.bincount(end[begin], minlength=n + 1)
    return np.cumsum(steps)[:n] > 0


def _best(score: np.ndarray, c: int, width: int) -> float:
    """The largest sum of a stretch around c, of width or more."""
    sums = np.concatenate(([0.0], np.cumsum(score)))
    last = np.arange(max(c, width - 1), len(score))
    return float((sums[last + 1] - np.minimum.accumulate(sums[: c + 1])[np.minimum(c, last - width + 1)]).max(initial=-np.inf))


def _balance(x: np.ndarray, shared: np.ndarray, c: int, width: int, loss: float) -> float:
    """The most that a stretch around c has of half its shared tokens less loss times the others; none if too few are shared.

    A token that repeats counts where it stands nearest to c on either side; one that is not shared, half where both
    sides have it.
    """
    (right, r), (left, l) = np.unique(x[c:], return_index=True), np.unique(x[:c][::-1], return_index=True)
    if len(right) + len(left) == len(x) and not _meet(right, left):
        gain, cost = 1.0, loss
    else:
        gain, cost = np.zeros(len(x)), np.zeros(len(x))
        for tokens, others, places in ((right, left, c + r), (left, right, c - 1 - l)):
            gain[places] = 1
            cost[places] = np.where(_among(tokens, others), loss / 2, loss) if len(others) and len(tokens) else loss
    if _best(np.where(shared, gain, -cost), c, width) < -1e-6:
        return -np.inf
    return _best(np.where(shared, gain / 2, -cost), c, width)


def _meet(x: np.ndarray, y: np.ndarray) -> bool:
    return bool(len(x) and len(y) and _among(x, y).any())


def goes_on(a: np.ndarray, b: np.ndarray, run: tuple[int, int, int, int], width: int) -> bool:
    """Whether tokens of both texts stand near enough to the ends of a run of equal tokens to lengthen the passage."""
    s, e, t, f = run
    near = (e - s + width) // 4 + 1
    return bool(_meet(a[e : e + near], b[f : f + near]) or _meet(a[max(0, s - near) : s], b[max(0, t - near) : t]))


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    ux, uy = np.unique(x), np.unique(y)
    common = len(np.intersect1d(ux, uy, assume_unique=True))
    return common >= similarity * (len(ux) + len(uy) - common)


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("a_first", pa.int64()), ("a_end", pa.int64()), ("b_first", pa.int64()), ("b_end", pa.int64()), ("key", pa.int64()), ("place", pa.int64())])
_FOUND_SQL = ", ".join(f"{c} long" for c in _FOUND.names)


class _Texts:
    """Tokens of texts by pointer; those used last are kept."""

    def __init__(self, held: int = _HELD) -> None:
        self.reader, self.tokens, self.room = C.BlobReader(), OrderedDict(), held

    def get(self, rid: int, where: tuple[str, int, int]) -> np.ndarray:
        if rid not in self.tokens:
            self.tokens[rid] = tokens_of(self.reader.get(*where))
            self.room -= len(self.tokens[rid])
            while self.room < 0 and len(self.tokens) > 1:
                self.room += len(self.tokens.popitem(last=False)[1])
        self.tokens.move_to_end(rid)
        return self.tokens[rid]


def _passage(a: np.ndarray, b: np.ndarray, c: int, d: int, width: int, similarity: float, known: dict) -> tuple[tuple[int, int, int, int] | None, bool]:
    """The stretches around seed c of a and d of b, or None; and whether they are new.

    known has the runs of equal tokens of these two texts that were looked at, by their diagonal, with what they led to,
    the stretches found, which later seeds inside them are not looked at again for, and what of b led to nothing, as
    texts that repeat a line have the same there again and again. What is looked at is all that stretches around
    both seeds may take up, as far as the tokens go that the other text has anywhere.
    """
    runs, stretches, nothing = known.setdefault(c - d, []), known.setdefault("found", []), known.setdefault("nothing", set())
    for s, e, was in runs:
        if s <= c < e:
            return was, False
    for was in reversed(stretches):
        if was[0] <= c < was[1] and was[2] <= d < was[3]:
            return was, False
    s, e, t, f = run = equal_run(a, b, c, d)
    found = run if e - s >= width else None
    if e - s >= STRETCH - SHINGLE + 1 and (not found or goes_on(a, b, run, width)):
        if "sums" not in known:
            loss = similarity / (1 - similarity)
            known["sums"] = _sums(a, b, loss), _sums(b, a, loss)
        (lx, rx), (ly, ry) = (_widest(x, i) for x, i in zip(known["sums"], (c, d), strict=True))
        if min(rx - lx, ry - ly) + 1 >= width:
            again = (c, d - ly, b[ly : ry + 1].tobytes()) if ry - ly < _REPEATED else None
            if again not in nothing:
                *near, ok, _ = near_passage(a, b, (c, c - lx, rx - c), (d, d - ly, ry - d), width, similarity)
                found = tuple(near) if ok else found
                if not ok and again:
                    nothing.add(again)
    runs.append((s, e, found))
    if found:
        stretches.append(found)
    return found, True


def _found(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_FOUND)


def _words(found: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    s, e, t, f = found
    return s, e + SHINGLE - 1, t, f + SHINGLE - 1


_POINTERS = ("file", "offset", "length")


def _room(a: int, b: int) -> bool:
    """Whether the windows at two places both span some WIDTH seeds, counted from theirs."""
    return min(a >> _BITS & _REACH, b >> _BITS & _REACH) + min(a & _REACH, b & _REACH) >= WIDTH - 1


def _verify(width: int, similarity: float):
    """Verified pairs of windows whose stretches are new have them; those that are not verified have the key and b's place."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, others = _Texts(), _Texts(0)  # many meet the texts that came first in their groups
        loss = similarity / (1 - similarity)
        for batch in batches:
            out = []
            for ra, rb, seeds, *where in zip(*(C.column(batch, c) for c in ("a", "b", "seeds", *(f"{x}_{c}" for x in "ab" for c in _POINTERS))), strict=True):
                a, b = firsts.get(ra, where[:3]), others.get(rb, where[3:])
                known: dict = {"sums": (_sums(a, b, loss), _sums(b, a, loss))}
                near_a, near_b = (dense(x, width) for x in known["sums"])
                for seed in seeds:
                    c, d = seed["a_place"] >> 2 * _BITS, seed["b_place"] >> 2 * _BITS
                    hopeful = near_a[c] and near_b[d] and _room(seed["a_place"], seed["b_place"])
                    found, new = _passage(a, b, c, d, width, similarity, known) if hopeful else (None, False)
                    if not found:
                        out.append((ra, rb, None, None, None, None, seed["key"], seed["b_place"]))
                    elif new:
                        out.append((ra, rb, *_words(found), None, None))
                if len(out) >= 10_000:
                    yield _found(out)
                    out = []
            if out:
                yield _found(out)
        for texts in (firsts, others):
            texts.reader.close()

    return verify


_PLACE_SQL = "key long, rid long, place long, around long"


def _context(tokens: np.ndarray, c: int) -> tuple[int, np.ndarray]:
    """Where what stands around seed c begins, and its tokens."""
    begin = max(0, c - _CONTEXT)
    return begin, tokens[begin : c + _CONTEXT + 1]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A hash of the tokens around each window's seed; windows come text by text."""
    texts = _Texts(0)
    for batch in batches:
        out = []
        for key, rid, place, *where in zip(*(C.column(batch, c) for c in ("key", "rid", "place", *_POINTERS)), strict=True):
            begin, near = _context(texts.get(rid, where), place >> 2 * _BITS)
            out.append((key, rid, place, xxhash.xxh64_intdigest(near.tobytes(), (place >> 2 * _BITS) - begin) - (1 << 63)))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["key", "rid", "place", "around"])
    texts.reader.close()


_TOKENS_SQL = "key long, rid long, place long, token long, least long"


def least_different(tokens: np.ndarray, c: int, width: int) -> int:
    """How many different tokens any stretch around c of the least length has at least."""
    order = np.argsort(tokens, kind="stable")
    before = np.full(len(tokens), -1)
    again = tokens[order[1:]] == tokens[order[:-1]]
    if not again.any():
        return min(width, len(tokens))
    before[order[1:][again]] = order[:-1][again]
    begin = np.arange(max(0, c - width + 1), max(0, min(c, len(tokens) - width)) + 1)
    return int((np.lib.stride_tricks.sliding_window_view(before, min(width, len(tokens)))[begin] < begin[:, None]).sum(axis=1).min())


def needed(least: np.ndarray, least_of_group: np.ndarray, similarity: float) -> np.ndarray:
    """Different tokens that a window shares at least with any similar one, from those its stretches have at least."""
    return np.ceil(np.maximum(similarity * least, similarity / (1 + similarity) * (least + least_of_group)) - 1e-6).astype(np.int64)


def _context_tokens(width: int):
    def context_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each different token around a window's seed; windows come text by text."""
        texts = _Texts(0)
        for batch in batches:
            for key, rid, place, *where in zip(*(C.column(batch, c) for c in ("key", "rid", "place", *_POINTERS)), strict=True):
                begin, near = _context(texts.get(rid, where), place >> 2 * _BITS)
                tokens = np.unique(near).view(np.int64)
                alike = (key, rid, place), least_different(near, (place >> 2 * _BITS) - begin, width)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(tokens), x, np.int64)) for x in alike[0]), pa.array(tokens), pa.array(np.full(len(tokens), alike[1], np.int64))], names=["key", "rid", "place", "token", "least"])
        texts.reader.close()

    return context_tokens


_GROUP = ("key", "token", "low", "high")
_CARRIED_SQL = "key long, token long, low long, high long, side long, rid long, place long, class long, begin long, tokens array<int>"


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens around each window's seed, half of each hash; windows come text by text."""
    texts = _Texts(0)
    for whole in batches:
        for lo in range(0, whole.num_rows, 2000):
            batch = whole.slice(lo, 2000)
            begins, parts = [], []
            for rid, place, *where in zip(*(C.column(batch, c) for c in ("rid", "place", *_POINTERS)), strict=True):
                begin, near = _context(texts.get(rid, where), place >> 2 * _BITS)
                begins.append(begin)
                parts.append(near.astype(np.uint32).view(np.int32))
            names = [*_GROUP, "side", "rid", "place", "class"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(begins, pa.int64()), _lists(parts, pa.int32())], names=[*names, "begin", "tokens"])
    texts.reader.close()


_MORE = pa.schema([*_FOUND, ("b_place", pa.int64()), ("for_a", pa.bool_()), ("for_b", pa.bool_())])
_MORE_SQL = _FOUND_SQL + ", b_place long, for_a boolean, for_b boolean"


class _Group:
    """Windows of one group in the order they come; compare() has verified pairs of texts that were not linked before.

    Two windows are a candidate pair if they share a token beyond those that each can share with others and still be
    told apart: of two that share so many tokens as similar ones need, the one that fewest windows have is among all but
    the needed - 1 most frequent ones of either. A candidate pair is looked at if each has a stretch around its seed, of
    the least length, of whose tokens enough are in the other one, wherever they are there, so that both together may be
    similar. It is verified if no chain of verified pairs links the two, or if one has not met a similar window yet:
    so windows of one class stay so, and each has the first window that is similar to it, whatever else is in the group.
    """

    def __init__(self, width: int, similarity: float) -> None:
        self.width, self.similarity, self.loss = width, similarity, similarity / (1 - similarity)
        self.rows: list[tuple[int, int, int, np.ndarray, int, int, int]] = []

    def add(self, rid: int, place: int, begin: int, tokens: np.ndarray, class_: int, side: int) -> None:
        self.rows.append((rid, begin, (place >> 2 * _BITS) - begin, tokens, class_, side, place))

    def _shared(self, class_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a window and a token by which it meets windows of other classes, by window."""
        n = len(self.rows)
        names, flat = np.unique(np.concatenate([r[3] for r in self.rows]), return_inverse=True)
        own = np.unique(np.repeat(np.arange(n), [len(r[3]) for r in self.rows]) * len(names) + flat)
        window, token = np.divmod(own, len(names))
        count = np.bincount(token)
        different = np.bincount(window)
        least = np.array([min(self.width, d) if d == len(r[3]) else least_different(r[3], r[2], self.width) for r, d in zip(self.rows, different.tolist(), strict=True)])
        order = np.lexsort((token, -count[token], window))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.repeat(np.cumsum(different) - different, different)
        keep = (rank >= needed(least, least.min(), self.similarity)[window] - 1) & (count[token] > 1)
        window, token = window[keep], token[keep]
        low, high = np.full(len(names), n), np.full(len(names), -1)
        np.minimum.at(low, token, class_[window])
        np.maximum.at(high, token, class_[window])
        mixed = low[token] < high[token]
        window, token = window[mixed], token[mixed]
        # Tokens that the same windows have lead to the same pairs: one of them stands for all.
        have, token = np.unique(token, return_inverse=True)
        alike = np.zeros(len(have), C.U64)
        np.add.at(alike, token, C.mix(np.arange(1, n + 1, dtype=C.U64))[window])
        stands = np.zeros(len(have), bool)
        stands[np.unique(alike, return_index=True)[1]] = True
        return window[stands[token]], token[stands[token]]

    def compare(self) -> list[tuple]:
        """Rows of _MORE: verified pairs, and for which of both the other one is the first that is similar."""
        out: list[tuple] = []
        if len(self.rows) < 2:
            return out
        class_ = np.unique([r[4] for r in self.rows], return_inverse=True)[1]
        if not class_.any():
            return out
        window, token = self._shared(class_)
        if not len(window):
            return out
        # Only the windows that may meet another one go on.
        use, window = np.unique(window, return_inverse=True)
        self.rows, class_ = [self.rows[i] for i in use.tolist()], class_[use]
        n, before = len(self.rows), class_.copy()
        token = np.unique(token, return_inverse=True)[1]
        by_token = np.argsort(token, kind="stable")
        members, ends = window[by_token], np.cumsum(np.bincount(token))[token].tolist()
        # Where each window stands among the members of its tokens; those after it are the ones that it meets.
        after = np.empty(len(token), np.int64)
        after[by_token] = np.arange(1, len(token) + 1)
        after, first_token = after.tolist(), np.searchsorted(window, np.arange(n + 1)).tolist()
        side, met = np.array([r[5] for r in self.rows]), np.zeros(n, bool)
        halves = len(np.unique(side)) > 1

        names, flat = np.unique(np.concatenate([r[3] for r in self.rows]), return_inverse=True)
        # The tokens' numbers, all seeds in one column; the last number is that of no token. A token that repeats counts
        # where it stands nearest to the seed, on either side; if only one of two texts has it, half where both sides do.
        grid = np.full((n, 2 * _CONTEXT + 1), len(names), np.int32)
        gain, cost = np.zeros(grid.shape, np.float32), np.full(grid.shape, 1e4, np.float32)
        at = 0
        for i, (_, _, c, x, *_) in enumerate(self.rows):
            ids = flat[at : at + len(x)]
            grid[i, _CONTEXT - c : _CONTEXT - c + len(x)] = ids
            at += len(x)
            if len(set(ids.tolist())) == len(x):
                gain[i, _CONTEXT - c : _CONTEXT - c + len(x)], cost[i, _CONTEXT - c : _CONTEXT - c + len(x)] = 1, self.loss
                continue
            (right, r), (left, l) = np.unique(ids[c:], return_index=True), np.unique(ids[:c][::-1], return_index=True)
            cost[i, _CONTEXT - c : _CONTEXT - c + len(x)] = 0
            for tokens, others, places in ((right, left, _CONTEXT + r), (left, right, _CONTEXT - 1 - l)):
                gain[i, places] = 1
                cost[i, places] = np.where(_among(tokens, others), self.loss / 2, self.loss) if len(others) else self.loss
        mine = np.zeros(len(names) + 1, bool)

        first = np.minimum(_CONTEXT, np.arange(_CONTEXT, 2 * _CONTEXT + 1) - self.width + 1)

        def best(score: np.ndarray) -> np.ndarray:
            """The largest sum of a stretch around the seed, of the least length or more, in each row."""
            sums = np.cumsum(score, axis=1)
            low = np.minimum.accumulate(np.concatenate((np.zeros((len(score), 1), np.float32), sums[:, :_CONTEXT]), axis=1), axis=1)
            return (sums[:, _CONTEXT:] - low[:, first]).max(axis=1)

        def dense(i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Which of the others have a stretch of enough tokens that window i has too, and their share of the balance."""
            mine[grid[i]] = True
            mine[-1] = False
            have = mine[grid[others]]
            mine[grid[i]] = False
            some = np.flatnonzero(best(np.where(have, gain[others], -cost[others])) >= -1e-3)
            use = others[some]
            return use, best(np.where(have[some], gain[use] / 2, -cost[use])) if len(use) else np.zeros(0)

        def back(i: int, use: np.ndarray) -> np.ndarray:
            """The balance of window i with each of the others in use; none where too few of its tokens are in them."""
            out = np.full(len(use), -np.inf)
            step = max(1, 20_000_000 // len(mine))
            for lo in range(0, len(use), step):
                own = use[lo : lo + step]
                theirs = np.zeros((len(own), len(mine)), bool)
                theirs[np.arange(len(own))[:, None], grid[own]] = True
                theirs[:, -1] = False
                have = theirs[:, grid[i]]
                enough = best(np.where(have, gain[i], -cost[i])) >= -1e-3
                out[lo : lo + step][enough] = best(np.where(have[enough], gain[i] / 2, -cost[i])) if enough.any() else 0
            return out

        for i in range(n - 1):
            own = slice(first_token[i], first_token[i + 1])
            lists = [members[a:e] for a, e in zip(after[own], ends[own], strict=True) if a < e]
            if not lists:
                continue
            others = np.unique(np.concatenate(lists))
            others = others[(before[others] != before[i]) & ((class_[others] != class_[i]) | ~met[others] | ~met[i])]
            if halves:
                others = others[side[others] != side[i]]
            use, balance = dense(i, others) if len(others) else (others, others)
            # Shared tokens pay for those of either text alone: half of them on each side.
            for j in use[balance + back(i, use) >= -1e-3].tolist() if len(use) else ():
                (ra, a0, c, x, *_, pa_), (rb, b0, d, y, *_, pb) = self.rows[i], self.rows[j]
                if ra == rb or class_[i] == class_[j] and met[i] and met[j]:
                    continue
                found = _passage(x, y, c, d, self.width, self.similarity, {})[0]
                if found:
                    s, e, t, f = found
                    out.append((ra, rb, *_words((a0 + s, a0 + e, b0 + t, b0 + f)), None, pa_, pb, not met[i], not met[j]))
                    class_[class_ == class_[j]] = class_[i]
                    met[i] = met[j] = True
        return out


def _more(rows: list, key: int) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows, strict=True)]
    columns[_MORE.get_field_index("key")] = [key] * len(rows)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MORE, strict=True)], schema=_MORE)


def _regroup(width: int, similarity: float):
    """Verified pairs of the windows of each group; windows come group by group, in order of text and place."""

    def regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, _Group(width, similarity)
        for batch in batches:
            lists = batch.column("tokens")
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i, (*of, side, rid, place, class_, begin) in enumerate(zip(*(C.column(batch, c) for c in (*_GROUP, "side", "rid", "place", "class", "begin")), strict=True)):
                if of != now:
                    if out := group.compare():
                        yield _more(out, now[0])
                    now, group = of, _Group(width, similarity)
                group.add(rid, place, begin, values[ends[i] : ends[i + 1]].copy(), class_, side)
        if out := group.compare():
            yield _more(out, now[0])

    return regroup


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [merge_spans([(x["s"], x["e"]) for x in m or []]) for m in C.column(batch, "marks")]
        spans = [[(0, n)] if copies > 1 and n >= WORDS else s for s, n, copies in zip(spans, C.column(batch, "n_words"), C.column(batch, "copies"), strict=True)]
        flat = pa.array([[x for p in s for x in p] for s in spans], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("class_id"), pa.array([sum(e - s for s, e in x) for x in spans], pa.int64()), flat], names=["doc_id", "n_words", "class_id", "n_dup_words", "spans"])


def near_passages(docs: DataFrame, similarity: float = SIMILARITY, gathered: int = _GATHERED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """index (a row per document), texts (a row per different text: t1, t2, rep, least, copies) and passages.

    passages has the verified pairs (a, b) of texts by their rid, with the words that each side's passage takes, and
    whether these count: they do where one is the first text of the other's group, or the first that is similar to it.
    gathered is how many windows a task compares with each other; the texts that are linked and the passages that count
    do not depend on it.
    """
    width = WORDS - SHINGLE + 1
    # Few rows stand for much work here: so many tasks, however small what they read.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folder = C.local_path(C.fresh_path(docs.sparkSession, "texts"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    index = C.materialize(source.mapInArrow(_index(folder), _INDEX_SQL), "windows")
    texts = C.materialize(index.groupBy("t1", "t2").agg(F.min("rid").alias("rep"), F.min("doc_id").alias("least"), F.count("*").alias("copies")), "texts")
    windows = index.select("rid", F.explode(F.arrays_zip("key", "place")).alias("w")).select("rid", "w.key", "w.place")
    shared = windows.groupBy("key").agg(F.min("rid").alias("a"), F.max("rid").alias("last")).where("a < last").select("key", "a")
    own = windows.join(shared, "key").join(texts.select(F.col("rep").alias("rid")), "rid")
    own = C.materialize(own.select("key", "rid", "place", "a"), "shared")
    first = own.where("rid = a").groupBy("key").agg(F.min("place").alias("a_place"))
    where = index.select("rid", *_POINTERS)
    side = lambda c: where.select(*(F.col(x).alias(c if x == "rid" else f"{c}_{x}") for x in where.columns))
    pairs = own.where("rid <> a").join(first, "key").select("key", "a", "a_place", F.col("rid").alias("b"), F.col("place").alias("b_place"))
    # The first text's other places of a key meet the second text's first one.
    second = own.where("rid <> a").groupBy("key").agg(F.min(F.struct("rid", "place")).alias("w")).select("key", F.col("w.rid").alias("b"), F.col("w.place").alias("b_place"))
    again = own.where("rid = a").join(first, "key").where("place > a_place").select("key", "a", F.col("place").alias("a_place")).join(second, "key")
    pairs = pairs.unionByName(again).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("b_place", "a_place", "key"))).alias("seeds"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    star = C.materialize(pairs.repartition(tasks, F.xxhash64("b")).sortWithinPartitions("b", "a").mapInArrow(_verify(width, similarity), _FOUND_SQL), "star")
    # Under keys where some text was not linked with the first one, here or anywhere, all windows are grouped anew, one
    # for each different surroundings. The others with the same surroundings are linked by them.
    linked = C.materialize(C.components(star.where("key is null").select("a", "b")), "linked")
    of = lambda c: linked.select(F.col("node").alias(c), F.col("component").alias(f"{c}_class"))
    lost = star.where("key is not null").select("key", "a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    lost = C.materialize(lost.where(~(F.col("a_class").eqNullSafe(F.col("b_class"))) | F.col("a_class").isNull()).select("key").distinct(), "lost")
    # Where a text repeats the same words over and over, the first and the last window of such a stretch stand for it.
    order = W.partitionBy("rid", "key").orderBy("place")
    apart = (F.coalesce(F.col("c") - F.lag("c").over(order), F.lit(SEED)) >= SEED) | (F.coalesce(F.lead("c").over(order) - F.col("c"), F.lit(SEED)) >= SEED)
    rest = own.join(lost, "key", "left_semi").select("key", "rid", "place", F.shiftright("place", 2 * _BITS).alias("c")).withColumn("apart", apart).where("apart").select("key", "rid", "place").join(where, "rid")
    rest = C.materialize(rest.repartition("rid").sortWithinPartitions("rid", "place").mapInArrow(_contexts, _PLACE_SQL), "contexts")
    one = rest.groupBy("key", "around").agg(F.min(F.struct("rid", "place")).alias("w")).select("key", "around", F.col("w.rid").alias("a"), F.col("w.place").alias("a_place"))
    seed = lambda c: F.shiftright(c, 2 * _BITS)
    begin = lambda c: F.greatest(seed(c) - _CONTEXT, F.lit(0).cast("long"))
    equal = rest.join(one, ["key", "around"]).where("rid <> a")
    size = index.select("rid", "n_words")
    end = lambda c: F.least(seed(c) + _CONTEXT + SHINGLE, F.col("n_words"))
    equal = equal.join(size, "rid").select("a", F.col("rid").alias("b"), begin("a_place").alias("a_first"), (begin("a_place") + end("place") - begin("place")).alias("a_end"), begin("place").alias("b_first"), end("place").alias("b_end"))
    many = one.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    one = one.join(many, "key").select("key", F.col("a").alias("rid"), F.col("a_place").alias("place"), "n")
    one = C.materialize(one.join(of("rid"), "rid", "left").select("key", "rid", "place", "n", F.coalesce("rid_class", "rid").alias("class")), "several")
    # Groups too large for a task are split by the tokens by which windows are candidate pairs (see _Group), and where too
    # many have such a token, into pairs of parts: whatever the sizes, the same pairs meet.
    hot = one.where(F.col("n") > gathered)
    tokens = C.materialize(hot.join(where, "rid").repartition("rid").sortWithinPartitions("rid", "place").mapInArrow(_context_tokens(width), _TOKENS_SQL), "tokens")
    counts = tokens.groupBy("key", "token").agg(F.count("*").alias("n"))
    least = tokens.groupBy("key").agg(F.min("least").alias("least_of_group"))
    need = F.ceil(F.greatest(F.col("least") * similarity, (F.col("least") + F.col("least_of_group")) * (similarity / (1 + similarity))) - 1e-6)
    rank = F.row_number().over(W.partitionBy("key", "rid", "place").orderBy(F.desc("n"), "token"))
    prefix = tokens.join(counts, ["key", "token"]).join(least, "key").withColumn("rank", rank).where((F.col("rank") >= need) & (F.col("n") > 1)).select("key", "token", "rid", "place")
    parts = prefix.groupBy("key", "token").agg(F.count("*").alias("n")).where("n > 1").select("key", "token", F.when(F.col("n") > gathered, F.ceil(2 * F.col("n") / gathered)).otherwise(1).alias("parts"))
    split = prefix.join(parts, ["key", "token"]).join(hot.select("key", "rid", "place", "class"), ["key", "rid", "place"])
    split = split.withColumn("side", F.pmod(F.xxhash64("rid", "place"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    split = split.select("key", "token", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "rid", "place", "class")
    zero = F.lit(0).cast("long")
    groups = one.where(F.col("n") <= gathered).select("key", *(zero.alias(c) for c in (*_GROUP[1:], "side")), "rid", "place", "class").unionByName(split)
    carried = groups.join(where, "rid").sortWithinPartitions("rid").mapInArrow(_carry, _CARRIED_SQL)
    met = carried.repartition(tasks, *_GROUP).sortWithinPartitions(*_GROUP, "rid", "place").mapInArrow(_regroup(width, similarity), _MORE_SQL)
    met = C.materialize(met, "met")
    # Of the pairs that parts of a group had for a window, the first one counts for its words; all are links.
    spans = [f"{x}_{y}" for x in "ab" for y in ("first", "end")]
    of_a = met.where("for_a").select("key", F.col("a").alias("rid"), F.col("place").alias("own"), F.struct(F.col("b").alias("rid"), F.col("b_place").alias("place"), "a", "b", *spans).alias("w"))
    of_b = met.where("for_b").select("key", F.col("b").alias("rid"), F.col("b_place").alias("own"), F.struct(F.col("a").alias("rid"), F.col("place").alias("place"), "a", "b", *spans).alias("w"))
    nearest = of_a.unionByName(of_b).groupBy("key", "rid", "own").agg(F.min("w").alias("w")).select(*(f"w.{c}" for c in _FOUND.names[:6]))
    marked = nearest.unionByName(equal).unionByName(star.where("key is null").select(*_FOUND.names[:6])).withColumn("counts", F.lit(True))
    more = met.select(*_FOUND.names[:6]).withColumn("counts", F.lit(False))
    passages = C.materialize(marked.unionByName(more), "regrouped")
    return index.select("doc_id", "rid", "t1", "t2", "n_words"), texts, passages


def passage_classes(docs: DataFrame, similarity: float = SIMILARITY, gathered: int = _GATHERED) -> DataFrame:
    """doc_id, n_words, class_id, n_dup_words, spans: one row per row of docs.

    class_id is the smallest doc_id among the documents that near-duplicate passages link, itself included (null only
    if all of them are); equal texts of at least 50 words are linked too. n_dup_words counts the words that passages
    which stand elsewhere cover, spans lists where they begin and end (counted in words). Null texts count as empty;
    texts under 50 words link nothing.
    """
    index, texts, passages = near_passages(docs, similarity, gathered)
    counted = passages.where("counts")
    marks = counted.select(F.col("a").alias("rid"), F.col("a_first").alias("s"), F.col("a_end").alias("e")).unionByName(counted.select(F.col("b").alias("rid"), F.col("b_first").alias("s"), F.col("b_end").alias("e")))
    # A text that many others share passages with has a mark for each first word, not for each of them.
    marks = marks.groupBy("rid", "s").agg(F.max("e").alias("e")).groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("marks"))
    classes = C.components(passages.select("a", "b"))
    named = texts.join(classes, texts.rep == classes.node, "left").select("t1", "t2", "rep", "least", "copies", "component")
    names = named.where("component is not null").groupBy("component").agg(F.min("least").alias("name"))
    named = C.materialize(named.join(names, "component", "left").join(marks, F.col("rep") == F.col("rid"), "left").select("t1", "t2", "copies", "least", "component", "name", "marks"), "named")
    rows = index.join(named, ["t1", "t2"])
    linked = F.when(F.col("component").isNotNull(), F.col("name")).when((F.col("copies") > 1) & (F.col("n_words") >= WORDS), F.col("least")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_words", linked.alias("class_id"), "copies", "marks").mapInArrow(_merge, "doc_id long, n_words long, class_id long, n_dup_words long, spans array<long>")
