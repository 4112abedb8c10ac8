"""Language identification with interpolated Kneser-Ney character models.

One model of order 4 for each language, over lower-cased text with white space folded. Each order is a sorted array of
64-bit n-gram keys (16 bits a character) with a row of log-probabilities, one for each language, all interpolated when
the model is built, so that scoring looks a position up once at the longest order any language has seen. A text's
language is that of the lowest cross-entropy in bits per character.

Rejection is calibrated on texts kept out of the counts: their distances from their language's median, divided by
sqrt(a + b / characters) as short texts vary more (a and b fitted), are pooled over the languages, and the limit is
their conformal quantile at 1 - FALSE_REJECTS (the largest, where there are too few for that quantile), at any length.
What texts of the other languages need in a language's model stands for languages unknown to it: the limit is raised
half the way from there to their lowest hundredth. So no more than FALSE_REJECTS of new texts like these are expected to
be rejected, and at most a hundredth of texts like those of other languages to be taken. A tenth of a language's sampled rows is kept out;
where these are under 20, all its sampled rows are, part after part, and scored by a model of the others. A language of
one row takes the highest median of the others, or else what a model that knows nothing needs.

The models are fitted on a bounded sample of the labelled rows: of each language the `max_docs` rows of least hash, as
far as their texts, taken whole, have `max_chars` characters together (and `total_chars` over all languages); a text
that does not fit any more is left out, later ones that fit are taken. Where none fits, the first is taken in part. These
bounds limit what the driver holds and what is broadcast; every row is scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

ORDER = 4
DISCOUNT = 0.75
MAX_DOCS, MAX_CHARS, TOTAL_CHARS = 2000, 4_000_000, 40_000_000
FALSE_REJECTS = 0.002
CALIBRATION, PARTS = 20, 10
PAD = " " * (ORDER - 1)


def normalize(text: str) -> str:
    return " ".join(text.lower().split())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Alphabet:
    """Numbers for characters: 1 and up for those of the sample, the most frequent first, 0 for all others."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.points = np.array([p for p, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][:65534], np.uint32)
        self.ids = np.zeros(0x110000, np.uint16)
        self.ids[self.points] = np.arange(1, len(self.points) + 1)

    def gram_keys(self, points: np.ndarray) -> np.ndarray:
        """The keys of n-grams given as rows of ORDER code points."""
        x = self.ids[points].astype(C.U64)
        return x[:, 0] << C.U64(48) | x[:, 1] << C.U64(32) | x[:, 2] << C.U64(16) | x[:, 3]

    def keys(self, text: str) -> np.ndarray:
        """The key of the ORDER characters that end at each character of the text, which begins with padding."""
        x = self.ids[_points(text)].astype(C.U64)
        return x[:-3] << C.U64(48) | x[1:-2] << C.U64(32) | x[2:-1] << C.U64(16) | x[3:]


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inverse = np.unique(keys, return_inverse=True)
    return u, np.bincount(inverse, weights=values, minlength=len(u))


def _at(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Models:
    """counts: for each language the keys of its n-grams of the highest order and how often each occurs."""

    def __init__(self, alphabet: Alphabet, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.alphabet, self.languages = alphabet, sorted(counts)
        v = len(alphabet.points) + 1
        grams: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER)]  # by order - 1 and language
        for lang in self.languages:
            keys, n = counts[lang]
            order = np.argsort(keys)
            now = (keys[order], n[order].astype(float))
            grams[ORDER - 1].append(now)
            for k in range(ORDER - 1, 0, -1):
                # Continuation counts: how many different characters stand before a shorter n-gram.
                suffix = now[0] & C.U64((1 << 16 * k) - 1)
                now = _sum_by(suffix, np.ones(len(suffix)))
                grams[k - 1].append(now)
        self.keys = [np.unique(np.concatenate([g[0] for g in by])) if by else np.zeros(0, C.U64) for by in grams]
        self.keys[0] = np.arange(v, dtype=C.U64)
        self.contexts = [np.unique(k >> C.U64(16)) for k in self.keys]
        self.logp, self.backoff = [], []
        size = len(self.languages)
        lower = np.full((v, size), 1 / v)
        for k in range(ORDER):
            keys, contexts = self.keys[k], self.contexts[k]
            p, rest = np.zeros((len(keys), size)), np.ones((len(contexts), size))
            for j, (g, n) in enumerate(grams[k]):
                context, total = _sum_by(g >> C.U64(16), n)
                _, kinds = _sum_by(g >> C.U64(16), np.ones(len(g)))
                at, _ = _at(contexts, context)
                rest[at, j] = DISCOUNT * kinds / total
                at, _ = _at(keys, g)
                where, _ = _at(context, g >> C.U64(16))
                p[at, j] = np.maximum(n - DISCOUNT, 0) / total[where]
            if k:
                at, _ = _at(self.keys[k - 1], keys & C.U64((1 << 16 * k) - 1))
                below = lower[at]
            else:
                below = lower
            at, _ = _at(contexts, keys >> C.U64(16))
            lower = p + rest[at] * below
            self.logp.append(np.log2(lower).astype(np.float32))
            self.backoff.append(np.log2(rest).astype(np.float32))
        self.centres, self.margins, self.spread, self.reach = np.full(size, np.inf), np.zeros(size), (0.0, 0.0), 0.0

    def calibrate(self, kept: list[tuple[np.ndarray, np.ndarray]], rate: float, foreign: list[np.ndarray] | None = None) -> None:
        """Sets the limits of rejection from each language's texts kept out: bits per character in it, and characters;
        and from the bits that other languages' texts need in it."""
        parts = []
        for j, (bits, chars) in enumerate(kept):
            if len(bits):
                self.centres[j] = np.median(bits)
                parts.append((bits - self.centres[j], np.maximum(chars, 1)))
        known = self.centres[np.isfinite(self.centres)]
        self.centres[~np.isfinite(self.centres)] = known.max() if len(known) else np.log2(len(self.alphabet.points) + 1)
        if not parts:
            return
        far, chars = (np.concatenate(x) for x in zip(*parts, strict=True))
        a, b = np.linalg.lstsq(np.stack([np.ones(len(far)), 1 / chars], 1), far**2, rcond=None)[0]
        if b < 0 or a < 0:
            a, b = (float(np.mean(far**2)), 0.0) if b < 0 else (0.0, float(np.mean(far**2 * chars)))
        self.spread = float(max(a, 1e-4)), float(b)
        z = np.sort(far / self.widths(chars))
        self.reach = max(0.0, float(z[min(len(z), int(np.ceil((len(z) + 1) * (1 - rate)))) - 1]))
        for j, bits in enumerate(foreign or []):
            if len(bits):
                self.margins[j] = max(0.0, (np.quantile(bits, 0.01) - self.centres[j] - self.reach * np.sqrt(self.spread[0])) / 2)

    def limit(self, language: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Bits per character above which texts of so many characters are rejected."""
        return self.centres[language] + self.margins[language] + self.reach * self.widths(chars)

    def widths(self, chars: np.ndarray) -> np.ndarray:
        return np.sqrt(self.spread[0] + self.spread[1] / np.maximum(chars, 1))

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """One row for each key, one column for each language; for each key an order that some language has seen."""
        at, hit = _at(self.keys[ORDER - 1], keys)
        out = self.logp[ORDER - 1][at] if len(self.keys[ORDER - 1]) else np.zeros((len(keys), len(self.languages)), np.float32)
        miss = np.flatnonzero(~hit)
        out[miss] = 0
        for k in range(ORDER - 1, 0, -1):
            if not len(miss):
                break
            key = keys[miss] & C.U64((1 << 16 * (k + 1)) - 1)
            at, seen = _at(self.contexts[k], key >> C.U64(16))
            out[miss[seen]] += self.backoff[k][at[seen]]
            at, hit = _at(self.keys[k - 1], key & C.U64((1 << 16 * k) - 1))
            out[miss[hit]] += self.logp[k - 1][at[hit]]
            miss = miss[~hit]
        return out

    def entropies(self, texts: list[str], portion: int = 200_000) -> np.ndarray:
        """Bits per character of each text (not empty, normalised) in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        lengths = np.array([len(t) for t in texts])
        for lo, hi in C.groups_of(lengths, portion):
            if hi == lo + 1:  # one text, maybe a very long one
                keys = self.alphabet.keys(PAD + texts[lo])
                for at in range(0, len(keys), portion):
                    out[lo] -= self.log_probabilities(keys[at : at + portion]).sum(axis=0, dtype=float)
                out[lo] /= lengths[lo]
                continue
            keys = self.alphabet.keys(PAD + PAD.join(texts[lo:hi]))
            step = np.cumsum(lengths[lo:hi] + len(PAD)) - lengths[lo:hi] - len(PAD)
            own = np.ones(len(keys), bool)  # the padding between two texts belongs to none
            for k in range(len(PAD)):
                own[step[1:] - 1 - k] = False
            begin = np.cumsum(lengths[lo:hi]) - lengths[lo:hi]
            out[lo:hi] = -np.add.reduceat(self.log_probabilities(keys[own]), begin, axis=0, dtype=float) / lengths[lo:hi, None]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, bits per character, and whether the text is rejected."""
        lang, score, bits, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)
        at = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if at and self.languages:
            clean = [normalize(texts[i]) for i in at]
            h = self.entropies(clean)
            best = h.argmin(axis=1)
            least = h[np.arange(len(at)), best]
            # The posterior of equal priors, on at most 50 characters' evidence: characters are far from independent.
            weight = np.minimum([len(t) for t in clean], 50)[:, None]
            score[at] = 1 / np.exp2(weight * (least[:, None] - h)).sum(axis=1)
            bits[at], rejected[at] = least, least > self.limit(best, np.array([len(t) for t in clean]))
            for i, b in zip(at, best, strict=True):
                lang[i] = self.languages[b]
        return lang, score, bits, rejected


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams of the rows for counting, by language (kind 0). Rows kept for calibration are passed on whole (kind 1),
    those of languages with few rows too (kind 2, or 1)."""
    counts: Counter = Counter()
    for batch in batches:
        for lang, text, keep, few in zip(*(C.column(batch, c) for c in ("lang", "text", "calibrate", "few")), strict=True):
            text = normalize(text)
            if keep or few:
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([text]), pa.array([0]), pa.array([1 if keep else 2])], names=["lang", "gram", "n", "kind"])
            if not keep:
                text = PAD + text
                counts.update((lang, text[i : i + ORDER]) for i in range(len(text) - ORDER + 1))
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts]), pa.array([k[1] for k in counts]), pa.array(list(counts.values())), pa.array([0] * len(counts))], names=["lang", "gram", "n", "kind"])


def _crossed(alphabet: Alphabet, lang: str, texts: list[str]) -> list[float]:
    """Bits per character of each text in a model of the texts of the other parts."""
    parts, out = min(PARTS, len(texts)), []
    keys = [alphabet.keys(PAD + t) for t in texts]
    for k in range(parts):
        rest = np.concatenate([x for i, x in enumerate(keys) if i % parts != k])
        model = Models(alphabet, {lang: _sum_by(rest, np.ones(len(rest)))})
        out += model.entropies(texts[k::parts])[:, 0].tolist()
    return out


def _fitting(share: int):
    """Of rows that come by language and rank, those that fit into share characters, with the characters to take of each."""

    def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, left, rank = None, None, share, 0

        def row(doc_id: int, lang: str, size: int, rank: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([lang]), pa.array([size], pa.int64()), pa.array([rank % 10 == 0])], names=["doc_id", "lang", "take", "calibrate"])

        for batch in batches:
            for doc_id, lang, size in zip(*(C.column(batch, c) for c in ("doc_id", "lang", "size")), strict=True):
                if lang != now:
                    if head is not None and not rank:
                        yield row(head, now, share, 1)
                    now, head, left, rank = lang, doc_id, share, 0
                if size <= left:
                    left, rank = left - size, rank + 1
                    yield row(doc_id, lang, size, rank)
        if head is not None and not rank:
            yield row(head, now, share, 1)

    return fitting


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS, total_chars: int = TOTAL_CHARS, false_rejects: float = FALSE_REJECTS) -> Models:
    """Models of the languages that rows outside the held-out fold are labelled with."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike("\\S"))
    names = labelled.select("doc_id", "lang", F.length("text").alias("size")).withColumn("h", F.xxhash64("doc_id"))
    first = names.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id", "size"))).where(F.col("r") <= max_docs)
    share = max(1, min(max_chars, total_chars // max(1, first.select("lang").distinct().count())))
    first = first.repartition("lang").sortWithinPartitions("lang", "r").mapInArrow(_fitting(share), "doc_id long, lang string, take long, calibrate boolean")
    few = F.count("*").over(W.partitionBy("lang")) < 10 * CALIBRATION
    first = first.select("doc_id", F.col("take").cast("int").alias("take"), "calibrate", few.alias("few")).dropDuplicates(["doc_id"])
    sample = labelled.join(F.broadcast(first), "doc_id").select("lang", F.expr("substring(text, 1, take)").alias("text"), "calibrate", "few")  # max_docs rows a language
    rows = sample.mapInArrow(_count, "lang string, gram string, n long, kind long").groupBy("lang", "gram", "kind").agg(F.sum("n").alias("n")).toArrow()
    kind, langs = rows.column("kind").to_numpy(), rows.column("lang").combine_chunks().dictionary_encode()
    if isinstance(langs, pa.ChunkedArray):
        langs = langs.combine_chunks()
    names_, lang = langs.dictionary.to_pylist(), langs.indices.to_numpy()
    grams = rows.filter(pa.array(kind == 0))
    gram_lang, n = lang[kind == 0], grams.column("n").to_numpy().astype(float)
    points = _points("".join(grams.column("gram").to_pylist())).reshape(-1, ORDER) if len(n) else np.zeros((0, ORDER), np.uint32)
    seen = np.bincount(points[:, -1], weights=n, minlength=33)
    seen[ord(" ")] += 1
    alphabet = Alphabet({int(p): int(seen[p]) for p in np.flatnonzero(seen)})
    keys, counts = alphabet.gram_keys(points), {}
    for j, name in enumerate(names_):
        counts[name] = _sum_by(keys[gram_lang == j], n[gram_lang == j])
    models = Models(alphabet, counts)
    texts = rows.filter(pa.array(kind > 0)).to_pylist()
    kept, out = [], sorted((r["lang"], r["gram"]) for r in texts if r["kind"] == 1)
    every = models.entropies([t for _, t in out]) if out else np.zeros((0, len(models.languages)))
    whose, long_ = np.array([x for x, _ in out], object), np.array([len(t) >= 50 for _, t in out], bool)
    foreign = [every[(whose != name) & long_, j] for j, name in enumerate(models.languages)] if out else []
    for j, name in enumerate(models.languages):
        own = sorted(r["gram"] for r in texts if r["kind"] == 1 and r["lang"] == name)
        bits = every[whose == name, j] if own else np.zeros(0)
        if len(own) < CALIBRATION:
            own = sorted({r["gram"] for r in texts if r["lang"] == name})
            own, bits = (own, np.array(_crossed(alphabet, name, own))) if len(own) > 1 else ([], np.zeros(0))
            own = [t for k in range(min(PARTS, len(own))) for t in own[k :: min(PARTS, len(own))]]
        kept.append((bits, np.array([len(t) for t in own], float)))
    models.calibrate(kept, false_rejects, foreign)
    return models


def _predict(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                lang, score, bits, rejected = models.value.predict(C.column(batch, "text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang), pa.array(score), pa.array(bits), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "bits_per_char", "rejected"])

    return run


def identify(docs: DataFrame, models: Models | None = None, **bounds) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_char, rejected: one row per row of docs.

    Null texts, and texts without a letter, are `und` with score 0 and rejected; so is everything where no row is
    labelled. A null doc_id is not held out and trains nothing. Ties go to the first language in order of name.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    models = docs.sparkSession.sparkContext.broadcast(models or fit(source, **bounds))
    rows = source.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_predict(models), "doc_id long, held_out boolean, lang_pred string, score double, bits_per_char double, rejected boolean")


def _keep(models, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                lang, _, _, rejected = models.value.predict(C.column(batch, "text"))
                batch = batch.set_column(batch.schema.get_field_index(column), batch.schema.field(column), pa.array(lang, batch.schema.field(column).type))
                yield batch.filter(pa.array(~rejected))

    return run


def keep_identified(docs: DataFrame, **bounds) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns; lang becomes the predicted language."""
    models = docs.sparkSession.sparkContext.broadcast(fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), **bounds))
    return docs.mapInArrow(_keep(models, "lang"), docs.schema)
