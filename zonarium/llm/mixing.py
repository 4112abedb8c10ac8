"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of source, language and topic with their tokens. The cells' tokens are raked: scaled in
turn to the target share of each source, each language and each topic, until all marginals fit. A document is then
sampled with a probability that is its cell's raked weight over its tokens, times one factor for all cells, which is
solved so that the expected tokens are the wanted fraction; no probability exceeds 1.

Tokens are white-space characters plus one. The default topic is the genre that character counts over the whole text
show: empty, short, symbols, numbers, lines or prose. Default targets flatten what is there: shares to a power, normalised.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

DIMENSIONS = ("source", "lang", "topic")
POWERS = {"source": 0.7, "lang": 0.5, "topic": 0.5}
FRACTION = 0.7
#: Up to so many cells are raked on the driver and broadcast; beyond that both are joins.
DRIVER_CELLS = 100_000
_ROUNDS, _CLOSE = 200, 1e-8


def _settled(off: float) -> None:
    if off >= _CLOSE:
        warnings.warn(f"raking ended after {_ROUNDS} rounds, {off:.3g} from the targets: no weights on these cells may meet them", stacklevel=3)


_SYMBOLS = np.frombuffer(b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~", np.uint8)
_DIGITS, _SPACES = np.frombuffer(b"0123456789", np.uint8), np.frombuffer(b" \n\t\r", np.uint8)


def counts_of(raw: np.ndarray) -> tuple[int, str]:
    """Tokens and genre of a text's UTF-8 bytes."""
    n = np.bincount(raw, minlength=256)
    size = len(raw) - int(n[0x80:0xC0].sum())  # code points: bytes that continue none
    if not size:
        return 0, "empty"
    words, lines = int(n[_SPACES].sum()) + 1, int(n[10]) + 1
    if words < 50:
        return words, "short"
    if n[_SYMBOLS].sum() * 10 > size:
        return words, "symbols"
    if n[_DIGITS].sum() * 20 > size:
        return words, "numbers"
    return words, "lines" if size < lines * 120 else "prose"


def _count(given: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                data, offsets, _ = C.text_bytes(batch, "_text")
                found = [counts_of(data[offsets[i] : offsets[i + 1]]) for i in range(batch.num_rows)]
                topic = batch.column("_topic") if given else pa.array([t for _, t in found], pa.string())
                rest = [n for n in batch.schema.names if n not in ("_text", "_topic")]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), topic, pa.array([n for n, _ in found], pa.int64())], names=[*rest, "_topic", "_tokens"])

    return run


def _counted(docs: DataFrame, topic: Column | None, row: Column | None) -> DataFrame:
    """[_row,] _source, _lang, _topic, _tokens of each row."""
    named = docs.select(*([row.alias("_row")] if row is not None else []), F.col("text").alias("_text"), F.col("source").alias("_source"), F.col("lang").alias("_lang"), (F.lit(None).cast("string") if topic is None else topic).alias("_topic"))
    kind = f"_row {named.schema['_row'].dataType.simpleString()}, " if row is not None else ""
    return named.mapInArrow(_count(topic is not None), kind + "_source string, _lang string, _topic string, _tokens long")


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray]) -> np.ndarray:
    """Weights proportional to tokens within what the marginals leave open, with each dimension's sums at its targets.

    Warns where the targets are not met after all rounds.
    """
    w = tokens / max(tokens.sum(), 1)
    for _ in range(_ROUNDS):
        off = 0.0
        for code, target in zip(codes, targets, strict=True):
            have = np.bincount(code, w, len(target))
            off = max(off, float(np.abs(have - target).max(initial=0)))
            w = w * np.divide(target, have, out=np.zeros_like(target), where=have > 0)[code]
        if off < _CLOSE:
            break
    _settled(off)
    return w


def factor_for(tokens: np.ndarray, weights: np.ndarray, wanted: float) -> float:
    """The factor c for which the sum of min(tokens, c * weights) is wanted, or of all that can be reached."""
    use = weights > 0
    ratio = np.sort(tokens[use] / weights[use])
    if not len(ratio):
        return 0.0
    if wanted >= tokens[use].sum():
        return float(ratio[-1])
    order = np.argsort(tokens[use] / weights[use], kind="stable")
    full = np.concatenate(([0], np.cumsum(tokens[use][order])))[:-1]
    rest = np.cumsum(weights[use][order][::-1])[::-1]
    c = (wanted - full) / rest  # if the first k cells are taken whole
    return float(c[np.flatnonzero(c <= ratio + 1e-9 * ratio)[0]])


def _targets(shares: dict, given: dict | None, power: float) -> dict:
    """Target shares of the categories that occur; a given target of one that does not occur is spread over the others."""
    raw = {k: max(0.0, float(given.get(k, 0))) for k in shares} if given else {k: v**power if v > 0 else 0.0 for k, v in shares.items()}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()} if total > 0 else {k: 1 / len(raw) for k in raw}


def _rake_here(cells: DataFrame, targets: dict[str, dict], fraction: float) -> DataFrame:
    rows = cells.orderBy(*DIMENSIONS).collect()  # DRIVER_CELLS at most
    tokens = np.array([r.tokens for r in rows], float)
    codes, goals = [], []
    for d in DIMENSIONS:
        names = list(dict.fromkeys(r[d] for r in rows))
        code = np.array([names.index(r[d]) for r in rows], np.int64)
        have = np.bincount(code, tokens, len(names)) / max(tokens.sum(), 1)
        goal = _targets(dict(zip(names, have.tolist(), strict=True)), targets.get(d), POWERS[d])
        codes.append(code)
        goals.append(np.array([goal[n] for n in names]))
    w = rake(tokens, codes, goals)
    p = np.minimum(1, np.divide(w * factor_for(tokens, w, fraction * tokens.sum()), tokens, out=np.ones_like(w), where=tokens > 0))
    out = [(*(r[d] for d in DIMENSIONS), float(x)) for r, x in zip(rows, p, strict=True)]
    return cells.sparkSession.createDataFrame(out, "source string, lang string, topic string, probability double")


def _rake_joined(cells: DataFrame, targets: dict[str, dict], fraction: float) -> DataFrame:
    """The same on tables, for any number of cells."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    now = cells.withColumn("w", F.col("tokens") / total)
    goals = {}
    for d in DIMENSIONS:
        have = cells.groupBy(d).agg((F.sum("tokens") / total).alias("share"))
        if targets.get(d):
            given = spark.createDataFrame([(k, float(v)) for k, v in targets[d].items()], f"{d}_ string, raw double")
            raw = have.join(given, F.col(d).eqNullSafe(F.col(d + "_")), "left").select(d, F.greatest(F.coalesce("raw", F.lit(0.0)), F.lit(0.0)).alias("raw"))
        else:
            raw = have.select(d, F.when(F.col("share") > 0, F.pow("share", F.lit(POWERS[d]))).otherwise(0.0).alias("raw"))
        sums = raw.agg(F.sum("raw"), F.count("*")).first()
        goals[d] = C.materialize(raw.select(F.col(d).alias("_d"), (F.col("raw") / sums[0] if sums[0] else F.lit(1 / max(1, sums[1]))).alias("goal")), "goal")
    for _ in range(_ROUNDS):
        off = 0.0
        for d in DIMENSIONS:
            now = C.materialize(now, "raked")
            have = now.groupBy(F.col(d).alias("_d2")).agg(F.sum("w").alias("have"))
            both = have.join(goals[d], F.col("_d2").eqNullSafe(F.col("_d"))).select("_d2", "have", "goal")
            off = max(off, both.agg(F.max(F.abs(F.col("have") - F.col("goal")))).first()[0] or 0.0)
            now = now.join(both, F.col(d).eqNullSafe(F.col("_d2"))).select(*DIMENSIONS, "tokens", F.when(F.col("have") > 0, F.col("w") * F.col("goal") / F.col("have")).otherwise(0.0).alias("w"))
        if off < _CLOSE:
            break
    _settled(off)
    now = C.materialize(now, "raked")
    low, high, wanted = 0.0, now.where("w > 0").agg(F.max(F.col("tokens") / F.col("w"))).first()[0] or 0.0, fraction * total
    for _ in range(60):
        c = (low + high) / 2
        if (now.agg(F.sum(F.least(F.col("tokens").cast("double"), F.col("w") * c))).first()[0] or 0.0) < wanted:
            low = c
        else:
            high = c
    return now.select(*DIMENSIONS, F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("w") * high / F.col("tokens"))).otherwise(1.0).alias("probability"))


def _probabilities(counted: DataFrame, targets: dict[str, dict] | None, fraction: float, driver_cells: int) -> tuple[DataFrame, bool]:
    cells = counted.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("tokens")).toDF(*DIMENSIONS, "tokens")
    cells = C.materialize(cells, "cells")
    few = cells.count() <= driver_cells
    p = (_rake_here if few else _rake_joined)(cells, targets or {}, fraction)
    return p.select(*(F.col(d).alias(f"_{d}2") for d in DIMENSIONS), F.col("probability").alias("_probability")), few


def _draw(counted: DataFrame, probabilities: DataFrame, few: bool, seed: int) -> DataFrame:
    same = [F.col(f"_{d}").eqNullSafe(F.col(f"_{d}2")) for d in DIMENSIONS]
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_row.doc_id", "_row.hash"), 11) / float(1 << 53)
    return counted.join(F.broadcast(probabilities) if few else probabilities, same[0] & same[1] & same[2]).where(u < F.col("_probability"))


def mixture(docs: DataFrame, targets: dict[str, dict] | None = None, fraction: float = FRACTION, topic: Column | None = None, seed: int = 1, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability: the sampled rows of docs.

    Null sources, languages and topics are categories of their own. Cells without tokens are kept whole; cells of a
    category with target 0 are dropped. The draw depends on doc_id, text and seed only, so repeated rows share it.
    """
    counted = C.materialize(_counted(docs, topic, F.struct("doc_id", F.xxhash64("text").alias("hash"))), "counted")
    drawn = _draw(counted, *_probabilities(counted, targets, fraction, driver_cells), seed)
    return drawn.select("_row.doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.col("_probability").alias("probability"))


def sample_mixture(docs: DataFrame, targets: dict[str, dict] | None = None, fraction: float = FRACTION, topic: Column | None = None, seed: int = 1, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """The sampled rows of docs with all their columns; the texts are counted twice rather than stored or moved."""
    probabilities = _probabilities(_counted(docs, topic, None), targets, fraction, driver_cells)
    row = F.struct("doc_id", F.xxhash64("text").alias("hash"), F.struct("*").alias("all"))
    return _draw(_counted(docs, topic, row), *probabilities, seed).select("_row.all.*")
