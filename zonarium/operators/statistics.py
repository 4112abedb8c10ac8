"""Zonal statistics over long pixels: one hash aggregate for all sums, one cumulative window for all quantiles.

Pixels are rows (zone_id, band_name, value, coverage, weight[, centroid_in]). Numbers may be doubles, or integers in
units of their own (see Units): integer sums are exact, so their results do not depend on the order of rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonarium.plans.spec import OBJECTS, Quantity, parse

KEYS = ("zone_id", "band_name")


@dataclass(frozen=True)
class Units:
    """What one unit of each column is worth, and what full coverage is in units."""

    value: float = 1.0
    coverage: float = 1.0
    weight: float = 1.0
    full: int | float = 1


def valid(ignore: tuple = ()) -> Column:
    """Pixels that count at all: a value that is there and not ignored, a coverage and a weight."""
    v = F.col("value")
    ok = v.isNotNull() & F.col("coverage").isNotNull() & F.col("weight").isNotNull() & ~F.isnan(F.col("weight").cast("double")) & ~F.isnan(v.cast("double"))
    ignore = [x for x in ignore if x == x]
    return ok & ~v.isin(*ignore) if ignore else ok


def coverage_between(low: float = 0, high: float = 1) -> Column:
    return F.col("coverage").between(low, high)


def member(rule: str, full: int | float) -> tuple[Column, Column]:
    """What counts as a pixel's coverage under a rule, and whether the pixel counts."""
    c, one = F.col("coverage"), F.lit(full)
    inside = F.when(F.col("centroid_in"), one).otherwise(F.lit(0 * full)) if rule.startswith("centroid") else None
    if rule == "":
        return c, F.lit(True)
    if rule == "fullyContained":
        return c, c == one
    if rule == "partiallyContained":
        return c, (c != 0) & (c != one)
    if rule == "boundary":
        return one, (c != 0) & (c != one)
    if rule == "allTouched":
        return one, c != 0
    if rule == "centroidBased":
        return inside, F.lit(True)
    if rule == "centroidBasedFullyContained":
        return c, F.col("centroid_in") & (c == one)
    if rule == "centroidBasedBoundary":
        return one, F.col("centroid_in") & (c != 0) & (c != one)
    raise ValueError(rule)


def _integral(df: DataFrame, *columns: str) -> bool:
    return all(isinstance(df.schema[c].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for c in columns)


def _tag(kind: tuple, part: str) -> str:
    return f"{kind[0] or 'all'}_{'w' if kind[1] else 'u'}_{part}" + (f"_{abs(hash(kind[2]))}" if len(kind) > 2 and kind[2] else "")


def one_pass(pixels: DataFrame, asked: list[Quantity], units: Units, ignore: tuple) -> DataFrame:
    """zone_id, band_name and the column of each mean, var, std and weight: one partial and one final hash aggregate."""
    exact = _integral(pixels, "value", "coverage", "weight")
    second = any(q.family in ("Var", "Std") for q in asked)
    v = F.col("value")
    if not exact:
        v = v.cast("double")
        if second:
            # Centring each band on its mean keeps the second moments' digits; a row for each band is broadcast.
            centre = pixels.where(valid(ignore)).groupBy("band_name").agg(F.avg("value").alias("_centre"))
            pixels = pixels.join(F.broadcast(centre), "band_name", "left")
            v = v - F.coalesce(F.col("_centre"), F.lit(0.0))
    kinds = list(dict.fromkeys(q.kind for q in asked))
    wide = (lambda x: x.cast("decimal(38,0)")) if exact else (lambda x: x)
    sums = []
    for kind in kinds:
        rule, weighted = kind
        c, where = member(rule, units.full)
        where = where & valid(ignore)
        u = (c * F.col("weight") if weighted else c).cast("long" if exact else "double")
        put = lambda x, name: sums.append(F.sum(F.when(where, x)).alias(_tag(kind, name)))  # noqa: B023, E731
        put(c, "support")
        put(u, "w")
        families = {q.family for q in asked if q.kind == kind}
        if families & {"Mean", "Var", "Std"}:
            put(u * v, "s1")
        if families & {"Var", "Std"}:
            put(wide(u) * wide(v) * wide(v) if exact else u * v * v, "s2")
            put(u * u, "q")
    if not exact and second:
        sums.append(F.first("_centre", ignorenulls=True).alias("_centre"))
    table = pixels.groupBy(*KEYS).agg(*sums)
    # One lambda turns the sums of a kind into its statistics, for all kinds: written out for each, the code of many
    # quantities outgrows what the JVM takes in one method.
    d = lambda x: x.cast("double")
    have = set(table.columns)
    types = {"support": "double", "w": "long" if exact else "double", "s1": "long" if exact else "double", "s2": "decimal(38,0)" if exact else "double", "q": "long" if exact else "double"}
    part = lambda kind, name: (F.col(_tag(kind, name)) if _tag(kind, name) in have else F.lit(None)).cast(types[name]).alias(name)
    rows = F.array(*(F.struct(*(part(kind, name) for name in types), F.lit(units.coverage * (units.weight if kind[1] else 1.0)).alias("unit")) for kind in kinds))
    centre = F.coalesce(F.col("_centre"), F.lit(0.0)) if not exact and second else None

    def moments(m: Column) -> Column:
        w, s1, s2, q = (m[x] for x in ("w", "s1", "s2", "q"))
        mean = F.when(w != 0, d(s1) / F.when(w != 0, d(w)))
        mean = mean * units.value if centre is None else (mean + centre) * units.value
        low = d(wide(w) * wide(w) - wide(q))
        top = d(wide(w) * s2 - wide(s1) * wide(s1))
        var = F.when(low > 0, F.greatest(top, F.lit(0.0)) / F.when(low > 0, low)).otherwise(F.lit(float("nan"))) * (units.value * units.value)
        there = lambda x: F.when(m["support"] > 0, x)
        return F.struct(there(d(w) * m["unit"]).alias("Weight"), there(mean).alias("Mean"), there(var).alias("Var"), there(F.sqrt(var)).alias("Std"))

    done = table.select(*KEYS, F.transform(rows, moments).alias("_moments"))
    return done.select(*KEYS, *(F.col("_moments")[kinds.index(q.kind)][q.family].alias(q.suffix) for q in asked))


def quantiles(pixels: DataFrame, asked: list[Quantity], units: Units, ignore: tuple) -> DataFrame:
    """zone_id, band_name and a column for each level: the least value whose share of the weight up to it reaches it.

    Equal values of a zone are summed first, map-side too; then one running sum by value serves all levels of all kinds.
    """
    exact = _integral(pixels, "value", "coverage", "weight")
    kinds = list(dict.fromkeys(q.kind for q in asked))
    sums, keep = [], []
    for kind in kinds:
        c, where = member(kind[0], units.full)
        where = where & valid(ignore)
        u = (c * F.col("weight") if kind[1] else c).cast("long" if exact else "double")
        sums.append(F.sum(F.when(where, u)).alias(_tag(kind, "u")))
        keep.append(where)
    byvalue = pixels.where(reduce(lambda a, b: a | b, keep)).groupBy(*KEYS, "value").agg(*sums)
    every = W.partitionBy(*KEYS)
    running = every.orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    cums = byvalue.select(*KEYS, "value", *(f for k in kinds for f in (F.sum(_tag(k, "u")).over(running).alias(_tag(k, "cum")), F.sum(_tag(k, "u")).over(every).alias(_tag(k, "w")))))
    picks = []
    for q in asked:
        cum, total = F.col(_tag(q.kind, "cum")), F.col(_tag(q.kind, "w"))
        level = q.q if q.family == "Quantile" else Fraction(1, 2)
        reached = cum.cast("decimal(38,0)") * level.denominator >= total.cast("decimal(38,0)") * level.numerator if exact else cum >= total * float(level)
        picks.append((F.min(F.when((cum > 0) & reached, F.col("value"))).cast("double") * units.value).alias(q.suffix))
    return cums.groupBy(*KEYS).agg(*picks)


def evaluate(pixels: DataFrame, asked: list[Quantity], units: Units = Units(), ignore: tuple = ()) -> DataFrame:
    """One row for each zone and band that any pixel touches, with a column for each quantity in order."""
    from zonarium.functions.empirical import aggregate_objects

    groups: dict[tuple, list[Quantity]] = {}
    for q in asked:
        group = "objects" if q.family in OBJECTS else "sorted" if q.family in ("Quantile", "Median") else "sums"
        groups.setdefault((group, q.ignored if q.ignored is not None else tuple(ignore)), []).append(q)
    # Sums have a row for each zone and band that any pixel touches; only where none are asked for, a distinct finds them.
    first = next((g for g in groups if g[0] == "sums"), None)
    out = one_pass(pixels, groups.pop(first), units, first[1]) if first else pixels.select(*KEYS).distinct()
    for (group, skip), own in groups.items():
        part = {"sums": one_pass, "sorted": quantiles, "objects": aggregate_objects}[group](pixels, own, units, skip)
        renamed = part.select(*(F.col(k).alias(f"_{k}") for k in KEYS), *(q.suffix and F.col(f"`{q.suffix}`") for q in own))
        out = out.join(renamed, (out.zone_id == renamed._zone_id) & (out.band_name == renamed._band_name), "left").drop("_zone_id", "_band_name")
    return out.select(*KEYS, *(F.col(f"`{q.suffix}`") for q in asked))


def widen(long: DataFrame, bands: list[str], asked: list[Quantity]) -> DataFrame:
    """One row for each zone with columns {band}_{quantity}."""
    cells = [F.first(F.when(F.col("band_name") == b, F.col(f"`{q.suffix}`")), ignorenulls=True).alias(f"{b}_{q.suffix}") for b in bands for q in asked]
    return long.groupBy("zone_id").agg(*cells)


def touched(pixels: DataFrame, bands: list[str], mode: str) -> DataFrame:
    """zone_id of the zones that stay: those with a pixel in any band, or in all (any other mode). Counts precede filters."""
    own = pixels.where(F.col("band_name").isin(*bands)).groupBy("zone_id").agg(F.count_distinct("band_name").alias("_n"))
    return own.where(F.lit(True) if mode == "allBandsNotIntersecting" else F.col("_n") == len(bands)).select("zone_id")


def zonal_statistics(
    pixels: DataFrame,
    quantities: list[str | dict] = (),
    centroid_quantities: list[str | dict] = (),
    bands: list[str] | None = None,
    zones: DataFrame | None = None,
    ignore_values: tuple = (),
    units: Units = Units(),
    keep_non_intersecting: bool = False,
    non_intersecting_mode: str = "allBandsNotIntersecting",
    keep_raw: bool = False,
) -> DataFrame:
    """zones' columns (or zone_id alone) and {band}_{quantity} for each band and quantity.

    bands fixes the columns; where it is not given, one small job lists the band names. keep_raw adds the pixels of
    each band as an array of structs.
    """
    asked = parse(quantities, centroid_quantities) if quantities or centroid_quantities or not keep_raw else []
    bands = bands or sorted(r[0] for r in pixels.select("band_name").distinct().collect())
    wide = widen(evaluate(pixels, asked, units, ignore_values), bands, asked) if asked else pixels.select("zone_id").distinct()
    if keep_raw:
        fields = [c for c in ("value", "coverage", "weight", "center_x", "center_y", "centroid_in") if c in pixels.columns]
        raw = pixels.groupBy("zone_id").agg(*(F.collect_list(F.when(F.col("band_name") == b, F.struct(*fields))).alias(f"{b}_pixels") for b in bands))
        wide = wide.join(raw, "zone_id", "left")
    if not keep_non_intersecting and non_intersecting_mode != "allBandsNotIntersecting":
        wide = wide.join(touched(pixels, bands, non_intersecting_mode), "zone_id", "left_semi")
    if zones is None:
        return wide
    return zones.join(wide, "zone_id", "left" if keep_non_intersecting else "inner")


def apply_function(pixels: DataFrame, fun, suffix: str | None = None, ignore: tuple = (), where: Column | None = None) -> DataFrame:
    """zone_id, band_name and what fun(values, coverage, weights) gives of each zone's valid pixels: the custom aggregate.

    The pixels of a zone and band meet in one task, as any function of all of them needs.
    """
    name = suffix or fun.__name__

    @F.pandas_udf("double")
    def call(v: pd.Series, c: pd.Series, w: pd.Series) -> float:
        out = fun(v.to_numpy(float), c.to_numpy(float), w.to_numpy(float))
        return float("nan") if out is None else float(out)

    rows = pixels.where(valid(ignore) if where is None else valid(ignore) & where)
    return rows.groupBy(*KEYS).agg(call(F.col("value").cast("double"), F.col("coverage").cast("double"), F.col("weight").cast("double")).alias(name))
