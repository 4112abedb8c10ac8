"""Mergeable empirical distributions: exact weighted samples, and digests of a fixed number of points.

Both are a struct column (SCHEMA) in tables and a Python object in workers and on the driver; to_row and from_row go
between the two. A table of such structs is the storage format. Where only what a distribution says is asked for, Samples
keep it in rows: its functions are aggregates and windows, and no array of a zone's samples is made.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "class_name string, data array<double>, weights array<double>, sum_weights double, total_weight double, total_n bigint, pdf_method string, pdf_points int, pdf_params map<string,string>, n_approx int, mode string, eps double"
GRID_KINDS = ("nearest", "linear", "previous", "next")


class EmpDist:
    """A weighted sample. weights are normalised; sum_weights keeps what they add up to, total_n counts samples."""

    class_name = "EmpDist"

    def __init__(self, data, weights=None, pdf_method: str = "kde", pdf_points: int | None = None, **pdf_params) -> None:
        x = np.asarray(data, float).ravel()
        w = np.ones(len(x)) if weights is None else np.asarray(weights, float).ravel()
        if len(x) != len(w):
            raise ValueError("data and weights differ in length")
        use = ~np.isnan(x) & ~np.isnan(w) & (w != 0)
        x, w = x[use], w[use]
        if not len(x) or not np.isfinite(w).all() or (w < 0).any():
            raise ValueError("a distribution needs samples with finite, positive weights")
        if pdf_method != "kde" and pdf_method not in GRID_KINDS:
            raise ValueError(f"unknown pdf method {pdf_method!r}")
        order = np.argsort(x, kind="stable")
        self.data, self.raw = x[order], w[order]
        self.sum_weights = float(w.sum())
        self.weights = self.raw / self.sum_weights
        self.total_n, self.total_weight = len(x), self.sum_weights
        self.pdf_method, self.pdf_params = pdf_method, pdf_params
        self.pdf_points = pdf_points or max(2, int(math.sqrt(len(x))))
        self._cum = np.cumsum(self.weights)
        self._cum[-1] = 1.0

    def __len__(self) -> int:
        return self.total_n

    N = property(__len__)

    def mean(self) -> float:
        return float(self.weights @ self.data)

    def var(self) -> float:
        rest = 1 - float(self.weights @ self.weights)
        return float(self.weights @ (self.data - self.mean()) ** 2) / rest if rest > 0 and len(self.data) > 1 else math.nan

    def std(self) -> float:
        return math.sqrt(self.var())

    def cdf(self, x):
        """The weight of samples up to and at x."""
        at = np.searchsorted(self.data, np.asarray(x, float), side="right")
        return np.where(at > 0, self._cum[np.maximum(at, 1) - 1], 0.0)

    def ppf(self, y):
        """The least sample whose cdf reaches y; sums of weights that miss it by rounding alone count as reaching it."""
        at = np.searchsorted(self._cum, np.asarray(y, float) - 1e-12, side="left")
        return self.data[np.minimum(at, len(self.data) - 1)]

    icdf = ppf

    def _kde(self, x: np.ndarray) -> np.ndarray:
        effective = 1 / float(self.weights @ self.weights)
        method = self.pdf_params.get("bw_method") or "scott"
        factor = {"scott": effective**-0.2, "silverman": (effective * 0.75) ** -0.2}.get(method) or float(method)
        spread = self.var()
        if not spread > 0:
            return np.zeros_like(x)
        h = math.sqrt(spread) * factor
        out = np.zeros_like(x)
        for at in range(0, len(self.data), 4096):
            z = (x[:, None] - self.data[None, at : at + 4096]) / h
            out += np.exp(-0.5 * z * z) @ self.weights[at : at + 4096]
        return out / (h * math.sqrt(2 * math.pi))

    def pdf(self, x):
        shape, x = np.shape(x), np.atleast_1d(np.asarray(x, float)).ravel()
        if self.pdf_method == "kde":
            return self._kde(x).reshape(shape)
        lo, hi = self.data[0], self.data[-1]
        if not hi > lo:
            return np.zeros(shape)
        grid = np.linspace(lo, hi, self.pdf_points)
        height = np.gradient(self.cdf(grid), grid)
        area = float(np.trapezoid(height, grid))
        height = height / area if area else height
        if self.pdf_method == "linear":
            y = np.interp(x, grid, height)
        else:
            at = np.searchsorted(grid, x, side="right") - 1 if self.pdf_method == "previous" else np.searchsorted(grid, x)
            if self.pdf_method == "nearest":
                right = np.clip(at, 1, len(grid) - 1)
                at = np.where(x - grid[right - 1] <= grid[right] - x, right - 1, right)
            y = height[np.clip(at, 0, len(grid) - 1)]
        return np.where((x >= lo) & (x <= hi), y, 0.0).reshape(shape)

    def random(self, size=None, seed=None):
        return self.ppf(np.random.default_rng(seed).random(size))

    rvs = random

    def _options(self) -> dict:
        return {"pdf_method": self.pdf_method, "pdf_points": self.pdf_points, **self.pdf_params}

    def _with(self, other: EmpDist) -> tuple[np.ndarray, np.ndarray]:
        if not isinstance(other, EmpDist):
            raise TypeError(f"a distribution cannot be merged with {type(other).__name__}")
        return np.concatenate([self.data, other.data]), np.concatenate([self.weights * self.sum_weights, other.weights * other.sum_weights])

    def __add__(self, other: EmpDist) -> EmpDist:
        out = EmpDist(*self._with(other), **self._options())
        out.total_n, out.total_weight = self.total_n + other.total_n, self.total_weight + other.total_weight
        return out

    @staticmethod
    def joined(items: list[EmpDist]) -> EmpDist:
        """What adding up exact distributions left to right gives, in one step."""
        out = EmpDist(np.concatenate([x.data for x in items]), np.concatenate([x.weights * x.sum_weights for x in items]), **items[0]._options())
        out.total_n, out.total_weight = sum(x.total_n for x in items), sum(x.total_weight for x in items)
        return out

    def __radd__(self, other):
        return self if other == 0 else NotImplemented

    def to_row(self) -> dict:
        return {"class_name": self.class_name, "data": self.data.tolist(), "weights": self.weights.tolist(), "sum_weights": self.sum_weights, "total_weight": self.total_weight, "total_n": int(self.total_n), "pdf_method": self.pdf_method, "pdf_points": int(self.pdf_points), "pdf_params": {str(k): str(v) for k, v in self.pdf_params.items()}, "n_approx": None, "mode": None, "eps": None}


class EmpDigest(EmpDist):
    """A distribution kept as n_approx samples of equal weight at evenly spaced levels of its cdf."""

    class_name = "EmpDigest"
    #: Each sum of digests is a digest again, so they are added one by one.
    joined = None

    def __init__(self, data, weights=None, n_approx: int | None = 1000, mode: str = "densityFocused", eps: float | None = None, pdf_method: str = "kde", pdf_points: int | None = None, **pdf_params) -> None:
        if mode != "densityFocused":
            raise NotImplementedError(f"digest mode {mode!r}")
        whole = EmpDist(data, weights, pdf_method, pdf_points, **pdf_params)
        n = int(math.sqrt(len(whole.data))) if n_approx is None else int(n_approx)
        if n < 1:
            raise ValueError("a digest needs at least one point")
        super().__init__(whole.ppf(np.linspace(0, 1, n)), np.full(n, 1 / n), pdf_method, pdf_points or whole.pdf_points, **pdf_params)
        self.n_approx, self.mode, self.eps = n, mode, eps
        self.sum_weights, self.total_weight, self.total_n = whole.sum_weights, whole.total_weight, whole.total_n

    def __add__(self, other: EmpDist) -> EmpDigest:
        out = EmpDigest(*self._with(other), n_approx=self.n_approx, mode=self.mode, eps=self.eps, **self._options())
        out.total_n, out.total_weight = self.total_n + other.total_n, self.total_weight + other.total_weight
        return out

    def to_row(self) -> dict:
        return super().to_row() | {"n_approx": self.n_approx, "mode": self.mode, "eps": self.eps}


def from_row(row) -> EmpDist:
    """The object of a struct value (a Row or a dict), checked."""
    r = row if isinstance(row, dict) else row.asDict()
    data, weights = np.asarray(r["data"], float), np.asarray(r["weights"], float)
    if not len(data) or len(data) != len(weights) or not np.isfinite(weights.sum()) or weights.sum() <= 0:
        raise ValueError("not a distribution: it needs samples, and as many weights with a positive sum")
    if not (r["sum_weights"] or 0) > 0:
        raise ValueError("not a distribution: its weight is not positive")
    kinds = {"EmpDist": EmpDist, "EmpDigest": EmpDigest}
    if r["class_name"] not in kinds:
        raise ValueError(f"unknown class {r['class_name']!r}")
    out = object.__new__(kinds[r["class_name"]])
    EmpDist.__init__(out, data, weights, r["pdf_method"], r["pdf_points"], **dict(r["pdf_params"] or {}))
    out.sum_weights, out.total_weight, out.total_n = float(r["sum_weights"]), float(r["total_weight"]), int(r["total_n"])
    if isinstance(out, EmpDigest):
        out.n_approx, out.mode, out.eps = int(r["n_approx"]), r["mode"], r["eps"]
    return out


_NAMES = {"pdfMethod": "pdf_method", "pdfPoints": "pdf_points", "nApprox": "n_approx"}
#: What sums of weights may miss a level by and still count as reaching it.
_MISS = 1e-12


@dataclass(frozen=True)
class Samples:
    """EmpDists in rows: the key columns, x and u, a positive weight that is worth `unit` each; rows of one key are one.

    Weights of integer pixels stay integers, so that their sums are exact. Nothing here holds a distribution whole: equal
    values are summed first, map-side too, and the rows of a key are sorted by spilling.
    """

    rows: DataFrame
    keys: tuple[str, ...]
    unit: float = 1.0

    def by_value(self) -> DataFrame:
        """keys, x, u and n, the number of samples of each different value."""
        return self.rows.groupBy(*self.keys, "x").agg(F.sum("u").alias("u"), F.count("*").alias("n"))

    def merged(self, key: Column, name: str, double: bool = True) -> Samples:
        """The sums of the distributions of each key. Exact samples add up to the same ones in any order of merging.

        A distribution of a single sample holds it twice, or does not exist (double=False).
        """
        single = self.rows.groupBy(*self.keys).agg(F.count("*").alias("n"), F.first("x").alias("x"), F.first("u").alias("u")).where("n = 1").drop("n")
        rows = self.rows.unionByName(single) if double else self.rows.join(single.select(*self.keys), list(self.keys), "left_anti")
        return Samples(rows.select(key.alias(name), "x", "u"), (name,), self.unit)

    def cdf(self, x: float, name: str = "cdf") -> DataFrame:
        """keys and the share of the weight up to and at x."""
        upto, all_ = F.coalesce(F.sum(F.when(F.col("x") <= x, F.col("u"))), F.lit(0)), F.sum("u")
        return self.rows.groupBy(*self.keys).agg((upto.cast("double") / all_.cast("double")).alias(name))

    def _running(self) -> DataFrame:
        """by_value with share, the cdf at x, and before, the cdf below it (null at the least value)."""
        every = W.partitionBy(*self.keys)
        cum = self.by_value().withColumn("cum", F.sum("u").over(every.orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow)))
        total = F.max("cum").over(every)
        share = cum.select("*", total.alias("total"), F.lag("cum").over(every.orderBy("x")).alias("_below"))
        return share.withColumns({"share": F.col("cum").cast("double") / F.col("total").cast("double"), "before": F.col("_below").cast("double") / F.col("total").cast("double")}).drop("_below", "cum")

    def ppf(self, levels: dict[str, float]) -> DataFrame:
        """keys and a column for each level: the least sample whose cdf reaches it."""
        return self._running().groupBy(*self.keys).agg(*(F.min(F.when(F.col("share") >= y - _MISS, F.col("x"))).alias(n) for n, y in levels.items()))

    def kde(self, x: float, name: str = "density", bw_method: str | float = "scott") -> DataFrame:
        """keys and the Gaussian kernel density at x; 0 where the samples have no spread."""
        every = W.partitionBy(*self.keys)
        v, w = F.col("x"), F.col("w")
        rows = self.by_value().withColumn("w", F.col("u").cast("double") / F.sum(F.col("u").cast("double")).over(every))
        rows = rows.withColumns({"mu": F.sum(w * v).over(every), "q": F.sum(w * w).over(every)})
        rows = rows.withColumn("spread", F.sum(w * (v - F.col("mu")) * (v - F.col("mu"))).over(every))
        effective = 1 / F.col("q")
        factor = {"scott": F.pow(effective, F.lit(-0.2)), "silverman": F.pow(effective * 0.75, F.lit(-0.2))}.get(bw_method)
        var = F.when(F.col("q") < 1, F.col("spread") / F.when(F.col("q") < 1, 1 - F.col("q")))
        h = F.sqrt(var) * (F.lit(float(bw_method)) if factor is None else factor)
        rows = rows.select(*self.keys, "x", "w", F.when(h > 0, h).alias("h"))
        z = (F.lit(float(x)) - v) / F.col("h")
        return rows.groupBy(*self.keys).agg(F.coalesce(F.sum(w * F.exp(-0.5 * z * z) / (F.col("h") * math.sqrt(2 * math.pi))), F.lit(0.0)).alias(name))

    def points(self, n_approx: int | None) -> DataFrame:
        """keys, data (the samples at n_approx evenly spaced levels, or as many as the root of the different values), total,
        n (samples) and different (values): at most so many rows of a key as there are levels are gathered."""
        rows = self._running().withColumns({"total_n": F.sum("n").over(every := W.partitionBy(*self.keys)), "different": F.count("*").over(every)})
        k = F.greatest(F.lit(1), F.floor(F.sqrt(F.col("different").cast("double")))) if n_approx is None else F.lit(n_approx)
        k = k.cast("int")
        # How many levels a cdf reaches; each value has those beyond what the one before it reaches.
        reached = lambda c: F.least(k, F.floor((c + _MISS) * (k - 1)).cast("int") + 1)
        first = F.when(F.col("before").isNull(), F.lit(0)).otherwise(reached(F.col("before")))
        rows = rows.select(*self.keys, "x", "total", "total_n", "different", first.alias("first"), (reached(F.col("share")) - first).alias("times")).where("times > 0")
        found = F.array_sort(F.collect_list(F.struct("first", "x", "times")))
        data = F.flatten(F.transform(found, lambda p: F.array_repeat(p["x"], p["times"])))
        return rows.groupBy(*self.keys).agg(data.alias("data"), F.first("total").alias("total"), F.first("total_n").alias("n"), F.first("different").alias("different"))

    def objects(self, kind: type[EmpDist], options: dict, double: bool, name: str) -> DataFrame:
        """keys and the struct of each distribution; where a single sample makes none (double=False), null."""
        checked = kind([0.0, 1.0], **options).to_row()
        if kind is EmpDigest:
            parts = self.points(options.get("n_approx", 1000))
            weights = F.transform("data", lambda _: 1.0 / F.size("data"))
        else:
            pairs = F.array_sort(F.collect_list(F.struct("x", "u")))
            parts = self.by_value().groupBy(*self.keys).agg(pairs.alias("s"), F.sum("n").alias("n"), F.count("*").alias("different"))
            parts = parts.withColumn("s", F.when(F.col("n") == 1, F.concat("s", "s")).otherwise(F.col("s")))
            parts = parts.withColumn("total", F.aggregate("s", F.lit(0.0), lambda a, p: a + p["u"].cast("double")))
            parts = parts.select(*self.keys, "n", "different", "total", F.col("s.x").alias("data"), F.transform("s.u", lambda u: u.cast("double") / F.col("total")).alias("weights"))
            weights = F.col("weights")
        total = F.col("total").cast("double") * (F.when(F.col("n") == 1, 2 if kind is EmpDigest else 1).otherwise(1)) * self.unit
        total = F.when(total < math.inf, total).otherwise(F.raise_error(F.lit("a distribution needs samples with finite, positive weights")))
        held = F.when(F.col("n") == 1, 2).otherwise(F.col("different"))
        made = {
            "class_name": F.lit(kind.class_name), "data": F.col("data"), "weights": weights, "sum_weights": total, "total_weight": total, "total_n": F.when(F.col("n") == 1, 2).otherwise(F.col("n")), "pdf_method": F.lit(checked["pdf_method"]),
            "pdf_points": F.lit(options["pdf_points"]) if options.get("pdf_points") else F.greatest(F.lit(2), F.floor(F.sqrt(held.cast("double")))),
            "pdf_params": F.create_map(*(F.lit(x) for pair in checked["pdf_params"].items() for x in pair)), "n_approx": F.size("data") if kind is EmpDigest else F.lit(None), "mode": F.lit(checked["mode"]), "eps": F.lit(checked["eps"]),
        }
        types = dict(x.split(" ", 1) for x in SCHEMA.split(", "))
        whole = F.struct(*(made[k].cast(t).alias(k) for k, t in types.items()))
        return parts.select(*self.keys, (whole if double else F.when(F.col("n") > 1, whole)).alias(name))


def samples(pixels: DataFrame, rule: str, weighted: bool, units, ignore: tuple = ()) -> Samples:
    """The distribution of each zone's pixels under a rule, in rows."""
    from zonarium.operators.statistics import KEYS, _integral, member, valid

    exact = _integral(pixels, "value", "coverage", "weight")
    c, where = member(rule, units.full)
    unit = units.coverage * (units.weight if weighted else 1.0)
    u = (c * F.col("weight") if weighted else c).cast("long" if exact else "double")
    rows = pixels.where(where & valid(ignore)).select(*KEYS, (F.col("value").cast("double") * units.value).alias("x"), u.alias("u")).where("u > 0 and not isnan(u)")
    return Samples(rows, KEYS, unit)


def aggregate_objects(pixels: DataFrame, asked, units, ignore: tuple) -> DataFrame:
    """zone_id, band_name and a struct column for each EmpDist or EmpDigest, made without Python.

    Equal values of a zone are summed first; each zone's sorted samples then make one array, as the object itself is one.
    A zone with a single sample holds it twice, unless doubleOneSampled is False: then it has no object.
    """
    from zonarium.operators.statistics import KEYS

    out = None
    for q in asked:
        options = {_NAMES.get(k, k): v for k, v in q.options if k not in ("ignoreValues", "doubleOneSampled")}
        options.setdefault("pdf_method", "nearest")
        double = dict(q.options).get("doubleOneSampled", True)
        part = samples(pixels, q.rule, q.weighted, units, ignore).objects(EmpDist if q.family == "EmpDist" else EmpDigest, options, double, q.suffix)
        out = part if out is None else out.join(part, list(KEYS), "full")
    return out


def cdf_of(dist: Column, x: Column) -> Column:
    """cdf of a struct column at x, within the JVM: the summed weight of the samples up to x."""
    pairs = F.arrays_zip(dist["data"].alias("data"), dist["weights"].alias("weights"))
    return F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.when(p["data"] <= x, p["weights"]).otherwise(0.0))


def ppf_of(dist: Column, y: float) -> Column:
    """ppf of a struct column at y, within the JVM: the least sample up to which the summed weight reaches y."""
    pairs = F.array_sort(F.arrays_zip(dist["data"].alias("data"), dist["weights"].alias("weights")))
    total = F.aggregate(dist["weights"], F.lit(0.0), lambda a, w: a + w)
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("double").alias("x"))
    step = lambda a, p: F.struct((a["cum"] + p["weights"]).alias("cum"), F.coalesce(a["x"], F.when(a["cum"] + p["weights"] >= (y - _MISS) * total, p["data"])).alias("x"))
    return F.when(dist["data"].isNotNull(), F.coalesce(F.aggregate(pairs, start, step, lambda a: a["x"]), F.array_max(dist["data"])))


def pdf_of(dist: Column, x: Column) -> Column:
    @F.pandas_udf("double")
    def pdf(d: pd.DataFrame, at: pd.Series) -> pd.Series:
        return pd.Series([None if r["data"] is None else float(from_row(_plain(r)).pdf(v)) for r, v in zip(d.to_dict("records"), at, strict=True)], dtype=float)

    return pdf(dist, x)


def _plain(r: dict) -> dict:
    return r | {"pdf_params": dict(r["pdf_params"]) if r["pdf_params"] is not None else {}}


def merge_objects(df: DataFrame, key: str, dist: str, order: str, strategy: str = "pairwise") -> DataFrame:
    """key and the merged struct of each group's distributions, in a stated order, as digests depend on it."""
    from zonarium.functions import merging

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        objects = [from_row(_plain(r)) for r in group.sort_values(order)[dist] if r is not None]
        merged = getattr(merging, strategy + "_sum")(objects)
        return pd.DataFrame({key: [group[key].iloc[0]], dist: [merged.to_row()]})

    kind = dict(df.dtypes)[key]
    return df.select(key, order, dist).groupBy(key).applyInPandas(merge, f"{key} {kind}, {dist} struct<{', '.join(f'{a}: {b}' for a, b in (x.split(' ', 1) for x in SCHEMA.split(', ')))}>")
