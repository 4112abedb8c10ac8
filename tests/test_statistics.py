import math
import random
from fractions import Fraction

import numpy as np
import pytest

from zonarium.operators import statistics as Z
from zonarium.plans import spec


def reference(v, c, w, inside, name, ignore=()):
    """A quantity by numpy from one zone's pixels."""
    level = spec.parse_quantile(name)
    rule, weighted, family = spec.REGISTRY[level[0] if level else name]
    v, c, w, inside = (np.array(x, float) for x in (v, c, w, inside))
    ok = ~np.isnan(v) & ~np.isin(v, ignore) & ~np.isnan(w)
    v, c, w, inside = v[ok], c[ok], w[ok], inside[ok]
    if rule.startswith("centroid"):
        c = inside if rule == "centroidBased" else inside * c
        rule = rule.removeprefix("centroidBased")
        rule = rule[:1].lower() + rule[1:]
    keep = {"": c == c, "fullyContained": c == 1, "partiallyContained": (c != 0) & (c != 1), "boundary": (c != 0) & (c != 1), "allTouched": c != 0}[rule]
    v, c, w = v[keep], c[keep], w[keep]
    if rule in ("boundary", "allTouched"):
        c = np.ones(len(c))
    if not len(c) or c.sum() == 0:
        return None
    u = c * w if weighted else c
    if family == "Weight":
        return u.sum()
    if family == "Mean":
        return (u * v).sum() / u.sum()
    if family in ("Var", "Std"):
        m = (u * v).sum() / u.sum()
        low = u.sum() - (u * u).sum() / u.sum()
        x = (u * (v - m) ** 2).sum() / low if low > 1e-12 and len(v) > 1 else math.nan
        return math.sqrt(x) if family == "Std" else x
    q = level[1] if level else Fraction(1, 2)
    order = np.argsort(v, kind="stable")
    cum = Fraction(0)
    total = sum(Fraction(x).limit_denominator(10**6) for x in u)
    for k in order:
        cum += Fraction(u[k]).limit_denominator(10**6)
        if cum > 0 and cum >= q * total:
            return v[k]
    return None


def pixels():
    rng = random.Random(3)
    rows = []
    for z in range(12):
        for _ in range(rng.choice([1, 2, 9, 40])):
            c = rng.choice([0.0, 0.25, 0.5, 1.0, 1.0])
            v = rng.choice([math.nan, -9999.0, 5.0, rng.randrange(100) / 4 + 1000])
            rows.append((z, "r_band_1", v, c, float(rng.randrange(1, 9)), c == 1 or (c > 0 and rng.random() < 0.5)))
    return rows + [(50, "r_band_1", math.nan, 1.0, 1.0, True), (51, "r_band_1", 3.0, 0.0, 1.0, False)]


NAMES = [n for n, (_, _, f) in spec.REGISTRY.items() if f not in (*spec.OBJECTS, "Quantile")]
NAMES += [f"{n}-{q}" for n, (_, _, f) in spec.REGISTRY.items() if f == "Quantile" for q in ("0p0", "0p25", "1p0")]


def test_all_quantities_equal_numpy(spark):
    rows = pixels()
    df = spark.createDataFrame(rows, "zone_id int, band_name string, value double, coverage double, weight double, centroid_in boolean")
    lists = ([n for n in NAMES if "entroid" not in n], [n for n in NAMES if "entroid" in n])
    got = {r.zone_id: r.asDict() for r in Z.zonal_statistics(df, *lists, bands=["r_band_1"], ignore_values=(-9999.0,)).collect()}
    zones = sorted({r[0] for r in rows})
    assert sorted(got) == zones
    for z in zones:
        own = list(zip(*[r[2:] for r in rows if r[0] == z]))
        for n in NAMES:
            want = reference(*own, n, (-9999.0,))
            level = spec.parse_quantile(n)
            have = got[z]["r_band_1_" + (spec.quantile_suffix(*level) if level else n)]
            if want is None:
                assert have is None, (z, n, have)
            elif math.isnan(want):
                assert have is None or math.isnan(have), (z, n, have)
            else:
                assert have == pytest.approx(want, rel=1e-9, abs=1e-9), (z, n)


def test_numpy_weighted_quantile_and_cov():
    v, w = np.array([1.0, 2, 4, 9]), np.array([0.2, 0.3, 0.5, 2])
    assert np.cov(v, aweights=w) == pytest.approx(17.653679653679653)
    assert reference(v, w, np.ones(4), np.ones(4), "var") == pytest.approx(17.653679653679653)


def test_exact_ties(spark):
    rows = [(1, "b", i, 1, 1) for i in range(12)]
    df = spark.createDataFrame(rows, "zone_id int, band_name string, value long, coverage long, weight long")
    assert Z.zonal_statistics(df, ["median"], bands=["b"]).first()["b_median"] == 5.0


def test_bands_and_missing_zones(spark):
    rows = [(1, "a", 1.0, 1.0, 1.0), (2, "b", 2.0, 1.0, 1.0), (3, "a", 3.0, 1.0, 1.0), (3, "b", 4.0, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "zone_id int, band_name string, value double, coverage double, weight double")
    zones = spark.createDataFrame([(i, f"z{i}") for i in range(1, 5)], "zone_id int, name string")
    ask = lambda **k: sorted(r.zone_id for r in Z.zonal_statistics(df, ["mean"], bands=["a", "b"], zones=zones, **k).collect())
    assert ask() == [1, 2, 3] and ask(keep_non_intersecting=True) == [1, 2, 3, 4]
    assert ask(non_intersecting_mode="any") == [3]
    out = Z.zonal_statistics(df, ["mean"], zones=zones, keep_raw=True)
    assert out.columns == ["zone_id", "name", "a_mean", "b_mean", "a_pixels", "b_pixels"]


def test_plan_has_one_pixel_shuffle(spark):
    df = spark.createDataFrame([(1, "a", 1, 1, 1)], "zone_id int, band_name string, value long, coverage long, weight long")
    plan = Z.evaluate(df, spec.parse(["mean", "var", "allTouchedMean", "unweightedBoundaryStd"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_sum" in plan


def test_requests():
    asked = [q.suffix for q in spec.parse(["mean", "quantile-0p50", {"empDist": {}}, "allTouchedMean", "mean", "quantile-0p00001"], ["centroidBasedWeight"])]
    assert asked == ["empDist", "quantile-0p5", "quantile-1e-05", "mean", "allTouchedMean", "centroidBasedWeight"]
    assert len(spec.REGISTRY) == 128
    for bad in (["centroidBasedMean"], ["nothing"], ["quantile-1p5"], ["empDist"], [{"mean": {}}], ["quantile"], []):
        with pytest.raises(ValueError):
            spec.parse(bad)
    with pytest.raises(ValueError):
        spec.stems_of(["/a/x.tif", "/b/x.tif"], [1, 1])
    assert spec.band_names(spec.stems_of(["/a/x.tif", "y.v2.tif"], [2, 1])) == ["x_band_1", "x_band_2", "y.v2_band_1"]
    assert spec.broadcast_list("a", 3) == ["a"] * 3
    with pytest.raises(ValueError):
        spec.broadcast_list([1, 2], 3)


def test_objects_and_custom_function(spark):
    from zonarium.functions.empirical import from_row

    rows = [(1, "b", float(v), 1.0, float(w)) for v, w in ((3, 1), (1, 2), (3, 1), (9, 4))] + [(2, "b", 7.0, 0.5, 2.0)]
    df = spark.createDataFrame(rows, "zone_id int, band_name string, value double, coverage double, weight double")
    out = {r.zone_id: r for r in Z.zonal_statistics(df, [{"empDist": {}}, {"unweightedEmpDigest": {"nApprox": 5, "doubleOneSampled": False}}], bands=["b"]).collect()}
    d = from_row(out[1]["b_empDist"])
    assert d.data.tolist() == [1, 3, 9] and d.weights.tolist() == [0.25, 0.25, 0.5] and d.total_n == 4 and d.pdf_method == "nearest"
    assert from_row(out[2]["b_empDist"]).data.tolist() == [7, 7] and out[2]["b_unweightedEmpDigest"] is None
    assert out[1]["b_unweightedEmpDigest"]["data"] == [1, 1, 3, 3, 9]
    got = {r.zone_id: r.spread for r in Z.apply_function(df, lambda v, c, w: np.ptp(v), "spread").collect()}
    assert got == {1: 8.0, 2: 0.0}
