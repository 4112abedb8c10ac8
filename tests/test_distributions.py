import math
import random

import numpy as np
import pytest

from zonarium.functions import distributions as D
from zonarium.functions import merging
from zonarium.functions import special as S
from zonarium.functions.empirical import EmpDigest, EmpDist, cdf_of, from_row, merge_objects, pdf_of, ppf_of
from zonarium.functions.joint import JointDistribution, bivariate_normal_pdf

PAR = {
    "beta": [2, 3, 1, 5], "binomial": [10, 0.3], "chisquare": [4], "exponential": [2], "frechet": [2, 4], "gamma": [2, 3], "geometric": [0.3], "gev": [0.1, 2, 5], "gevmin": [0.1, 2, 5],
    "gumbel": [2, 5], "gumbelmin": [2, 5], "lognormal": [1, 0.5], "negativebinomial": [3, 0.4], "normal": [1, 2], "pareto": [1, 3], "poisson": [4], "rayleigh": [2], "standardnormal": [],
    "truncatednormal": [1, 2, 0, 4], "uniform": [1, 3], "weibull": [2, 1.5],
}


@pytest.mark.parametrize("name", PAR)
def test_family(name):
    d = D.Distribution(name.upper(), "par", PAR[name])
    y = np.array([0.001, 0.2, 0.5, 0.9, 0.999])
    x = d.icdf(y)
    if d.discrete:
        assert (d.cdf(x) >= y - 1e-12).all() and (d.cdf(x - 1) < y + 1e-12).all()
        k = np.arange(0, 400)
        assert d.pdf(k).sum() == pytest.approx(1) and (k * d.pdf(k)).sum() == pytest.approx(d.mean())
        assert np.allclose(np.cumsum(d.pdf(k)), d.cdf(k), atol=1e-9)
    else:
        assert np.allclose(d.cdf(x), y, atol=1e-9)
        grid = np.linspace(x[1], x[3], 4001)
        assert np.trapezoid(d.pdf(grid), grid) == pytest.approx(0.7, abs=1e-4)
    s = d.random(4000, seed=1)
    assert s.mean() == pytest.approx(d.mean(), abs=0.06 * max(1, d.std())) and s.std() == pytest.approx(d.std(), rel=0.15)
    if name == "standardnormal":
        with pytest.raises(RuntimeError):
            D.Distribution(name, "DATA", s)
        return
    moments = {"beta": [d.mean(), d.std(), 1, 5], "truncatednormal": [d.mean(), d.std(), 0, 4], "gev": [d.mean(), d.std(), 0.1], "gevmin": [d.mean(), d.std(), 0.1]}.get(name)
    moments = moments or ([d.mean()] if name in ("exponential", "geometric", "poisson", "rayleigh", "chisquare") else [d.mean(), d.std()])
    assert D.Distribution(name, "MOM", moments).par == pytest.approx(d.par, rel=1e-3)
    data = {"beta": (s, 1, 5), "binomial": (s, 10), "truncatednormal": (s, 0, 4)}.get(name, s)
    assert D.Distribution(name, "DATA", data).mean() == pytest.approx(d.mean(), rel=0.05)


@pytest.mark.parametrize("name,opt,val", [("nothing", "PAR", [1]), ("normal", "XXX", [1, 2]), ("normal", "PAR", [1, -2]), ("normal", "MOM", [1, -2]), ("binomial", "PAR", [2.5, 0.1]), ("beta", "MOM", [0.5, 0.9, 0, 1]), ("uniform", "PAR", [3, 1]), ("gamma", "PAR", [0, 1])])
def test_refusals(name, opt, val):
    with pytest.raises(RuntimeError):
        D.Distribution(name, opt, val)
    with pytest.raises(NotImplementedError):
        D.Distribution("normal", "PAR", [0, 1]) + D.Distribution("normal", "PAR", [0, 1])


def test_special():
    assert np.allclose(S.normal_icdf([0.025, 0.5, 0.975, 1e-10]), [-1.959963984540054, 0, 1.959963984540054, -6.361340902404056], atol=1e-9)
    assert float(S.gamma_p(2.5, 3.0)) == pytest.approx(0.693781, abs=1e-6)
    assert float(S.beta_i(2, 3, 0.4)) == pytest.approx(0.5248)
    assert S.digamma(1.0) == pytest.approx(-S.EULER)


def test_fits_as_aggregates(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(x)) for g in (1, 2) for x in np.ceil(rng.gamma(3, 2, 400))]
    df = spark.createDataFrame(rows, "g int, x double")
    for name, extra in (("lognormal", ()), ("pareto", ()), ("negativebinomial", ()), ("binomial", (100,)), ("poisson", (2.0,)), ("gamma", ()), ("weibull", ()), ("gumbel", ())):
        got = {r.g: r.par for r in D.fit_groups(df, ["g"], "x", name, extra).collect()}
        for g in (1, 2):
            x = [v for k, v in rows if k == g]
            assert got[g] == pytest.approx(D.Distribution(name, "DATA", [x, *extra] if extra else x).par, rel=1e-6), name


def test_columns_equal_objects(spark):
    df = spark.createDataFrame([(float(x), (x + 0.5) / 12) for x in range(12)], "x double, y double")
    for name in ("exponential", "uniform", "rayleigh", "weibull", "gumbel", "gumbelmin", "frechet", "pareto", "gev"):
        d = D.Distribution(name, "PAR", PAR[name])
        rows = df.select("x", "y", D.cdf_column(name, d.par, df.x).alias("c"), D.icdf_column(name, d.par, df.y).alias("q"), D.evaluated(d, "cdf", df.x).alias("e")).collect()
        for r in rows:
            assert r.c == pytest.approx(float(d.cdf(r.x)), abs=1e-12) and r.e == pytest.approx(r.c, abs=1e-12) and r.q == pytest.approx(float(d.icdf(r.y)), rel=1e-9)
    assert D.random_rows(spark, d, 50).count() == 50


def test_empirical():
    d = EmpDist([3, 1, math.nan, 2, 2], [1, 2, 5, 0.5, 0.5])
    assert d.cdf([0, 1, 2, 9]).tolist() == pytest.approx([0, 0.5, 0.75, 1])
    assert d.ppf([0, 0.5, 0.51, 0.76, 1]).tolist() == [1, 1, 2, 3, 3]
    assert d.mean() == pytest.approx(1.75) and d.var() == pytest.approx(float(np.cov(d.data, aweights=d.weights)))
    both = d + EmpDist([7], [4])
    assert both.sum_weights == 8 and both.total_n == 5 and both.cdf(3) == pytest.approx(0.5)
    assert sum([d, d]).total_n == 8
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(-2, 0.5, 800), rng.normal(3, 1, 3200)])
    for kind in ("kde", "nearest", "linear", "previous", "next"):
        e = EmpDist(x, pdf_method=kind)
        grid = np.linspace(x.min(), x.max(), 2000)
        assert np.trapezoid(e.pdf(grid), grid) == pytest.approx(1, abs=0.05) and e.pdf(99.0) == pytest.approx(0, abs=1e-12)
    g = EmpDigest(x, n_approx=100)
    assert len(g.data) == 100 and g.total_n == 4000 and abs(g.ppf(0.5) - np.median(x)) < 0.1
    merged = g + EmpDigest(x + 1, n_approx=50)
    assert merged.n_approx == 100 and merged.total_n == 8000
    with pytest.raises(NotImplementedError):
        EmpDigest(x, mode="tailFocused")
    for o in (d, g):
        again, row = from_row(o.to_row()).to_row(), o.to_row()
        assert np.allclose(again.pop("weights"), row.pop("weights"), atol=1e-15) and again == row
    with pytest.raises(ValueError):
        from_row(d.to_row() | {"data": []})


def test_merging_orders():
    words = ["a", "bb", "c", "dd", "e"]
    assert merging.sequential_sum(words) == merging.pairwise_sum(words) == "abbcdde"
    assert sorted(merging.minorization_sum([[x] for x in words], [1, 2, 3, 4, 50])) == words
    rng = random.Random(1)
    parts = [EmpDigest([rng.lognormvariate(0, 1) for _ in range(300)], n_approx=200) for _ in range(8)]
    assert merging.pairwise_sum(parts).total_n == 2400


def test_empirical_columns(spark):
    rows = [(g, k, EmpDist(np.arange(5) + 10 * k).to_row()) for g in (1, 2) for k in range(3)]
    from zonarium.functions.empirical import SCHEMA

    df = spark.createDataFrame([(g, k, tuple(d.values())) for g, k, d in rows], f"g int, k int, d struct<{', '.join(x.replace(' ', ': ', 1) for x in SCHEMA.split(', '))}>")
    out = merge_objects(df, "g", "d", "k")
    got = out.select("g", cdf_of(out.d, D.F.lit(12.0)).alias("c"), ppf_of(out.d, 0.5).alias("p"), pdf_of(out.d, D.F.lit(12.0)).alias("f")).collect()
    assert {(r.g, round(r.c, 12), r.p) for r in got} == {(1, round(8 / 15, 12), 12.0), (2, round(8 / 15, 12), 12.0)} and all(r.f > 0 for r in got)


def test_joint(spark):
    m = [D.Distribution("normal", "PAR", [1, 2]), D.Distribution("lognormal", "PAR", [0, 0.5]), D.Distribution("gumbel", "PAR", [2, 5])]
    rho = [[1, 0.5, 0.3], [0.5, 1, -0.2], [0.3, -0.2, 1]]
    j = JointDistribution(m, rho, nodes=256)
    u = np.random.default_rng(1).standard_normal((4000, 3))
    x, jac = j.u_to_x(u, jacobian=True)
    back, inverse = j.x_to_u(x, jacobian=True)
    assert np.allclose(back, u, atol=1e-6) and np.allclose(jac[0] @ inverse[0], np.eye(3), atol=1e-6)
    assert np.allclose(np.corrcoef(x.T), rho, atol=0.06)
    p = [[1.5, 1.1, 6.0]]
    share = (x <= np.array(p)).all(1).mean()
    assert j.cdf(p)[0] == pytest.approx(share, abs=0.02)
    n2 = JointDistribution([m[0], m[0]], [[1, 0.4], [0.4, 1]])
    assert n2.pdf([[1, 3]])[0] == pytest.approx(float(bivariate_normal_pdf(0.0, 1.0, 0.4)) / 4)
    df = spark.createDataFrame([(1, 1.5, 1.1, 6.0)], "id int, a double, b double, c double")
    assert j.transform(df, ["a", "b", "c"], "pdf").first().density == pytest.approx(float(j.pdf(p)[0]))
    assert j.transform(df, ["a", "b", "c"], "x_to_u").columns == ["id", "a", "b", "c", "u1", "u2", "u3"]
    assert j.random_rows(spark, 20).count() == 20
    with pytest.raises(RuntimeError):
        JointDistribution(m[:2], [[1, 1.2], [1.2, 1]])
    with pytest.raises(RuntimeError):
        JointDistribution([D.Distribution("poisson", "PAR", [3])] * 2, [[1, 0.2], [0.2, 1]], nodes=64).x_to_u([[1, 2]])


@pytest.mark.parametrize("compressed", [True, False])
def test_save_and_load(tmp_path, compressed):
    from zonarium.functions.distributions import Distribution

    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    made = [Distribution("normal", "PAR", [1, 2]), Distribution("gev", "PAR", [0.1, 11, 19]), Distribution("binomial", "PAR", [50, 0.3]), Distribution("empirical", "DATA", [x, None, "nearest"]), Distribution("empiricaldigest", "DATA", [x, None, 30, "densityFocused", None, "nearest"])]
    for d in made:
        d.save(path := f"{tmp_path}/{d.name}", compressed)
        back = Distribution.load(path)
        q = np.linspace(0.05, 0.95, 7)
        assert back.name == d.name and np.allclose(back.icdf(q), d.icdf(q), rtol=1e-13) and np.allclose(back.cdf(np.sort(x[:9])), d.cdf(np.sort(x[:9])), rtol=1e-13)
    (tmp_path / "no").write_bytes(b"nothing")
    with pytest.raises(ValueError):
        Distribution.load(f"{tmp_path}/no")


def _pixels(spark):
    """Zones of many, few, two equal and one sample."""
    rng = np.random.default_rng(7)
    rows = [(z, "b", int(v), int(c), int(w)) for z, n in ((1, 400), (2, 9), (3, 1)) for v, c, w in zip(rng.integers(0, 90, n), rng.integers(1, 11, n), rng.integers(1, 50, n), strict=True)]
    rows += [(4, "b", 5, 10, 3), (4, "b", 5, 2, 1), (5, "b", 5, 0, 3)]
    return rows, spark.createDataFrame(rows, "zone_id long, band_name string, value long, coverage long, weight long")


def test_samples_say_what_objects_say(spark):
    from zonarium.functions.empirical import samples
    from zonarium.operators.statistics import Units, zonal_statistics

    rows, df = _pixels(spark)
    found, objects = samples(df, "", True, Units(0.5, 0.1, 1.0, 10)), {}
    for z in (1, 2, 3, 4):
        x = sorted({r[2] for r in rows if r[0] == z})
        u = [sum(r[3] * r[4] for r in rows if r[0] == z and r[2] == v) * 0.1 for v in x]
        single = sum(r[0] == z for r in rows) == 1
        objects[z] = EmpDist([v * 0.5 for v in x] * (1 + single), u * (1 + single))
        objects[z].total_n = 1 + single if single else sum(r[0] == z for r in rows)
    levels = {"a": 0.0, "b": 0.31, "c": 0.5, "d": 1.0}
    assert {r.zone_id: list(r)[2:] for r in found.ppf(levels).collect()} == {z: [float(o.ppf(y)) for y in levels.values()] for z, o in objects.items()}
    assert {r.zone_id: r.cdf for r in found.cdf(22.0).collect()} == pytest.approx({z: float(o.cdf(22.0)) for z, o in objects.items()})
    for method in ("scott", "silverman", 0.4):
        want = {z: float(EmpDist(o.data, o.raw, bw_method=method).pdf(22.0)) for z, o in objects.items()}
        assert {r.zone_id: r.density for r in found.kde(22.0, bw_method=method).collect()} == pytest.approx(want, rel=1e-9)
    for n in (1, 2, 7, 1000, None):
        want = {z: EmpDigest(o.data, o.raw, n_approx=n) for z, o in objects.items()}
        asked = {"nApprox": n, "pdfMethod": "linear"}
        out = {r.zone_id: r for r in zonal_statistics(df, [{"empDist": {"pdfMethod": "kde", "bw_method": 0.3}}, {"empDigest": asked}], bands=["b"], units=Units(0.5, 0.1, 1.0, 10)).collect()}
        assert out[5]["b_empDist"] is None and out[5]["b_empDigest"] is None
        for z, o in objects.items():
            got, exact = from_row(out[z]["b_empDigest"].asDict()), from_row(out[z]["b_empDist"].asDict())
            assert got.data.tolist() == want[z].data.tolist() and np.allclose(got.weights, want[z].weights) and got.sum_weights == pytest.approx(o.sum_weights)
            assert (got.n_approx, got.total_n, got.pdf_points, got.pdf_method) == (want[z].n_approx, o.total_n, want[z].pdf_points, "linear")
            assert exact.data.tolist() == o.data.tolist() and np.allclose(exact.weights, o.weights) and exact.sum_weights == pytest.approx(o.sum_weights)
            assert (exact.total_n, exact.pdf_points, exact.pdf_method, exact.pdf_params) == (o.total_n, o.pdf_points, "kde", {"bw_method": "0.3"})
    whole = merging.sequential_sum(list(objects.values()))
    merged = found.merged(D.F.lit(0), "g")
    assert list(merged.ppf(levels).first())[1:] == [float(whole.ppf(y)) for y in levels.values()]
    assert merged.cdf(22.0).first().cdf == pytest.approx(float(whole.cdf(22.0)))
    alone = merging.sequential_sum([o for z, o in objects.items() if z != 3])
    assert found.merged(D.F.lit(0), "g", double=False).cdf(22.0).first().cdf == pytest.approx(float(alone.cdf(22.0)))


def test_exact_distributions_are_joined_at_once(monkeypatch):
    rng = np.random.default_rng(9)
    parts = [EmpDist(rng.integers(0, 50, 20), rng.random(20), "linear") for _ in range(60)]
    want, seen = parts[0], []
    for p in parts[1:]:
        want = want + p
    sort = np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, **k: (seen.append(len(x)), sort(x, **k))[1])
    got = merging.sequential_sum(parts)
    assert sum(seen) == 1200
    assert got.data.tolist() == want.data.tolist() and np.allclose(got.weights, want.weights) and (got.total_n, got.pdf_points) == (want.total_n, want.pdf_points)
    digests = [EmpDigest(p.data, p.raw, n_approx=9) for p in parts]
    assert merging.sequential_sum(digests).n_approx == 9


@pytest.mark.parametrize("name", ["q_empdist_ppf", "q_empdist_merge_sequential", "q_empdist_merge_quantile", "q_empdist_merge_minorization", "q_empdist_cdf", "q_kde", "q_empdigest_points", "q_empDigest", "q_boundaryEmpDist"])
def test_distributions_need_no_python_workers(spark, name):
    from zonarium.plans import catalog

    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "collect_list(struct(x" not in plan


def test_stored_quantiles_need_no_python_workers(spark):
    from zonarium.operators.statistics import Units, zonal_statistics

    _, df = _pixels(spark)
    out = zonal_statistics(df, [{"empDist": {}}, {"empDigest": {"nApprox": 5}}], bands=["b"], units=Units(full=10))
    asked = out.select("zone_id", ppf_of(out.b_empDist, 0.4).alias("p"), ppf_of(out.b_empDigest, 0.4).alias("q"), "b_empDist", "b_empDigest")
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    for r in asked.collect():
        for value, d in ((r.p, r.b_empDist), (r.q, r.b_empDigest)):
            assert value == (None if d is None else float(from_row(d.asDict()).ppf(0.4)))
