import numpy as np
import pytest

from zonarium.llm import mixing as M


def test_rake_fits_marginals():
    rng = np.random.default_rng(1)
    codes = [rng.integers(0, k, 200) for k in (5, 3, 4)]
    tokens = rng.integers(1, 1000, 200).astype(float)
    goals = [g / g.sum() for g in (rng.random(5), rng.random(3), rng.random(4))]
    w = M.rake(tokens, codes, goals)
    for code, goal in zip(codes, goals):
        assert np.allclose(np.bincount(code, w, len(goal)), goal, atol=1e-6)


def test_factor():
    tokens, w = np.array([10.0, 100.0, 1000.0, 5.0]), np.array([0.5, 0.3, 0.2, 0.0])
    for wanted in (1, 30, 300, 1000):
        c = M.factor_for(tokens, w, wanted)
        assert np.minimum(tokens, c * w).sum() == pytest.approx(wanted)
    assert np.minimum(tokens, M.factor_for(tokens, w, 9999) * w).sum() == pytest.approx(1110)


def docs(spark):
    rows = [(i, ("w%d " % i) * (60 + i % 7 * 20), ["a", "b", None][i % 5 % 3], ["en", "fr"][i % 3 == 0], "t%d" % (i % 4 % 3)) for i in range(4000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")


def test_sample_meets_targets(spark):
    df = docs(spark)
    targets = {"source": {"a": 2, "b": 1, None: 1}, "lang": {"en": 0.5, "fr": 0.5, "de": 0.2}, "topic": {"t0": 1, "t1": 1, "t2": 1}}
    here = {r.doc_id: r for r in M.mixture(df, targets, 0.4, M.F.col("topic")).collect()}
    joined = {r.doc_id: r for r in M.mixture(df, targets, 0.4, M.F.col("topic"), driver_cells=0).collect()}
    assert here.keys() == joined.keys()
    assert all(here[d].probability == pytest.approx(joined[d].probability, abs=1e-4) for d in here)
    total = sum(r.text.count(" ") + 1 for r in df.collect())
    kept = sum(r.n_tokens for r in here.values())
    assert kept == pytest.approx(0.4 * total, rel=0.05)
    for d, goal in (("source", {"a": 0.5, "b": 0.25, None: 0.25}), ("lang", {"en": 0.5, "fr": 0.5})):
        for k, share in goal.items():
            assert sum(r.n_tokens for r in here.values() if r[d] == k) / kept == pytest.approx(share, abs=0.04)
    rows = M.sample_mixture(df, targets, 0.4, M.F.col("topic"))
    assert rows.columns == df.columns and {r.doc_id for r in rows.collect()} == here.keys()


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string, _tokens2 int"
    empty = spark.createDataFrame([], schema)
    assert M.mixture(empty).count() == 0 and M.sample_mixture(empty).count() == 0
    df = spark.createDataFrame([(None, None, None, None, 1), (1, "", "en", "a", 1), (1, "", "en", "a", 1), (2, "x " * 99, "en", "a", 1)], schema)
    got = M.mixture(df, fraction=1.0).collect()
    assert len(got) == 4 and all(r.probability == 1 for r in got)
    assert sorted(r.n_tokens for r in got) == [0, 0, 0, 100]
    assert M.sample_mixture(df, fraction=1.0).columns == df.columns


def test_counts():
    of = lambda t: M.counts_of(np.frombuffer(t.encode(), np.uint8))
    assert of("") == (0, "empty") and of("é x\ty") == (3, "short")
    assert of("word " * 60) == (61, "prose") and of("word\n" * 60)[1] == "lines" and of("12345 wo " * 60)[1] == "numbers" and of("wo*** " * 60)[1] == "symbols"


def test_targets_that_cannot_be_met_are_told():
    tokens = np.array([5.0, 5.0])
    codes = [np.array([0, 1]), np.array([0, 1])]
    with pytest.warns(UserWarning, match="raking ended"):
        M.rake(tokens, codes, [np.array([0.9, 0.1]), np.array([0.1, 0.9])])
