"""Bootstraps and the specification curve against fits of explicit rows."""

import math

import numpy as np
import pytest

from terrafold.operators import bootstrap
from terrafold.plans.registry import QUERIES  # isort: skip  first: it registers the queries
from terrafold.plans.statistics import cluster_robust, logistic

RNG = np.random.default_rng(8)


def rows(n=300):
    x, g = RNG.integers(0, 3, n), RNG.integers(0, 12, n)
    e = RNG.integers(0, 2, n)
    y = RNG.random(n) < 1 / (1 + np.exp(-(-0.5 + 0.8 * e + 0.3 * x + 0.1 * (g % 3))))
    return [(int(a), int(b), int(c), int(d)) for a, b, c, d in zip(y, e, x, g, strict=True)]


def test_weights():
    w = bootstrap.weights(np.arange(2000), 50)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.1
    assert (bootstrap.weights(np.array([7, 3]), 9)[1] == bootstrap.weights(np.array([3]), 50)[0, :9]).all()


def test_sums_over_batches(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "CELLS", 64)
    cells = [(k % 4 or None, k // 4, float(k)) for k in range(80)]
    df = spark.createDataFrame(cells, "g long, block long, v double").repartition(3)
    got = {(r.g, r.replicate): r.v for r in bootstrap.replicate_sums(df, ["g"], "block", ["v"], 16).collect()}
    w = bootstrap.weights(np.arange(20), 16)
    want = {(g, r): sum(w[b, r] * v for h, b, v in cells if h == g) for g in (None, 1, 2, 3) for r in range(16)}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert bootstrap.replicate_sums(df.where("v < 0"), ["g"], "block", ["v"], 16).count() == 0


def test_fits_are_those_of_the_drawn_rows(spark):
    data = rows()
    df = spark.createDataFrame(data, "y int, e int, x int, g int")
    found = bootstrap.replicate_fits(df, "y", ["e", "x"], "g", 6)
    w = bootstrap.weights(np.arange(12), 6).astype(int)
    for r in (0, 3, 5):
        drawn = [d for d in data for _ in range(w[d[3], r])]
        beta, _ = logistic(spark.createDataFrame(drawn, "y int, e int, x int, g int"), "y", ["e", "x"])
        assert found[r] == pytest.approx(np.array(beta), abs=1e-6)
    parted = spark.createDataFrame([(int(k > 5), k, k % 3) for k in range(12)], "y int, x int, g int")
    assert np.isnan(bootstrap.replicate_fits(parted, "y", ["x"], "g", 3)).all()


def test_specifications(spark, monkeypatch):
    df = spark.createDataFrame(rows(), "y int, e int, x int, g int")
    covariates = ["x", "g % 2", "g % 3", "1"]
    got = {r.mask: r for r in bootstrap.specification_curve(df, "y", "e", covariates, "g").collect()}
    assert len(got) == 16 and got[5].covariates == "x, g % 3" and got[5].n_covariates == 2
    for mask in (0, 1, 5, 7):
        chosen = [c for k, c in enumerate(covariates) if mask >> k & 1]
        beta, cov = logistic(df, "y", ["e", *chosen])
        robust = cluster_robust(df, "y", ["e", *chosen], "g", beta, cov)
        assert got[mask].coefficient == pytest.approx(beta[1], abs=1e-6)
        assert got[mask].se == pytest.approx(cov[1][1] ** 0.5, rel=1e-6) and got[mask].se_cluster == pytest.approx(robust[1][1] ** 0.5, rel=1e-5)
    assert got[8].coefficient == pytest.approx(got[0].coefficient)  # a constant covariate says nothing
    parted = spark.createDataFrame([(k % 2, k % 2, k, k) for k in range(40)], "y int, e int, x int, g int")
    assert all(r.coefficient is None for r in bootstrap.specification_curve(parted, "y", "e", ["x % 3"], "g").collect())
    monkeypatch.setattr(bootstrap, "PATTERNS", 3)
    with pytest.raises(ValueError, match="patterns"):
        bootstrap.specification_curve(df, "y", "e", covariates, "g")


def test_percentiles(spark):
    x = RNG.normal(size=500)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    for r in bootstrap.percentiles(df, "v", [0.0, 0.025, 0.5, 1.0]).collect():
        assert r.value == pytest.approx(np.quantile(x, r.q)) and r.used == 500
        if r.q == 0.5:  # the median's error under a normal law
            assert r.se == pytest.approx(math.sqrt(math.pi / 2 / 500), rel=0.15)
    assert bootstrap.percentiles(df.where("v is null"), "v", [0.5]).count() == 0
    assert bootstrap.percentiles(spark.createDataFrame([(2.0,)] * 3, "v double"), "v", [0.5]).first()[1:3] == (2.0, 0.0)


def test_summary_adds_up(spark):
    s = {(r.covariate, r.inside): r for r in QUERIES["specification_summary"](spark, "/root/testdata/sf0.001").collect()}
    assert s["all", True].specifications == 1024 and len(s) == 21
    for (c, inside), r in s.items():
        if c != "all":
            other = s[c, not inside]
            assert r.specifications == 512 and r.unfitted + other.unfitted == s["all", True].unfitted
            assert r.unfitted == 512 or s["all", True].lowest <= r.lowest <= r.median <= r.highest <= s["all", True].highest
