"""Laws of looks and of correlated channels against exact figures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions import laws, radar
from terrafold.plans.registry import QUERIES  # isort: skip  first: it registers the queries
from terrafold.plans.matrices import moments

SF = "/root/testdata/sf0.001"


def test_tails_without_coherence(spark):
    """Whole looks: the binomial sum; any looks: symmetry, and 1 look's closed form 1 / (1 + x)."""
    rows = [(n, x) for n in (1, 2, 5, 14, 30) for x in (0.01, 0.7, 1.0, 1.3, 2.0, 9.0, 400.0)]
    df = spark.createDataFrame(rows, "n int, x double")
    for r in df.select("n", "x", F.expr(laws.correlated_tail("double(n)", "0D", "x")).alias("got"), radar.ratio_tail("n", "x").alias("want")).collect():
        assert r.got == pytest.approx(r.want, abs=2e-7)
    half = spark.createDataFrame([(2.5, 1.7), (0.6, 3.0)], "n double, x double").select(F.expr(laws.correlated_tail("n", "0D", "x")).alias("a"), F.expr(laws.correlated_tail("n", "0D", "(1 / x)")).alias("b"))
    assert all(r.a + r.b == pytest.approx(1) for r in half.collect())


def test_tails_with_coherence(spark):
    """Against Gaussian channels drawn with that coherence."""
    rng = np.random.default_rng(1)
    n, g2, size = 4, 0.5, 200_000
    a, b, c = (rng.normal(size=(size, n)) + 1j * rng.normal(size=(size, n)) for _ in range(3))
    h, v = math.sqrt(math.sqrt(g2)) * a + math.sqrt(1 - math.sqrt(g2)) * b, math.sqrt(math.sqrt(g2)) * a + math.sqrt(1 - math.sqrt(g2)) * c
    ratio = (abs(h) ** 2).sum(axis=1) / (abs(v) ** 2).sum(axis=1)
    for x in (0.8, 1.5, 2.5):
        got = spark.range(1).select(F.expr(laws.correlated_tail(f"{n}D", f"{g2}D", f"{x}D"))).first()[0]
        assert got == pytest.approx((ratio > x).mean(), abs=5 * math.sqrt(0.25 / size))


def test_inversions(spark):
    tri = lambda n: math.pi**2 / 6 - sum(1 / k**2 for k in range(1, n))
    one = spark.createDataFrame([(n, tri(n)) for n in (1, 2, 9)], "n int, v double").select("n", radar.looks_of("v", law=radar.log_determinant_law(1)).alias("got"))
    two = spark.createDataFrame([(n, tri(n) + tri(n - 1)) for n in (2, 3, 9)], "n int, v double").select("n", radar.looks_of("v", law=radar.log_determinant_law(2)).alias("got"))
    for r in [*one.collect(), *two.collect()]:
        assert r.got == pytest.approx(r.n, rel=1e-6)
    assert spark.sql("SELECT 0D AS v").select(radar.looks_of("v", law=radar.log_determinant_law(2))).first()[0] is None


def test_moments_of_drawn_matrices(spark):
    """Matrices of 6 looks of independent channels: every estimator finds about 6."""
    rng, looks = np.random.default_rng(2), 6
    rows = []
    for i, j in np.ndindex(60, 60):
        h, v = (rng.normal(size=looks) + 1j * rng.normal(size=looks) for _ in range(2))
        x = (h * v.conj()).mean()
        rows.append((i, j, float((abs(h) ** 2).mean()), float((abs(v) ** 2).mean()), float(x.real), float(x.imag)))
    c = spark.createDataFrame(rows, "line long, sample long, hh double, vv double, re double, im double")
    r = moments(c, 60, 60).select("moment_h", "trace_moment", radar.looks_of("log_h", law=radar.log_determinant_law(1)).alias("log_h"), radar.looks_of("log_det", law=radar.log_determinant_law(2)).alias("log_det")).first()
    assert all(abs(x - looks) < 0.5 for x in r), r
    assert moments(c.where("line > 0"), 60, 60).count() == 0


def test_histogram_counts_what_is_tested(spark):
    tested = sum(r.tested for r in QUERIES["held_out_tails"](spark, SF).collect())
    assert sum(r.n for r in QUERIES["tail_histogram"](spark, SF).collect()) == tested
