"""Spectra and correlation against NumPy over whole windows."""

import math

import numpy as np
import pytest

from terrafold.operators import spectra

RNG = np.random.default_rng(3)


def table(spark, a, complex_=False):
    rows = [(i, j, *((float(a[i, j].real), float(a[i, j].imag)) if complex_ else (float(a[i, j]),))) for i, j in np.ndindex(a.shape)]
    return spark.createDataFrame(rows, "line long, sample long, " + ("re double, im double" if complex_ else "z double"))


def test_power(spark, monkeypatch):
    """A constant slope of noise: the same density at every window's size; windows with a missing pixel are left out."""
    monkeypatch.setattr(spectra, "GROUP", 40)
    a = RNG.normal(size=(16, 20))
    a[13, 2] = math.nan
    got = {(r.u, r.v): (r.power, r.windows) for r in spectra.power(table(spark, a), 4, ["z"], 5.0, taper=False).collect()}
    own = [a[i : i + 4, j : j + 4] for i in range(0, 16, 4) for j in range(0, 20, 4)]
    own = [w - w.mean() for w in own if np.isfinite(w).all()]
    want = np.mean([np.abs(np.fft.fft2(w)) ** 2 for w in own], axis=0) * (5 / 4) ** 2
    assert len(got) == 16 and all(n == 19 for _, n in got.values())
    for (u, v), (p, _) in got.items():
        assert p == pytest.approx(want[u % 4, v % 4])
    assert spectra.power(table(spark, a[:3]), 4, ["z"]).collect() == []


def test_correlation(spark):
    z = RNG.normal(size=(12, 10)) + 1j * RNG.normal(size=(12, 10))
    z[1:] += 0.7j * z[:-1]
    got = {(r.dl, r.ds): (complex(r.re, r.im), r.pairs) for r in spectra.correlation(table(spark, z, True), 6, 5, ["re", "im"], (3, 2)).collect()}
    for (dl, ds), (value, pairs) in got.items():
        want, n = 0, 0
        for i in (0, 6):
            for j in (0, 5):
                w = z[i : i + 6, j : j + 5] - z[i : i + 6, j : j + 5].mean()
                for x, y in np.ndindex(w.shape):
                    if 0 <= x + dl < 6 and 0 <= y + ds < 5:
                        want, n = want + w[x + dl, y + ds] * np.conj(w[x, y]), n + 1
        assert value == pytest.approx(want) and pairs == n
    with pytest.raises(ValueError):
        spectra.correlation(table(spark, z, True), 6, 5, ["re", "im"], (6, 1))


def test_looks_of_a_block(spark):
    """The sum over lags is that over the eigenvalues of the block's covariance."""
    law = lambda d, s: 0.6 ** abs(d) * 0.8 ** abs(s) * np.exp(0.3j * d)
    r = spark.createDataFrame([(d, s, float(law(d, s).real), float(law(d, s).imag)) for d in range(-3, 4) for s in range(-2, 3)], "dl long, ds long, re double, im double")
    got = {(x.lines, x.samples): x.looks for x in spectra.participation(r, [(3, 2), (4, 3), (5, 1)]).collect()}
    for lines, samples in ((3, 2), (4, 3)):
        at = [(i, j) for i in range(lines) for j in range(samples)]
        lam = np.linalg.eigvalsh(np.array([[law(a[0] - b[0], a[1] - b[1]) for b in at] for a in at]))
        assert got[lines, samples] == pytest.approx(lam.sum() ** 2 / (lam**2).sum())
    assert got[5, 1] is None
    assert spectra.half_width(r, "dl").first()[0] == pytest.approx(1 + (0.6 - 0.5) / (0.6 - 0.36))
    assert spectra.half_width(r, "ds").first()[0] is None


def test_correlogram():
    laws = spectra.correlogram(math.exp(-1 / 3.3), math.exp(-2 / 3.3))
    assert laws["exponential"] == (pytest.approx(3.3, rel=1e-6), pytest.approx(0, abs=1e-12)) and laws["gaussian"][1] > 1e-4
    assert spectra.correlogram(math.exp(-((1 / 1.7) ** 2)), math.exp(-((2 / 1.7) ** 2)))["gaussian"][0] == pytest.approx(1.7, rel=1e-6)
