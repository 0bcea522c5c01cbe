"""Spectra and correlation of rasters and complex channels, over windows of a bounded size.

A window is a square (or a run of lines) of whole pixels; a group is a few windows side by side. Each group's Fourier
sums, or its products by lag, are added up in its task, and Spark adds the groups: what is shuffled afterwards are sums
by frequency or by lag, whose number is the window's.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Windows that lie side by side in a group, at most about so many pixels.
GROUP = 1 << 16


def _windows(rows: pd.DataFrame, lines: int, samples: int, columns: list[str]) -> np.ndarray:
    """The whole windows among a group's pixels: windows x lines x samples (complex for two columns)."""
    v = rows[columns].to_numpy(float)
    values = v[:, 0] if len(columns) == 1 else v[:, 0] + 1j * v[:, 1]
    window = rows["sample"].to_numpy() // samples
    ids, at = np.unique(window, return_inverse=True)
    a = np.full((len(ids), lines, samples), np.nan, values.dtype)
    a[at, rows["line"].to_numpy() % lines, rows["sample"].to_numpy() % samples] = values
    return a[np.isfinite(a).all(axis=(1, 2))]


def windowed(px: DataFrame, lines: int, samples: int, columns: list[str], what: Callable[[np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """what(windows) for each group of whole windows; windows with a missing, null, NaN or infinite pixel are left out."""
    side = max(1, GROUP // (lines * samples))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a = _windows(rows, lines, samples, columns)
        return what(a) if len(a) else pd.DataFrame([], columns=[c.split()[0] for c in schema.split(", ")])

    keyed = px.select("line", "sample", *[F.col(c).cast("double").alias(c) for c in columns])
    return keyed.groupBy(F.expr(f"line div {lines}").alias("_a"), F.expr(f"sample div {samples} div {side}").alias("_b")).applyInPandas(run, schema)


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1)) if n > 1 else np.ones(n)


def power(px: DataFrame, size: int, columns: list[str], spacing: float = 1.0, taper: bool = True) -> DataFrame:
    """u, v, f (cycles for each unit of ground), power, windows: mean power by frequency over all whole windows of size x size pixels.

    Each window loses its mean and gets a Hann taper. Power is a density, so that windows and spacings of any size
    estimate the same one. u and v run from -size div 2, along lines and along samples.
    """
    w = hann(size) if taper else np.ones(size)
    scale = (spacing / size) ** 2 / (w**2).mean() ** 2
    k = (np.arange(size) + size // 2) % size - size // 2
    at = pd.DataFrame({"u": np.repeat(k, size), "v": np.tile(k, size)})

    def sums(a: np.ndarray) -> pd.DataFrame:
        a = (a - a.mean(axis=(1, 2), keepdims=True)) * w[:, None] * w[None, :]
        return at.assign(power=(np.abs(np.fft.fft2(a)) ** 2).sum(axis=0).reshape(-1) * scale, windows=len(a))

    got = windowed(px, size, size, columns, sums, "u long, v long, power double, windows long").groupBy("u", "v").agg(F.sum("power").alias("power"), F.sum("windows").alias("windows"))
    return got.select("u", "v", F.expr(f"sqrt(u * u + v * v) / ({size} * {float(spacing)!r}D)").alias("f"), (F.col("power") / F.col("windows")).alias("power"), "windows")


def radial(spectrum: DataFrame, spacing: float, bins: int) -> DataFrame:
    """bin, f, power, n: the mean of power() over rings of equal width up to the highest frequency of the grid; what lies beyond counts to the last ring."""
    top = f"(1 / (2 * {float(spacing)!r}D))"
    ring = F.expr(f"int(least({bins - 1}, floor(f / {top} * {bins} + 1e-9)))").alias("bin")
    return spectrum.groupBy(ring).agg(F.avg("power").alias("power"), F.count("*").alias("n")).select("bin", F.expr(f"(bin + 0.5D) * {top} / {bins}").alias("f"), "power", "n")


def low_pass_study(spectrum: DataFrame, spacing: float, coarse: float, sigmas: list[float]) -> DataFrame:
    """sigma, kept, folded: of a Gaussian low-pass (sigma in pixels; 0 is none) before a coarser grid, the share of the power that the grid can carry which it keeps, and the power that folds back, over that share's whole.

    The sharp filter at the coarse grid's limit keeps all (kept 1) and folds nothing (folded 0).
    """
    limit = f"(f <= 1 / (2 * {float(coarse)!r}D))"
    s = spectrum.select("f", "power", F.explode(F.array(*[F.lit(float(x)) for x in sigmas])).alias("sigma"))
    passed = f"power * exp(-4 * pow(pi() * sigma * {float(spacing)!r}D * f, 2))"
    total = F.sum(F.expr(f"if({limit}, power, 0D)"))
    return s.groupBy("sigma").agg((F.sum(F.expr(f"if({limit}, {passed}, 0D)")) / total).alias("kept"), (F.sum(F.expr(f"if({limit}, 0D, {passed})")) / total).alias("folded"))


def correlation(px: DataFrame, lines: int, samples: int, columns: list[str], reach: tuple[int, int], means: str = "window") -> DataFrame:
    """dl, ds, re, im, pairs: over all whole windows, the sum of z(p + lag) times the conjugate of z(p), for lags up to reach lines and samples either way.

    means: what is taken off first, each window's mean or each of its columns' (column).
    """
    if reach[0] >= lines or reach[1] >= samples:
        raise ValueError("lags must lie within a window")
    dl, ds = np.arange(-reach[0], reach[0] + 1), np.arange(-reach[1], reach[1] + 1)
    at = pd.DataFrame({"dl": np.repeat(dl, len(ds)), "ds": np.tile(ds, len(dl))})
    pairs = ((lines - np.abs(dl))[:, None] * (samples - np.abs(ds))[None, :]).reshape(-1)

    def sums(a: np.ndarray) -> pd.DataFrame:
        a = a - a.mean(axis=1 if means == "column" else (1, 2), keepdims=True)
        # Twice the window's size, so that no pixel meets one from the other side.
        p = np.fft.ifft2((np.abs(np.fft.fft2(a, s=(2 * lines, 2 * samples))) ** 2).sum(axis=0))
        found = p[np.ix_(dl % (2 * lines), ds % (2 * samples))].reshape(-1)
        return at.assign(re=found.real, im=found.imag, pairs=pairs * len(a))

    return windowed(px, lines, samples, columns, sums, "dl long, ds long, re double, im double, pairs long").groupBy("dl", "ds").agg(*[F.sum(c).alias(c) for c in ("re", "im", "pairs")])


def normalised(c: DataFrame, unbiased: bool = True) -> DataFrame:
    """dl, ds, re, im of correlation(), 1 at lag 0: of means over pairs (unbiased), or of plain sums."""
    one = "pairs" if unbiased else "1"
    zero = c.where("dl = 0 and ds = 0").select(F.expr(f"re / {one}").alias("_zero"))
    return c.join(F.broadcast(zero)).select("dl", "ds", F.expr(f"re / {one} / _zero").alias("re"), F.expr(f"im / {one} / _zero").alias("im"))  # one row


def area(r: DataFrame) -> DataFrame:
    """area, positive: pixels for an independent sample, the sum of a correlation over its lags, and over its positive ones."""
    return r.agg(F.sum("re").alias("area"), F.sum(F.greatest("re", F.lit(0.0))).alias("positive"))


def half_width(r: DataFrame, axis: str) -> DataFrame:
    """half_width: the lag along an axis (dl or ds) at which a correlation's size first falls to a half, between two lags by a line; null if it doesn't."""
    other = "ds" if axis == "dl" else "dl"
    line = r.where(f"{other} = 0 and {axis} >= 0").agg(F.array_sort(F.collect_list(F.struct(F.col(axis).alias("d"), F.expr("sqrt(re * re + im * im)").alias("v")))).alias("x"))  # reach lags
    line = line.withColumn("k", F.expr("array_position(transform(x, p -> p.v <= 0.5), true)"))
    return line.select(F.expr("if(k > 1, x[int(k - 2)].d + (x[int(k - 2)].v - 0.5) / (x[int(k - 2)].v - x[int(k - 1)].v) * (x[int(k - 1)].d - x[int(k - 2)].d), null)").alias("half_width"))


def participation(r: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """lines, samples, looks: independent looks in a block of pixels whose correlation is r, the squared sum of its covariance's eigenvalues over their sum of squares.

    The sum of eigenvalues is a diagonal of ones, and that of their squares is the sum of squared sizes of all entries:
    each lag stands in a block as often as it fits there.
    """
    s = r.select("dl", "ds", F.expr("re * re + im * im").alias("p"), F.explode(F.array(*[F.struct(F.lit(a).alias("lines"), F.lit(b).alias("samples")) for a, b in shapes])).alias("s")).select("dl", "ds", "p", "s.*")
    s = s.where("abs(dl) < lines and abs(ds) < samples")
    fits = "(lines - abs(dl)) * (samples - abs(ds))"
    # A block that reaches beyond the known lags has no answer.
    return s.groupBy("lines", "samples").agg(F.sum(F.expr(f"p * {fits}")).alias("q"), F.count("*").alias("n")).select(
        "lines", "samples", F.when(F.col("n") == (2 * F.col("lines") - 1) * (2 * F.col("samples") - 1), F.pow(F.col("lines") * F.col("samples"), F.lit(2)) / F.col("q")).alias("looks")
    )


def correlogram(one: float, two: float) -> dict[str, tuple[float, float]]:
    """Length and squared error of exp(-d / length) and of exp(-(d / length)**2) fitted to the correlations at lags 1 and 2, by golden sections within scans."""
    out = {}
    for name, law in (("exponential", lambda d, x: np.exp(-d / x)), ("gaussian", lambda d, x: np.exp(-((d / x) ** 2)))):
        error = lambda x: (law(1, x) - one) ** 2 + (law(2, x) - two) ** 2  # noqa: B023, E731
        grid = np.geomspace(0.05, 50, 400)
        k = int(np.argmin(error(grid)))
        a, b = grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)]
        ratio = (math.sqrt(5) - 1) / 2
        for _ in range(80):
            c, d = b - ratio * (b - a), a + ratio * (b - a)
            a, b = (a, d) if error(c) < error(d) else (c, b)
        out[name] = (float((a + b) / 2), float(error((a + b) / 2)))
    return out
