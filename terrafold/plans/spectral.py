"""Queries of spectra and of correlation by lag, over windows of rasters and of complex looks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from terrafold.operators import spectra
from terrafold.plans.raster import r6
from terrafold.plans.registry import PX, query
from terrafold.shared import staged
from terrafold.sources import views

#: Window's edge, ground spacing of the grid and of a coarser one, rings, sigmas of the low-pass.
SIZE, SPACING, COARSE, RINGS, SIGMAS = 10, 20.0, 50.0, 8, [0.0, 0.5, 1.0, 2.0]
_TAPER = f"(0.5 - 0.5 * cos(2 * pi() * {{}} / {SIZE - 1}))"
_SCALE = (SPACING / SIZE) ** 2 / (sum((0.5 - 0.5 * math.cos(2 * math.pi * k / (SIZE - 1))) ** 2 for k in range(SIZE)) / SIZE) ** 2
_SPECTRUM = f"""m AS (SELECT line // {SIZE} AS a, sample // {SIZE} AS b, avg(z) AS mean FROM {PX} GROUP BY 1, 2 HAVING count(*) = {SIZE * SIZE}),
w AS (SELECT a, b, line % {SIZE} AS l, sample % {SIZE} AS s, (z - mean) * {_TAPER.format(f'(line % {SIZE})')} * {_TAPER.format(f'(sample % {SIZE})')} AS x FROM {PX} p JOIN m ON p.line // {SIZE} = a AND p.sample // {SIZE} = b),
k AS (SELECT unnest(range({-(SIZE // 2)}, {SIZE - SIZE // 2})) AS k),
h AS (SELECT a, b, l, k.k AS v, sum(x * cos(2 * pi() * k.k * s / {SIZE})) AS re, -sum(x * sin(2 * pi() * k.k * s / {SIZE})) AS im FROM w, k GROUP BY 1, 2, 3, 4),
f AS (SELECT a, b, k.k AS u, v, sum(re * cos(2 * pi() * k.k * l / {SIZE}) + im * sin(2 * pi() * k.k * l / {SIZE})) AS re, sum(im * cos(2 * pi() * k.k * l / {SIZE}) - re * sin(2 * pi() * k.k * l / {SIZE})) AS im FROM h, k GROUP BY 1, 2, 3, 4),
p AS (SELECT u, v, sqrt(u * u + v * v) / {SIZE * SPACING} AS f, avg(re * re + im * im) * {_SCALE!r} AS power FROM f GROUP BY 1, 2)"""


def spectrum(spark, sf_dir):
    return spectra.power(views.pixels(spark, sf_dir), SIZE, ["z"], SPACING)


@query(f"WITH {_SPECTRUM} SELECT least({RINGS - 1}, floor(f * {2 * SPACING} * {RINGS} + 1e-9))::INT AS bin, round((bin + 0.5) / {2 * SPACING} / {RINGS}, 9) AS f, round(avg(power), 3) AS power, count(*) AS n FROM p GROUP BY 1")
def radial_spectrum(spark, sf_dir):
    """Power by rings of frequency, over all whole windows, tapered; windows are transformed in their groups, frequencies summed."""
    s = spectra.radial(spectrum(spark, sf_dir), SPACING, RINGS)
    return s.select("bin", F.round("f", 9).alias("f"), F.round("power", 3).alias("power"), "n")


@query(f"""WITH {_SPECTRUM}, g AS (SELECT sigma::DOUBLE AS sigma, f, power, power * exp(-4 * pow(pi() * sigma * {SPACING} * f, 2)) AS passed FROM p, (SELECT unnest({SIGMAS}) AS sigma))
SELECT sigma, round(sum(passed) FILTER (f <= {1 / (2 * COARSE)}) / sum(power) FILTER (f <= {1 / (2 * COARSE)}), 6) AS kept, round(sum(passed) FILTER (f > {1 / (2 * COARSE)}) / sum(power) FILTER (f <= {1 / (2 * COARSE)}), 6) AS folded FROM g GROUP BY 1""")
def low_pass_choice(spark, sf_dir):
    """Before a coarser grid: what Gaussians of several widths keep of the power that it can carry, and what they let fold back."""
    s = spectra.low_pass_study(spectrum(spark, sf_dir), SPACING, COARSE, SIGMAS)
    return s.select("sigma", r6("kept").alias("kept"), r6("folded").alias("folded"))


REACH = (4, 3)
_LAGS = f"(SELECT unnest(range({-REACH[0]}, {REACH[0] + 1})) AS dl), (SELECT unnest(range({-REACH[1]}, {REACH[1] + 1})) AS ds)"
_LOOKS = "(SELECT vec_id AS line, s AS sample, embedding[4 * s + 1]::DOUBLE AS re, embedding[4 * s + 2]::DOUBLE AS im FROM embeddings, (SELECT unnest(range(0, 16)) AS s))"


def _lagged(source: str, lines: int, samples: int, value: str, mean: str) -> str:
    """SQL of products by lag, pixel against pixel, within whole windows."""
    return f"""x AS (SELECT line // {lines} AS a, sample // {samples} AS b, line % {lines} AS l, sample % {samples} AS s, {value} FROM {source}),
n AS (SELECT a, b FROM x GROUP BY 1, 2 HAVING count(*) = {lines * samples}),
z AS (SELECT a, b, l, s, re - avg(re) OVER (PARTITION BY a, b{mean}) AS re, im - avg(im) OVER (PARTITION BY a, b{mean}) AS im FROM x JOIN n USING (a, b)),
c AS (SELECT dl, ds, sum(q.re * p.re + q.im * p.im) AS re, sum(q.im * p.re - q.re * p.im) AS im, count(*) AS pairs FROM z p, {_LAGS} JOIN z q ON q.a = p.a AND q.b = p.b AND q.l = p.l + dl AND q.s = p.s + ds GROUP BY 1, 2)"""


_RASTER = _lagged(PX, SIZE, SIZE, "z AS re, 0.0 AS im", "")
_COMPLEX = _lagged(_LOOKS, 50, 16, "re, im", ", s")
_UNIT = "r AS (SELECT dl, ds, re / pairs / (SELECT re / pairs FROM c WHERE dl = 0 AND ds = 0) AS re, im / pairs / (SELECT re / pairs FROM c WHERE dl = 0 AND ds = 0) AS im FROM c)"
_PLAIN = "r AS (SELECT dl, ds, re / (SELECT re FROM c WHERE dl = 0 AND ds = 0) AS re FROM c)"


def complex_correlation_table(spark, sf_dir):
    looks = views.looks(spark, sf_dir).select("line", "sample", F.col("re_h").alias("re"), F.col("im_h").alias("im"))
    return staged(spectra.normalised(spectra.correlation(looks, 50, 16, ["re", "im"], REACH, "column")), "correlation")


@query(f"WITH {_COMPLEX}, {_UNIT} SELECT dl, ds, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM r")
def complex_correlation(spark, sf_dir):
    """Complex correlation of a channel over a square of lags, columns' means taken off, from whole windows of 50 lines."""
    return complex_correlation_table(spark, sf_dir).select("dl", "ds", r6("re").alias("re"), r6("im").alias("im"))


_HALF = "(SELECT d0 + (v0 - 0.5) / (v0 - v1) * (d1 - d0) FROM (SELECT d AS d1, v AS v1, lag(d) OVER (ORDER BY d) AS d0, lag(v) OVER (ORDER BY d) AS v0 FROM (SELECT {axis} AS d, sqrt(re * re + im * im) AS v FROM r WHERE {other} = 0 AND {axis} >= 0)) WHERE v1 <= 0.5 ORDER BY d1 LIMIT 1)"


@query(f"""WITH {_COMPLEX}, {_UNIT}, b AS (SELECT * FROM (VALUES (2, 2), (4, 1), (5, 4), (6, 1)) AS t(lines, samples)),
q AS (SELECT lines, samples, sum((re * re + im * im) * (lines - abs(dl)) * (samples - abs(ds))) AS q, count(*) AS n FROM r JOIN b ON abs(dl) < lines AND abs(ds) < samples GROUP BY 1, 2)
SELECT lines, samples, round(CASE WHEN n = (2 * lines - 1) * (2 * samples - 1) THEN pow(lines * samples, 2) / q END, 6) AS looks, round({_HALF.format(axis='dl', other='ds')}, 6) AS half_lines, round({_HALF.format(axis='ds', other='dl')}, 6) AS half_samples FROM q""")
def block_looks(spark, sf_dir):
    """Independent looks in blocks of several shapes by the measured correlation, beside its half-widths; a block beyond the measured lags has none."""
    r = complex_correlation_table(spark, sf_dir)
    half = [spectra.half_width(r, a).select(r6("half_width").alias(n)) for a, n in (("dl", "half_lines"), ("ds", "half_samples"))]
    looks = spectra.participation(r, [(2, 2), (4, 1), (5, 4), (6, 1)]).withColumn("looks", r6("looks"))
    return looks.join(F.broadcast(half[0])).join(F.broadcast(half[1]))  # a row each


@query(f"""WITH {_RASTER}, {_PLAIN}, whole AS (SELECT count(*) AS n FROM {PX}) SELECT round(sum(re), 6) AS area, round(sum(greatest(re, 0)), 6) AS positive, any_value(n) AS pixels, round(any_value(n) / sum(greatest(re, 0)))::BIGINT AS effective,
round(max(re) FILTER (dl = 1 AND ds = 0), 6) AS lag_line, round(max(re) FILTER (dl = 0 AND ds = 1), 6) AS lag_sample FROM r, whole""")
def effective_samples(spark, sf_dir):
    """How many pixels an independent sample takes, by the correlation over all lags and over positive ones, and how many there are."""
    px = views.pixels(spark, sf_dir)
    r = staged(spectra.normalised(spectra.correlation(px, SIZE, SIZE, ["z"], REACH), unbiased=False), "correlation")
    lag = lambda x: r6(F.max(F.when(F.expr(x), F.col("re"))))
    lags = r.agg(lag("dl = 1 and ds = 0").alias("lag_line"), lag("dl = 0 and ds = 1").alias("lag_sample"))
    n = px.agg(F.count("*").alias("pixels"))
    one = spectra.area(r).join(F.broadcast(n)).join(F.broadcast(lags))  # a row each
    return one.select(r6("area").alias("area"), r6("positive").alias("positive"), "pixels", F.round(F.col("pixels") / F.col("positive")).cast("long").alias("effective"), "lag_line", "lag_sample")


@query()
def correlogram_fit(spark, sf_dir):
    """Lengths of an exponential and a Gaussian law through a channel's correlation at lags of one and two lines; which fits better (a minimum: no SQL; tested on exact laws)."""
    r = complex_correlation_table(spark, sf_dir).where("ds = 0 and dl in (1, 2)").agg(*[F.max(F.when(F.col("dl") == k, F.expr("sqrt(re * re + im * im)"))).alias(f"r{k}") for k in (1, 2)]).first()
    laws = spectra.correlogram(r.r1, r.r2) if r.r1 is not None and r.r2 is not None else {}
    best = min(laws, key=lambda k: laws[k][1], default=None)
    return spark.createDataFrame([(k, *v, k == best) for k, v in laws.items()], "law string, length double, error double, chosen boolean")
