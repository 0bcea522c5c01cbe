"""Queries of horizons and shadows: skylines along lines and columns, lit shares, doubly shadowed pixels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.operators.skyline import grid, horizons, skylines, turned
from terrafold.plans.raster import r6
from terrafold.plans.registry import PX, query
from terrafold.shared import staged
from terrafold.sources import views

#: Ground spacing along samples and along lines, in metres; the sun's elevation in degrees.
DX, DY, SUN = 30.0, 20.0, 5.0


def known(px: DataFrame) -> DataFrame:
    return px.select("line", "sample", F.when(F.col("measured"), F.col("z")).alias("z"), (F.col("z") < 20).alias("dark"))


def _ranked(name: str, key: str, along: str, step: float, sign: str) -> str:
    """SQL of the definition: of all pixels beyond, the steepest, then the nearest."""
    return f"""{name} AS (SELECT a.line, a.sample, (b.z - a.z) / (abs(b.{along} - a.{along}) * {step}) AS slope, b.{along} AS crest FROM m a JOIN m b ON a.{key} = b.{key} AND b.{along} {sign} a.{along}
QUALIFY row_number() OVER (PARTITION BY a.line, a.sample ORDER BY (b.z - a.z) / (abs(b.{along} - a.{along}) * {step}) DESC, abs(b.{along} - a.{along})) = 1)"""


_M = f"px AS {PX}, m AS (SELECT line, sample, z FROM px WHERE measured)"
_EAST, _WEST = _ranked("east", "line", "sample", DX, ">"), _ranked("west", "line", "sample", DX, "<")
_SOUTH, _NORTH = _ranked("south", "sample", "line", DY, ">"), _ranked("north", "sample", "line", DY, "<")


@query(f"""WITH {_M}, {_EAST}, {_WEST} SELECT px.line, px.sample, round(degrees(atan(e.slope)), 6) + 0.0 AS east, e.crest AS east_crest, round(degrees(atan(w.slope)), 6) + 0.0 AS west, w.crest AS west_crest
FROM px LEFT JOIN east e USING (line, sample) LEFT JOIN west w USING (line, sample)""")
def skyline_both_ways(spark, sf_dir):
    """Horizon angles and the crests that make them, both ways along each line, in one linear scan a line. Pixels that aren't measured hide nothing."""
    s = skylines(known(views.pixels(spark, sf_dir)), views.shape(views.pixels(spark, sf_dir)), "sample", (DX, DY))
    angle = lambda c: r6(F.degrees(F.atan(c)))
    return s.select("line", "sample", angle("ahead").alias("east"), F.col("ahead_crest").alias("east_crest"), angle("behind").alias("west"), F.col("behind_crest").alias("west_crest"))


_TAN = f"tan(radians({SUN}))"
_ALL = " UNION ALL ".join(f"SELECT px.line, px.sample, '{k}' AS az, slope FROM px LEFT JOIN {k} USING (line, sample)" for k in ("east", "west", "south", "north"))


def swept(spark, sf_dir) -> DataFrame:
    """line, sample and a row for each of four azimuths: slope of the horizon and the crest's place."""
    px = views.pixels(spark, sf_dir)
    s = horizons(known(px), views.shape(px), [0.0, 90.0], (DX, DY))
    way = lambda n: f"struct({n} as slope, {n}_line as crest_line, {n}_sample as crest_sample)"
    return staged(s.select("line", "sample", F.explode(F.expr(f"array({way('ahead')}, {way('behind')})")).alias("x")).select("line", "sample", "x.*"), "swept")


@query(f"""WITH {_M}, {_EAST}, {_WEST}, {_SOUTH}, {_NORTH}, a AS ({_ALL}) SELECT line, sample, round(avg((coalesce(slope, -1e9) < {_TAN})::INT), 6) AS lit, round(degrees(atan(max(slope))), 6) + 0.0 AS highest, round(degrees(atan(min(slope))), 6) + 0.0 AS lowest,
round(avg(1 / (1 + pow(greatest(0, coalesce(slope, 0)), 2))), 6) AS sky_view, bool_and(coalesce(slope, -1e9) >= {_TAN}) AS shadowed FROM a GROUP BY 1, 2""")
def azimuth_sweep(spark, sf_dir):
    """Over four azimuths: the share from which a low sun reaches the pixel, the highest and lowest horizon, the sky's share; shadowed where it is never lit."""
    a = swept(spark, sf_dir)
    lit = F.coalesce("slope", F.lit(-1e9)) < F.tan(F.radians(F.lit(SUN)))
    angle = lambda c: r6(F.degrees(F.atan(c)))
    return a.groupBy("line", "sample").agg(r6(F.avg(lit.cast("int"))).alias("lit"), angle(F.max("slope")).alias("highest"), angle(F.min("slope")).alias("lowest"), r6(F.avg(F.expr("1 / (1 + pow(greatest(0D, coalesce(slope, 0D)), 2))"))).alias("sky_view"), F.bool_and(~lit).alias("shadowed"))


_CRESTS = " UNION ALL ".join(f"SELECT line, sample, {c} FROM {k}" for k, c in (("east", "line AS crest_line, crest AS crest_sample"), ("west", "line, crest"), ("south", "crest, sample"), ("north", "crest, sample")))


@query(f"""WITH {_M}, {_EAST}, {_WEST}, {_SOUTH}, {_NORTH}, c AS ({_CRESTS}), d AS (SELECT c.line, c.sample, count(*) AS crests, count(*) FILTER (p.z < 20) AS dark_crests FROM c JOIN px p ON p.line = c.crest_line AND p.sample = c.crest_sample GROUP BY 1, 2)
SELECT px.line, px.sample, coalesce(crests, 0) AS crests, coalesce(dark_crests, 0) AS dark_crests, z < 20 AND coalesce(crests = dark_crests, false) AS doubly_shadowed FROM px LEFT JOIN d USING (line, sample)""")
def doubly_shadowed(spark, sf_dir):
    """Dark pixels whose horizon is dark as well, in every direction: crests are joined back to the mask."""
    a = swept(spark, sf_dir).where("slope is not null")
    mask = known(views.pixels(spark, sf_dir)).select("line", "sample", "dark")
    crest = mask.select(F.col("line").alias("crest_line"), F.col("sample").alias("crest_sample"), F.col("dark").alias("crest_dark"))
    d = a.join(crest, ["crest_line", "crest_sample"]).groupBy("line", "sample").agg(F.count("*").alias("crests"), F.count_if("crest_dark").alias("dark_crests"))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return mask.join(d, ["line", "sample"], "left").select("line", "sample", n("crests"), n("dark_crests"), (F.col("dark") & F.coalesce(F.col("crests") == F.col("dark_crests"), F.lit(False))).alias("doubly_shadowed"))


#: A sweep of every 15 degrees: hour angle 0 lies along samples. The subsolar latitude's band and the sun's radius, in degrees.
ROTATIONS, BAND, DISC = 12, (-1.54, 1.54), 0.2666
_GRIDS = [grid(180 * k / ROTATIONS, DX, DY) for k in range(ROTATIONS)]
_PLACES = " UNION ALL ".join(f"SELECT {k} AS rot, {p} AS prof, {a} AS at, line, sample, z, measured FROM px" for k, (p, a, _) in enumerate(_GRIDS))
_STEPS = "[" + ", ".join(repr(g[2]) for g in _GRIDS) + "]"
_COS = [turned(180 * k / ROTATIONS)[0] for k in range(ROTATIONS)]
_LAT = "(-80.0 - line % 90 / 10.0)"


def lit_share(slope: str, lat: str, cos_hour: str, radius: float) -> str:
    """SQL for the share of the subsolar band from which the sun's disc reaches over a horizon: its elevation is taken as linear over the band, and a pixel without a horizon is lit wherever the sun stands.

    Of a disc of that radius some part shows once the centre is above the horizon less the radius.
    """
    r = repr(math.radians(radius))
    over = f"if({slope} is null, -cos({r}), ({slope} * cos({r}) - sin({r})) / sqrt(1 + {slope} * {slope}))"
    low, high = (f"(sin(radians({lat})) * {math.sin(math.radians(d))!r} + cos(radians({lat})) * {math.cos(math.radians(d))!r} * {cos_hour})" for d in BAND)
    at = f"(({over} - {low}) / nullif({high} - {low}, 0))"
    return f"if(abs({high} - {low}) < 1e-12, if({low} > {over}, 1, 0), greatest(0, least(1, if({high} > {low}, 1 - {at}, {at}))))"


@query(f"""WITH px AS {PX}, p AS ({_PLACES}), a AS (SELECT p.rot, p.line, p.sample, max(CASE WHEN c.at > p.at THEN (c.z - p.z) / ((c.at - p.at) * {_STEPS}[p.rot + 1]) END) AS ahead, max(CASE WHEN c.at < p.at THEN (c.z - p.z) / ((p.at - c.at) * {_STEPS}[p.rot + 1]) END) AS behind
FROM p LEFT JOIN p c ON c.rot = p.rot AND c.prof = p.prof AND c.measured AND p.measured GROUP BY 1, 2, 3),
b AS (SELECT line, sample, ahead AS slope, [{', '.join(map(repr, _COS))}][rot + 1] AS h FROM a UNION ALL SELECT line, sample, behind, -[{', '.join(map(repr, _COS))}][rot + 1] FROM a)
SELECT line, sample, round(avg({lit_share('slope', _LAT, 'h', 0.0)}), 6) AS point_sun, round(avg({lit_share('slope', _LAT, 'h', DISC)}), 6) AS disc_sun, round(max(slope), 6) AS highest, round(min(slope), 6) AS lowest, round(avg(1 / (1 + pow(greatest(0, coalesce(slope, 0)), 2))), 6) AS sky_view FROM b GROUP BY 1, 2""")
def sun_sweep(spark, sf_dir):
    """Over 24 azimuths: the share of sun positions that reach a pixel, for a point and for the sun's disc, in closed form over the subsolar band; highest and lowest horizon, the sky's share."""
    px = views.pixels(spark, sf_dir)
    s = horizons(known(px), views.shape(px), [180 * k / ROTATIONS for k in range(ROTATIONS)], (DX, DY))
    cos = F.element_at(F.array(*map(F.lit, _COS)), F.col("rot") + 1)
    s = s.select("line", "sample", cos.alias("c"), "ahead", "behind").select("line", "sample", F.explode(F.expr("array(struct(ahead as slope, c as h), struct(behind as slope, -c as h))")).alias("x")).select("line", "sample", "x.*")
    share = lambda radius: r6(F.avg(F.expr(lit_share("slope", "(-80D - line % 90 / 10D)", "h", radius))))
    return s.groupBy("line", "sample").agg(share(0.0).alias("point_sun"), share(DISC).alias("disc_sun"), r6(F.max("slope")).alias("highest"), r6(F.min("slope")).alias("lowest"), r6(F.avg(F.expr("1 / (1 + pow(greatest(0D, coalesce(slope, 0D)), 2))"))).alias("sky_view"))
