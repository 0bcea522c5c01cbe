"""Queries on frames: coordinates, footprints, lookups, discs, domains, terrain summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions import radar
from terrafold.operators import graph, order, stencil
from terrafold.plans.raster import GRADIENT, HAZARD, NEAR5, ROUGH, SPACING, at, r6, ratios, roughened
from terrafold.plans.registry import PX, RATIOS, query
from terrafold.sources import views

#: A frame: the place of its first corner and its pixel size, in metres; places are those of pixel centres.
EAST, NORTH, SIZE = -20_000.0, 15_000.0, 25.0
_R2 = 2 * radar.RADIUS


def _at(line: str, sample: str) -> tuple[str, str]:
    """SQL for x and y of a pixel's centre."""
    return f"({EAST}D + ({sample} + 0.5D) * {SIZE}D)", f"({NORTH}D - ({line} + 0.5D) * {SIZE}D)"


def _duck(sql: str) -> str:
    """The same expression without Spark's suffix of doubles."""
    return sql.replace("D ", " ").replace("D)", ")").replace("D,", ",")


_X, _Y = (_duck(e) for e in _at("line", "sample"))
_LAT = "(2 * degrees(atan(sqrt({x} * {x} + {y} * {y}) / " + str(_R2) + ")) - 90)"
_LON = "degrees(atan2({x}, {y}))"


@query(f"""WITH p AS (SELECT line, sample, {_X} AS x, {_Y} AS y FROM {PX}), g AS (SELECT *, {_LAT.format(x='x', y='y')} AS lat, {_LON.format(x='x', y='y')} AS lon FROM p)
SELECT line, sample, x, y, round(lat, 9) AS lat, round(lon, 9) + 0.0 AS lon, round(({NORTH} - y) / {SIZE} - 0.5, 6) + 0.0 AS back_line, round((x - {EAST}) / {SIZE} - 0.5, 6) + 0.0 AS back_sample FROM g""")
def frame_coordinates(spark, sf_dir):
    """Pixels to metres and degrees, and from degrees back to fractional pixels."""
    x, y = _at("line", "sample")
    p = views.pixels(spark, sf_dir).select("line", "sample", F.expr(x).alias("x"), F.expr(y).alias("y"))
    lat, lon = radar.geographic("x", "y")
    p = p.withColumn("lat", lat).withColumn("lon", lon)
    bx, by = radar.stereographic("lat", "lon")
    back = lambda e: F.round(e, 6) + F.lit(0.0)
    return p.select("line", "sample", "x", "y", F.round("lat", 9).alias("lat"), (F.round("lon", 9) + F.lit(0.0)).alias("lon"), back((F.lit(NORTH) - by) / SIZE - 0.5).alias("back_line"), back((bx - F.lit(EAST)) / SIZE - 0.5).alias("back_sample"))


_GL, _GS = "(gy / 100.0 * (nl - 1))", "(gx / 100.0 * (ns - 1))"
_GX, _GY = (_duck(e) for e in _at(_GL, _GS))


@query(f"""WITH n AS (SELECT max(line) + 1 AS nl, max(sample) + 1 AS ns FROM {PX}), g AS (SELECT 10 * a.v AS gx, 10 * b.v AS gy, nl, ns FROM range(11) a(v), range(11) b(v), n), m AS (SELECT *, {_GL} AS l, {_GS} AS s, {_GX} AS x, {_GY} AS y FROM g)
SELECT gx, gy, round(l, 6) AS line, round(s, 6) AS sample, round({_LAT.format(x='x', y='y')}, 9) AS lat, round({_LON.format(x='x', y='y')}, 9) + 0.0 AS lon FROM m""")
def display_grid(spark, sf_dir):
    """Places of a display grid of 0 to 100 as fractional pixels and degrees."""
    nl, ns = views.shape(views.pixels(spark, sf_dir))
    g = spark.range(121).select((F.col("id") % 11 * 10).alias("gx"), (F.floor(F.col("id") / 11) * 10).cast("long").alias("gy"))
    g = g.withColumn("line", F.col("gy") / 100 * (nl - 1)).withColumn("sample", F.col("gx") / 100 * (ns - 1))
    x, y = _at("line", "sample")
    g = g.withColumn("x", F.expr(x)).withColumn("y", F.expr(y))
    lat, lon = radar.geographic("x", "y")
    return g.select("gx", "gy", F.round("line", 6).alias("line"), F.round("sample", 6).alias("sample"), F.round(lat, 9).alias("lat"), (F.round(lon, 9) + F.lit(0.0)).alias("lon"))


_CX, _CY = (_duck(e) for e in _at("l", "s"))


@query(f"""WITH n AS (SELECT max(line) + 1 AS nl, max(sample) + 1 AS ns FROM {PX}), c AS (SELECT nl, ns, l, s, {_CX} AS x, {_CY} AS y FROM (SELECT nl, ns, a.v * (nl - 1) AS l, b.v * (ns - 1) AS s FROM n, range(2) a(v), range(2) b(v)))
SELECT any_value(nl) AS n_lines, any_value(ns) AS n_samples, any_value(nl) * {SIZE} / 40 AS y_per_line, any_value(ns) * {SIZE} / 50 AS x_per_sample, round(max(2 / (1 + cos(radians(90 + {_LAT.format(x='x', y='y')}))) - 1), 12) AS scale_error,
bool_or(0 >= x - {SIZE / 2} AND 0 <= x + {SIZE / 2}) OR (min(x) <= 0 AND max(x) >= 0 AND min(y) <= 0 AND max(y) >= 0) AS holds_pole, round(min({_LAT.format(x='x', y='y')}), 6) AS lat_min, round(max({_LAT.format(x='x', y='y')}), 6) AS lat_max FROM c""")
def frame_record(spark, sf_dir):
    """A frame's size, spacing at a display shape of 40 x 50, largest scale error over its corners, and whether it holds the pole."""
    nl, ns = views.shape(views.pixels(spark, sf_dir))
    c = spark.range(4).select(F.expr(f"id div 2 * {nl - 1}").alias("l"), F.expr(f"id % 2 * {ns - 1}").alias("s"))
    x, y = _at("l", "s")
    c = c.withColumn("x", F.expr(x)).withColumn("y", F.expr(y))
    c = c.withColumn("lat", radar.geographic("x", "y")[0])
    edge = F.bool_or(F.expr(f"0 >= x - {SIZE / 2}D and 0 <= x + {SIZE / 2}D"))
    return c.agg(
        F.lit(nl).cast("long").alias("n_lines"), F.lit(ns).cast("long").alias("n_samples"), F.lit(nl * SIZE / 40).alias("y_per_line"), F.lit(ns * SIZE / 50).alias("x_per_sample"), F.round(F.max(F.expr("2 / (1 + cos(radians(90 + lat))) - 1")), 12).alias("scale_error"),
        (edge | ((F.min("x") <= 0) & (F.max("x") >= 0) & (F.min("y") <= 0) & (F.max("y") >= 0))).alias("holds_pole"), r6(F.min("lat")).alias("lat_min"), r6(F.max("lat")).alias("lat_max"),
    )


def _gc(a: str, b: str) -> str:
    return f"2 * 1737400.0 * asin(least(1, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


_ENDS = {"a": ("r0", "cm"), "b": ("r1", "cm"), "c": ("rm", "c0"), "d": ("rm", "c1")}


@query(f"""WITH f AS (SELECT min(line) AS r0, max(line) AS r1, min(sample) AS c0, max(sample) AS c1 FROM {PX} WHERE measured AND z > 20), m AS (SELECT *, 0.5 * (r0 + r1) AS rm, 0.5 * (c0 + c1) AS cm FROM f), """
       + ", ".join(f"{k} AS (SELECT {_LAT.format(x='x', y='y')} AS lat, {_LON.format(x='x', y='y')} AS lon FROM (SELECT {_duck(_at(l, s)[0])} AS x, {_duck(_at(l, s)[1])} AS y FROM m))" for k, (l, s) in _ENDS.items())
       + f" SELECT r0 AS line_min, r1 AS line_max, c0 AS sample_min, c1 AS sample_max, round({_gc('a', 'b')}, 2) AS across_m, round({_gc('c', 'd')}, 2) AS along_m FROM m, a, b, c, d")
def mask_footprint(spark, sf_dir):
    """Bounds of the masked pixels, and the great-circle lengths through their middle."""
    f = views.pixels(spark, sf_dir).where("measured and z > 20").agg(F.min("line").alias("r0"), F.max("line").alias("r1"), F.min("sample").alias("c0"), F.max("sample").alias("c1"))
    f = f.withColumn("rm", F.expr("0.5D * (r0 + r1)")).withColumn("cm", F.expr("0.5D * (c0 + c1)"))
    for k, (l, s) in _ENDS.items():
        x, y = _at(l, s)
        f = f.withColumn("x", F.expr(x)).withColumn("y", F.expr(y))
        lat, lon = radar.geographic("x", "y")
        f = f.withColumn(f"lat_{k}", lat).withColumn(f"lon_{k}", lon)
    m = lambda a, b: F.round(radar.haversine(f"lat_{a}", f"lon_{a}", f"lat_{b}", f"lon_{b}"), 2)
    return f.select(F.col("r0").alias("line_min"), F.col("r1").alias("line_max"), F.col("c0").alias("sample_min"), F.col("c1").alias("sample_max"), m("a", "b").alias("across_m"), m("c", "d").alias("along_m"))


_POLAR = f"(2 * degrees(atan(sqrt(pow(sample - (ns - 1) / 2.0, 2) + pow(line - (nl - 1) / 2.0, 2)) * 2000.0 / {_R2})) - 90)"


@query(f"""WITH n AS (SELECT max(line) + 1 AS nl, max(sample) + 1 AS ns FROM {PX}), p AS (SELECT z < 5 AS dark, {_POLAR} AS lat FROM {PX}, n)
SELECT domain, cells * 4.0 AS domain_km2, dark * 4.0 AS dark_km2, round(100.0 * dark / nullif(cells, 0), 6) AS percent FROM (
SELECT 'all' AS domain, count(*) AS cells, count(*) FILTER (dark) AS dark FROM p UNION ALL SELECT 'circle', count(*), count(*) FILTER (dark) FROM p WHERE lat <= -88.5 UNION ALL SELECT 'band', count(*), count(*) FILTER (dark) FROM p WHERE lat <= -89.2)""")
def nested_domains(spark, sf_dir):
    """Area of a mask within overlapping domains of a polar grid, whose pole is in the middle: one pass of conditional counts."""
    px = views.pixels(spark, sf_dir)
    nl, ns = views.shape(px)
    lat = F.expr(f"2 * degrees(atan(sqrt(pow(sample - {(ns - 1) / 2}D, 2) + pow(line - {(nl - 1) / 2}D, 2)) * 2000D / {_R2}D)) - 90")
    p = px.select((F.col("z") < 5).alias("dark"), lat.alias("lat"))
    where = {"all": "true", "circle": "lat <= -88.5D", "band": "lat <= -89.2D"}
    one = p.agg(*[F.count_if(F.expr(w)).alias(f"n_{k}") for k, w in where.items()], *[F.count_if(F.expr(f"dark and {w}")).alias(f"d_{k}") for k, w in where.items()])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("domain"), F.col(f"n_{k}").alias("cells"), F.col(f"d_{k}").alias("dark")) for k in where])).alias("x")).select("x.*")
    return rows.select("domain", (F.col("cells") * 4.0).alias("domain_km2"), (F.col("dark") * 4.0).alias("dark_km2"), r6(F.try_divide(F.col("dark") * 100.0, F.col("cells"))).alias("percent"))


@query(f"""WITH px AS {PX}, t AS (SELECT line, sample, round_even(line * 1.25 - 2.0, 0)::BIGINT AS l, round_even(sample * 0.8 + 3.2, 0)::BIGINT AS s FROM px)
SELECT t.line, t.sample, coalesce(p.z < 20, false) AS dark, coalesce(p.z < 20, false) AND coalesce(p.measured, false) AS kept FROM t LEFT JOIN px p ON p.line = t.l AND p.sample = t.s""")
def nearest_mask(spark, sf_dir):
    """A mask on another frame by its nearest pixels, derived anew there; false off the frame."""
    px = views.pixels(spark, sf_dir)
    have = px.select(F.col("line").alias("l"), F.col("sample").alias("s"), (F.col("z") < 20).alias("d"), "measured")
    t = px.select("line", "sample", F.expr("bigint(rint(line * 1.25D - 2D))").alias("l"), F.expr("bigint(rint(sample * 0.8D + 3.2D))").alias("s"))
    no = F.lit(False)
    return t.join(have, ["l", "s"], "left").select("line", "sample", F.coalesce("d", no).alias("dark"), (F.coalesce("d", no) & F.coalesce("measured", no)).alias("kept"))


#: Places of customers on the raster: some lie beyond it.
_PLACES = "(SELECT c_custkey AS id, c_custkey % 131 * 0.9e0 - 4e0 AS y, c_custkey % 97 * 1.1e0 - 2.5e0 AS x FROM customer)"


def places(spark, sf_dir) -> DataFrame:
    return views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr("c_custkey % 131 * 0.9D - 4D").alias("y"), F.expr("c_custkey % 97 * 1.1D - 2.5D").alias("x"))


@query(f"SELECT id, floor(y)::BIGINT AS line, floor(x)::BIGINT AS sample, p.z, p.kind, p.line IS NOT NULL AS inside FROM {_PLACES} q LEFT JOIN {PX} p ON p.line = floor(y) AND p.sample = floor(x)")
def point_lookup(spark, sf_dir):
    """The pixel that holds each place; null off the raster."""
    q = places(spark, sf_dir).select("id", F.floor("y").alias("line"), F.floor("x").alias("sample"))
    px = views.pixels(spark, sf_dir).select("line", "sample", "z", "kind", F.lit(True).alias("_in"))
    return q.join(px, ["line", "sample"], "left").select("id", "line", "sample", "z", "kind", F.coalesce("_in", F.lit(False)).alias("inside"))


@query(f"""WITH px AS {PX}, q AS (SELECT id, round_even(y, 0)::BIGINT AS l, round_even(x, 0)::BIGINT AS s FROM {_PLACES})
SELECT id, round((r.z - w.z) / 60, 9) + 0.0 AS p, round((d.z - u.z) / 40, 9) + 0.0 AS q FROM q LEFT JOIN px w ON w.line = l AND w.sample = s - 1 AND w.measured LEFT JOIN px r ON r.line = l AND r.sample = s + 1 AND r.measured LEFT JOIN px u ON u.line = l - 1 AND u.sample = s AND u.measured LEFT JOIN px d ON d.line = l + 1 AND d.sample = s AND d.measured""")
def point_gradient(spark, sf_dir):
    """Central differences at the pixel nearest to each place; null where a neighbour is off the raster or not measured. Neighbours are sent to the places' keys: one join."""
    q = places(spark, sf_dir).select("id", F.expr("bigint(rint(y))").alias("l"), F.expr("bigint(rint(x))").alias("s"))
    near = F.explode(F.expr("array(struct('w' as k, l as line, s - 1 as sample), struct('r' as k, l as line, s + 1 as sample), struct('u' as k, l - 1 as line, s as sample), struct('d' as k, l + 1 as line, s as sample))"))
    j = q.select("id", near.alias("n")).select("id", "n.*").join(views.pixels(spark, sf_dir).where("measured").select("line", "sample", "z"), ["line", "sample"], "left")
    g = j.groupBy("id").agg(*[F.max(F.when(F.col("k") == k, F.col("z"))).alias(k) for k in "wrud"])
    n9 = lambda e: F.round(F.expr(e), 9) + F.lit(0.0)
    return g.select("id", n9("(r - w) / 60D").alias("p"), n9("(d - u) / 40D").alias("q"))


@query("SELECT round_even(c_acctbal / 400.0, 0)::BIGINT AS cell_line, c_nationkey AS cell_sample, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM customer GROUP BY 1, 2")
def scatter_bins(spark, sf_dir):
    """Irregular places averaged onto a grid."""
    c = views.table(spark, sf_dir, "customer")
    return c.groupBy(F.expr("bigint(rint(c_acctbal / 400D))").alias("cell_line"), F.col("c_nationkey").alias("cell_sample")).agg(F.count("*").alias("n"), r6(F.avg("c_acctbal")).alias("mean"))


_CRATERS = [("north", 3.0, 20.0, 4.0), ("east", 5.5, 80.0, 6.5), ("rim", 0.0, 0.0, 5.0), ("far", -50.0, 10.0, 4.0)]
_CRATER_SQL = "(VALUES " + ", ".join(f"('{n}', {y}, {x}, {r})" for n, y, x, r in _CRATERS) + ") c(name, y, x, r)"


@query(f"""WITH px AS {RATIOS}, j AS (SELECT c.name, p.* FROM {_CRATER_SQL} JOIN px p ON sqrt(pow(p.line - c.y, 2) + pow(p.sample - c.x, 2)) <= c.r)
SELECT name, count(*) AS cells, count(*) FILTER (measured) AS n_measured, count(*) FILTER (measured AND cpr > 0.3 AND dop < 0.6) AS n_hit, round(avg(cpr) FILTER (measured), 6) AS mean_cpr, round(avg((z < 20)::INT), 6) AS dark,
CASE WHEN avg((z < 20)::INT) = 0 THEN 'outside' WHEN avg((z < 20)::INT) = 1 THEN 'inside' ELSE 'mixed' END AS class, CASE WHEN count(*) FILTER (z < 20) = 0 THEN 'Low' WHEN count(*) FILTER (z < 20) * 0.25 > 5 THEN 'High' WHEN count(*) FILTER (z < 20) * 0.25 > 0.5 THEN 'Medium' ELSE 'Low' END AS confidence FROM j GROUP BY 1""")
def crater_discs(spark, sf_dir):
    """Summaries of the pixels within a radius of a few places, their shadow class, and how far their dark area's size is trusted."""
    c = spark.createDataFrame(_CRATERS, "name string, y double, x double, r double")
    p = ratios(views.pixels(spark, sf_dir))
    j = p.join(F.broadcast(c), F.expr("sqrt(pow(line - y, 2) + pow(sample - x, 2)) <= r"))
    dark, km2 = F.avg((F.col("z") < 20).cast("int")), F.count_if(F.col("z") < 20) * F.lit(0.25)
    return j.groupBy("name").agg(
        F.count("*").alias("cells"), F.count_if("measured").alias("n_measured"), F.count_if(F.expr("measured and cpr > 0.3 and dop < 0.6")).alias("n_hit"), r6(F.avg(F.when(F.col("measured"), F.col("cpr")))).alias("mean_cpr"), r6(dark).alias("dark"),
        F.when(dark == 0, "outside").when(dark == 1, "inside").otherwise("mixed").alias("class"), F.when(km2 > 5, "High").when(km2 > 0.5, "Medium").otherwise("Low").alias("confidence"),
    )


@query(f"""WITH c AS (SELECT sample, count(*) AS n, min(line) AS first, max(line) AS last FROM {PX} WHERE measured AND sample % 4 = 0 GROUP BY 1 HAVING count(*) >= 5)
SELECT sample, n, first, last, round(n / (last - first + 1.0), 6) AS density, row_number() OVER (ORDER BY sample) AS place FROM c""")
def footprint_ring(spark, sf_dir):
    """First and last masked line of every fourth column with enough of them: a ring, and how dense the mask is inside."""
    c = views.pixels(spark, sf_dir).where("measured and sample % 4 = 0").groupBy("sample").agg(F.count("*").alias("n"), F.min("line").alias("first"), F.max("line").alias("last")).where("n >= 5")
    c = order.numbered(c, "sample", "place")
    return c.select("sample", "n", "first", "last", r6(F.expr("n / (last - first + 1D)")).alias("density"), "place")


@query(f"""WITH c AS (SELECT sample, count(*) AS n FROM {PX} WHERE measured AND sample % 4 = 0 GROUP BY 1 HAVING count(*) >= 5)
SELECT count(*) AS columns_scored, round(quantile_cont(n, 0.1), 1) AS p10_px, round(quantile_cont(n, 0.5), 1) AS p50_px, round(quantile_cont(n, 0.9), 1) AS p90_px, round(avg(n) * 0.025, 3) AS mean_km FROM c""")
def ribbon(spark, sf_dir):
    """Extent of a mask along lines, over every fourth column."""
    c = views.pixels(spark, sf_dir).where("measured and sample % 4 = 0").groupBy("sample").agg(F.count("*").alias("n")).where("n >= 5")
    q = lambda x: F.round(F.percentile("n", F.lit(x)), 1)  # noqa: E731  a quarter of the width's rows
    return c.agg(F.count("*").alias("columns_scored"), q(0.1).alias("p10_px"), q(0.5).alias("p50_px"), q(0.9).alias("p90_px"), F.round(F.avg("n") * 0.025, 3).alias("mean_km"))


@query(f"""WITH a AS (SELECT line, sample, z FROM {PX}), b AS (SELECT line, sample, lh * lh AS z FROM {PX} WHERE line > 0)
SELECT count(*) FILTER (a.z IS NOT NULL AND b.z IS NOT NULL) AS both, count(*) FILTER (b.z IS NULL) AS only_a, count(*) FILTER (a.z IS NULL) AS only_b, max(abs(a.z - b.z)) < 1e-9 AS identical FROM a FULL JOIN b USING (line, sample)""")
def grid_identity(spark, sf_dir):
    """Whether two rasters hold the same values on the same grid: a full join by pixel."""
    px = views.pixels(spark, sf_dir)
    a, b = px.select("line", "sample", F.col("z").alias("a")), px.where("line > 0").select("line", "sample", (F.col("lh") * F.col("lh")).alias("b"))
    j = a.join(b, ["line", "sample"], "full")
    return j.agg(F.count_if(F.expr("a is not null and b is not null")).alias("both"), F.count_if(F.expr("b is null")).alias("only_a"), F.count_if(F.expr("a is null")).alias("only_b"), (F.max(F.abs(F.col("a") - F.col("b"))) < 1e-9).alias("identical"))


_HYPOTHESES = {"and": "lh > 5 and lv > 6", "or": "lh > 5 or lv > 6", "power": "lh * lh + lv * lv > 60", "height": "z > 30"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS hypothesis, count(*) FILTER ({e}) AS n, count(*) FILTER (({e}) AND measured) AS agree, count(*) FILTER (({e}) <> measured) AS differ, round(count(*) FILTER (({e}) = measured) / count(*), 6) AS fraction FROM {PX}" for k, e in _HYPOTHESES.items()))
def mask_hypotheses(spark, sf_dir):
    """How well each way to derive a mask agrees with the given one, in one pass."""
    px = views.pixels(spark, sf_dir)
    n = lambda e: F.count_if(F.expr(e))
    one = px.agg(F.count("*").alias("all"), *[x for k, e in _HYPOTHESES.items() for x in (n(e).alias(f"n_{k}"), n(f"({e}) and measured").alias(f"a_{k}"), n(f"({e}) <> measured").alias(f"d_{k}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("hypothesis"), F.col(f"n_{k}").alias("n"), F.col(f"a_{k}").alias("agree"), F.col(f"d_{k}").alias("differ")) for k in _HYPOTHESES]))
    return one.select("all", rows.alias("x")).select("x.*", r6((F.col("all") - F.col("x.differ")) / F.col("all")).alias("fraction"))


@query(f"""WITH g AS (SELECT line // 8 AS a, sample // 8 AS b, count(*) AS n, var_pop(z) AS v, covar_pop(z, sample) AS cx, covar_pop(z, line) AS cy, var_pop(sample) AS vx, var_pop(line) AS vy FROM {PX} GROUP BY 1, 2)
SELECT a AS box_line, b AS box_sample, round(sqrt(greatest(0, v - cx * cx / vx - cy * cy / vy)), 6) AS rms FROM g WHERE n = 64""")
def plane_rms(spark, sf_dir):
    """RMS about the plane fitted to each full box of 8 x 8 pixels; over a full box the axes are orthogonal."""
    p = views.pixels(spark, sf_dir)
    g = p.groupBy(F.expr("line div 8").alias("box_line"), F.expr("sample div 8").alias("box_sample")).agg(F.count("*").alias("n"), F.var_pop("z").alias("v"), F.covar_pop("z", "sample").alias("cx"), F.covar_pop("z", "line").alias("cy"), F.var_pop("sample").alias("vx"), F.var_pop("line").alias("vy"))
    return g.where("n = 64").select("box_line", "box_sample", r6(F.expr("sqrt(greatest(0D, v - cx * cx / vx - cy * cy / vy))")).alias("rms"))


@query(f"""WITH px AS {PX}, m AS (SELECT line // 5 AS a, sample // 5 AS b, max(z) AS highest FROM px GROUP BY 1, 2) SELECT t.line, t.sample, highest FROM (SELECT DISTINCT line // 3 AS line, sample // 3 AS sample FROM px) t JOIN m ON a = (t.line * 3 + 1) // 5 AND b = (t.sample * 3 + 1) // 5""")
def block_max_nearest(spark, sf_dir):
    """The maximum over blocks of 5 x 5, sampled at the nearest block of a coarser grid's pixels."""
    px = views.pixels(spark, sf_dir)
    m = px.groupBy(F.expr("line div 5").alias("a"), F.expr("sample div 5").alias("b")).agg(F.max("z").alias("highest"))
    t = px.select(F.expr("line div 3").alias("line"), F.expr("sample div 3").alias("sample")).distinct().withColumn("a", F.expr("(line * 3 + 1) div 5")).withColumn("b", F.expr("(sample * 3 + 1) div 5"))
    return t.join(m, ["a", "b"]).select("line", "sample", "highest")


#: Fixed rule of a Gaussian kernel: sigma in pixels, radius of four sigmas.
_SIGMA = 0.625
_KERNEL = {d: 2.718281828459045 ** (-d * d / (2 * _SIGMA**2)) for d in range(-3, 4)}
_KERNEL = {d: w / sum(_KERNEL.values()) for d, w in _KERNEL.items()}
_KSQL = "(VALUES " + ", ".join(f"({d}, {w!r}::DOUBLE)" for d, w in _KERNEL.items()) + ")"


@query(f"""WITH px AS {PX}, n AS (SELECT max(line) + 1 AS nl, max(sample) + 1 AS ns FROM px), w AS (SELECT p.line, p.sample, greatest(0, least(nl - 1, p.line + a.d)) AS ql, greatest(0, least(ns - 1, p.sample + b.d)) AS qs, a.w * b.w AS k FROM px p, n, {_KSQL} a(d, w), {_KSQL} b(d, w))
SELECT w.line, w.sample, CASE WHEN sum(k) FILTER (q.measured) > 1e-6 THEN round(sum(k * q.z) FILTER (q.measured) / sum(k) FILTER (q.measured), 6) END AS smooth FROM w JOIN px q ON q.line = ql AND q.sample = qs GROUP BY 1, 2""")
def gaussian_low_pass(spark, sf_dir):
    """Gaussian mean of the measured pixels: values and their validity go through the same kernel, and one is divided by the other."""
    px = views.pixels(spark, sf_dir)
    ok = F.col("measured")
    s = stencil.weighted(px, views.shape(px), _KERNEL, {"num": F.when(ok, F.col("z")).otherwise(0.0), "den": F.when(ok, 1.0).otherwise(0.0)}, "nearest")
    return s.select("line", "sample", F.when(F.col("den") > 1e-6, r6(F.col("num") / F.col("den"))).alias("smooth"))


@query(f"""WITH RECURSIVE px AS {RATIOS}, th AS (SELECT quantile_cont(cpr, 0.9) AS t FROM px WHERE measured), m AS (SELECT line, sample, cpr, z FROM px, th WHERE measured AND cpr >= t), o AS (SELECT a.v AS dl, b.v AS ds FROM range(-1, 2) a(v), range(-1, 2) b(v)),
r AS (SELECT line, sample, line * 1000000 + sample AS root FROM m UNION SELECT m.line, m.sample, r.root FROM r, o JOIN m ON m.line = r.line + dl AND m.sample = r.sample + ds WHERE r.root < m.line * 1000000 + m.sample),
c AS (SELECT line, sample, min(root) AS root FROM r GROUP BY 1, 2)
SELECT root // 1000000 AS root_line, root % 1000000 AS root_sample, count(*) AS size, round(max(cpr), 6) AS highest, round(avg(cpr), 6) AS mean, round(avg(line), 6) AS centre_line, round(avg(sample), 6) AS centre_sample, CASE WHEN avg(z) > 32 OR avg(z) < 6 THEN 'interior' ELSE 'slope' END AS terrain
FROM c JOIN m USING (line, sample) GROUP BY 1, 2 HAVING count(*) >= 2""")
def cluster_table(spark, sf_dir):
    """Connected clusters of two or more of the highest tenth of the measured pixels: peak, mean, centre and class."""
    px = ratios(views.pixels(spark, sf_dir))
    t = order.quantiles(px.where("measured"), "cpr", [0.9]).select(F.col("value").alias("_t"))
    m = graph.kept(px.join(F.broadcast(t)).where("measured and cpr >= _t").select("line", "sample", "cpr", "z", F.lit(True).alias("hit")), "hits")
    c = graph.components(m, "hit").join(m, ["line", "sample"])
    g = c.groupBy("label").agg(F.count("*").alias("size"), r6(F.max("cpr")).alias("highest"), r6(F.avg("cpr")).alias("mean"), r6(F.avg("line")).alias("centre_line"), r6(F.avg("sample")).alias("centre_sample"), F.avg("z").alias("z")).where("size >= 2")
    return g.select(F.col("label.line").alias("root_line"), F.col("label.sample").alias("root_sample"), "size", "highest", "mean", "centre_line", "centre_sample", F.when((F.col("z") > 32) | (F.col("z") < 6), "interior").otherwise("slope").alias("terrain"))


@query(f"""WITH {GRADIENT}, {ROUGH}, h AS (SELECT s.*, roughness, {HAZARD} AS hazard FROM slo s JOIN rough USING (line, sample))
SELECT round(avg(slope), 6) AS mean_slope, round(max(slope), 6) AS max_slope, round(avg((slope <= 12)::INT), 6) AS gentle, count(*) FILTER (hazard >= 0.7) * 600.0 / 1e6 AS hazard_km2, round(avg(roughness), 6) AS mean_roughness,
round(avg((slope > 15)::INT), 6) AS over_15, round(avg((slope > 25)::INT), 6) AS over_25, round(quantile_cont(slope, 0.5), 6) AS p50, round(quantile_cont(slope, 0.95), 6) AS p95 FROM h""")
def terrain_summary(spark, sf_dir):
    """Slopes, shares under and over limits, hazardous area and percentiles of the whole raster."""
    px = views.pixels(spark, sf_dir)
    shape = views.shape(px)
    s = roughened(stencil.slope_aspect(px, shape, SPACING), shape).withColumn("hazard", stencil.hazard({"slope": ("slope", 30.0, 0.5), "roughness": ("roughness", 80.0, 0.5)}))
    s = graph.kept(s.select("slope", "roughness", "hazard"), "terrain")
    share = lambda e: r6(F.avg(F.expr(e).cast("int")))
    one = s.agg(r6(F.avg("slope")).alias("mean_slope"), r6(F.max("slope")).alias("max_slope"), share("slope <= 12").alias("gentle"), (F.count_if(F.expr("hazard >= 0.7D")) * F.lit(600.0) / F.lit(1e6)).alias("hazard_km2"), r6(F.avg("roughness")).alias("mean_roughness"), share("slope > 15").alias("over_15"), share("slope > 25").alias("over_25"))
    return one.join(F.broadcast(order.wide(order.quantiles(s, "slope", [0.5, 0.95]), {"p50": 0.5, "p95": 0.95})))


@query(f"""WITH px AS {PX}, best AS (SELECT line, sample, z FROM px WHERE sample % 25 = 7), j AS (SELECT b.line, b.sample, b.z, q.z AS near FROM best b JOIN px q ON q.line BETWEEN b.line - 2 AND b.line + 2 AND q.sample BETWEEN b.sample - 2 AND b.sample + 2)
SELECT line, sample, round(100.0 * avg((near < z)::INT), 6) AS local_rank, round(median(near), 6) AS box_median FROM j GROUP BY 1, 2""")
def local_rank(spark, sf_dir):
    """Percentile rank of some pixels within the 5 x 5 box around them."""
    px = views.pixels(spark, sf_dir)
    sites = px.where("sample % 25 = 7").select(F.col("line").alias("l"), F.col("sample").alias("s"), F.col("z").alias("own"))
    near = sites.withColumn("line", F.explode(F.sequence(F.col("l") - 2, F.col("l") + 2))).withColumn("sample", F.explode(F.sequence(F.col("s") - 2, F.col("s") + 2)))
    j = near.join(px.select("line", "sample", "z"), ["line", "sample"])
    return j.groupBy(F.col("l").alias("line"), F.col("s").alias("sample")).agg(r6(F.avg((F.col("z") < F.col("own")).cast("int")) * 100).alias("local_rank"), r6(F.median("z")).alias("box_median"))  # 25 values a group


@query(f"SELECT line // 4 AS block, min(z) AS lowest, max(z) AS highest, count(z) AS n, min(z) >= 0 AND max(z) <= 1000 AS in_range FROM {PX} GROUP BY 1")
def blocked_range(spark, sf_dir):
    """Range and count of each block of lines, and whether it lies within the label's range."""
    return views.pixels(spark, sf_dir).groupBy(F.expr("line div 4").alias("block")).agg(F.min("z").alias("lowest"), F.max("z").alias("highest"), F.count("z").alias("n"), ((F.min("z") >= 0) & (F.max("z") <= 1000)).alias("in_range"))


@query(f"SELECT kind, max(z - lv) AS farthest, arg_max(line * 1000 + sample, (z - lv) * 1e6 - line * 1e-3 - sample * 1e-6) // 1000 AS line, arg_max(line * 1000 + sample, (z - lv) * 1e6 - line * 1e-3 - sample * 1e-6) % 1000 AS sample FROM {PX} WHERE measured GROUP BY 1".replace("max(z - lv) AS", "round(max(z - lv), 6) AS"))
def extreme_place(spark, sf_dir):
    """Where each kind's masked difference of two layers is largest; the first of equals."""
    best = F.max_by(F.struct("line", "sample"), F.expr("(z - lv) * 1e6D - line * 1e-3D - sample * 1e-6D"))
    g = views.pixels(spark, sf_dir).where("measured").groupBy("kind").agg(r6(F.max(F.col("z") - F.col("lv"))).alias("farthest"), best.alias("b"))
    return g.select("kind", "farthest", "b.line", "b.sample")


@query(f"""WITH d AS (SELECT abs(z - lag(z) OVER (PARTITION BY line ORDER BY sample)) AS step FROM {PX}) SELECT count(step) AS n, round(quantile_cont(step, 0.5), 6) AS p50, round(quantile_cont(step, 0.95), 6) AS p95, round(max(step), 6) AS highest, round(quantile_cont(step, 0.5) / 0.05, 6) AS ratio FROM d""")
def step_differences(spark, sf_dir):
    """Steps between neighbours along lines, against a smooth ramp of 0.05."""
    px = views.pixels(spark, sf_dir)
    s = stencil.neighbours(px, views.shape(px), "z", {"before": ("sample", -1)}).select(F.abs(F.col("z") - F.col("before")).alias("step")).where("step is not null")
    s = graph.kept(s, "steps")
    q = order.wide(order.quantiles(s, "step", [0.5, 0.95]), {"p50": 0.5, "p95": 0.95})
    return s.agg(F.count("*").alias("n"), r6(F.max("step")).alias("highest")).join(F.broadcast(q)).select("n", "p50", "p95", "highest", r6(F.col("p50") / 0.05).alias("ratio"))
