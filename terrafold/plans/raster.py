"""Queries on rasters: stencils, radiometry, classes, resampling, search, graphs."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions import laws, radar
from terrafold.operators import graph, order, stencil
from terrafold.operators.skyline import skylines
from terrafold.plans.registry import PX, RATIOS, query
from terrafold.shared import staged
from terrafold.sources import views

SPACING = (20.0, 30.0)
NEAR5 = "(SELECT a.v AS dl, b.v AS ds FROM range(-2, 3) a(v), range(-2, 3) b(v))"


def r6(c) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def at(*names: str) -> list[Column]:
    return [F.col("line"), F.col("sample"), *[r6(n).alias(n) for n in names]]


GRADIENT = f"""
px AS {PX}, g AS (
  SELECT p.*, (coalesce(d.z, p.z) - coalesce(u.z, p.z)) / (CASE WHEN d.z IS NULL OR u.z IS NULL THEN 20.0 ELSE 40.0 END) AS gy,
         (coalesce(r.z, p.z) - coalesce(l.z, p.z)) / (CASE WHEN r.z IS NULL OR l.z IS NULL THEN 30.0 ELSE 60.0 END) AS gx
  FROM px p LEFT JOIN px u ON u.line = p.line - 1 AND u.sample = p.sample LEFT JOIN px d ON d.line = p.line + 1 AND d.sample = p.sample
  LEFT JOIN px l ON l.line = p.line AND l.sample = p.sample - 1 LEFT JOIN px r ON r.line = p.line AND r.sample = p.sample + 1),
slo AS (SELECT *, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope FROM g)"""
ROUGH = f"""
n AS (SELECT max(line) + 1 AS nl, max(sample) + 1 AS ns FROM px),
near AS (
  SELECT p.line, p.sample, CASE WHEN p.line + dl < 0 THEN -1 - p.line - dl WHEN p.line + dl >= nl THEN 2 * nl - 1 - p.line - dl ELSE p.line + dl END AS ql,
         CASE WHEN p.sample + ds < 0 THEN -1 - p.sample - ds WHEN p.sample + ds >= ns THEN 2 * ns - 1 - p.sample - ds ELSE p.sample + ds END AS qs
  FROM px p, n, {NEAR5} o),
rough AS (
  SELECT p.line, p.sample, sqrt(greatest(0, avg(q.z * q.z) - avg(q.z) * avg(q.z))) AS roughness
  FROM near p JOIN px q ON q.line = ql AND q.sample = qs
  GROUP BY p.line, p.sample)"""


def roughened(px: DataFrame, shape) -> DataFrame:
    b = stencil.box(px, shape, 5, {"s": F.col("z"), "q": F.col("z") ** 2}, "reflect")
    return b.withColumn("roughness", F.expr("sqrt(greatest(0, q / n - pow(s / n, 2)))")).drop("s", "q", "n")


HAZARD = "0.5 * least(1, slope / 30) + 0.5 * least(1, roughness / 80)"


@query(f"WITH {GRADIENT} SELECT line, sample, round(slope, 6) AS slope, round(gy, 6) + 0.0 AS gy, round(gx, 6) + 0.0 AS gx FROM slo")
def slope(spark, sf_dir):
    px = views.pixels(spark, sf_dir)
    return stencil.slope_aspect(px, views.shape(px), SPACING).select(*at("slope", "gy", "gx"))


@query(f"WITH {GRADIENT}, {ROUGH} SELECT line, sample, round(roughness, 6) AS roughness FROM rough")
def roughness(spark, sf_dir):
    px = views.pixels(spark, sf_dir)
    return roughened(px, views.shape(px)).select(*at("roughness"))


@query(f"""WITH {GRADIENT}, {ROUGH}, h AS (SELECT s.*, roughness, {HAZARD} AS hazard FROM slo s JOIN rough USING (line, sample)),
f AS (SELECT *, (slope <= 50 AND roughness <= 80 AND measured AND hazard < 0.8) AS feasible FROM h)
SELECT line, sample, round(0.6 * (1 - hazard) + 0.4 * least(1, lv / 13), 6) AS score, round(hazard, 6) AS hazard, round(slope, 6) AS slope
FROM f WHERE feasible ORDER BY round(0.6 * (1 - hazard) + 0.4 * least(1, lv / 13), 6) DESC, line, sample LIMIT 5""")
def site_search(spark, sf_dir):
    """Slope, roughness, hazard, feasibility, score, and the five best pixels."""
    px = views.pixels(spark, sf_dir)
    shape = views.shape(px)
    s = roughened(stencil.slope_aspect(px, shape, SPACING), shape)
    s = s.withColumn("hazard", stencil.hazard({"slope": ("slope", 30.0, 0.5), "roughness": ("roughness", 80.0, 0.5)}))
    s = s.where("slope <= 50 and roughness <= 80 and measured and hazard < 0.8").withColumn("score", F.expr("0.6 * (1 - hazard) + 0.4 * least(1, lv / 13)"))
    return s.select(*at("score", "hazard", "slope")).orderBy(F.desc("score"), "line", "sample").limit(5)


@query(f"""WITH {GRADIENT}, {ROUGH}, h AS (SELECT s.slope <= 40 AS c1, roughness <= 60 AS c2, measured AS c3, z < 200 AS c4, lv > 2 AS c5, {HAZARD} < 0.7 AS c6 FROM slo s JOIN rough USING (line, sample)),
u AS (UNPIVOT (SELECT avg(c1::INT) AS slope, avg(c2::INT) AS roughness, avg(c3::INT) AS measured, avg(c4::INT) AS height, avg(c5::INT) AS power, avg(c6::INT) AS hazard, avg((c1 AND c2 AND c3 AND c4 AND c5 AND c6)::INT) AS every FROM h) ON COLUMNS(*) INTO NAME criterion VALUE fraction)
SELECT criterion, round(fraction, 6) AS fraction, fraction > 0.99 OR fraction < 0.01 AS vacuous FROM u""")
def feasibility(spark, sf_dir):
    """Pass fraction of each of six criteria and of all, and whether one is vacuous."""
    px = views.pixels(spark, sf_dir)
    shape = views.shape(px)
    s = roughened(stencil.slope_aspect(px, shape, SPACING), shape).withColumn("h", stencil.hazard({"slope": ("slope", 30.0, 0.5), "roughness": ("roughness", 80.0, 0.5)}))
    c = {"slope": "slope <= 40", "roughness": "roughness <= 60", "measured": "measured", "height": "z < 200", "power": "lv > 2", "hazard": "h < 0.7"}
    c["every"] = " and ".join(f"({x})" for x in c.values())
    one = s.agg(*[F.avg(F.expr(x).cast("int")).alias(f"_{k}") for k, x in c.items()])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("criterion"), F.col(f"_{k}").alias("fraction")) for k in c])).alias("x")).select("x.*")
    return long.select("criterion", r6("fraction").alias("fraction"), ((F.col("fraction") > 0.99) | (F.col("fraction") < 0.01)).alias("vacuous"))


def _shade(az, alt):
    return f"(sin(radians({alt})) - cos(radians({alt})) * (gx * sin(radians({az})) - gy * cos(radians({az})))) / sqrt(1 + gx * gx + gy * gy)"


@query(f"WITH {GRADIENT} SELECT line, sample, round(greatest(0, least(1, {_shade(315, 45)})), 6) + 0.0 AS single, round(({' + '.join(f'({_shade(a, 30)} + 1) / 2' for a in (0, 90, 180, 270))}) / 4, 6) AS multi FROM g")
def hillshade(spark, sf_dir):
    """The clipped relief of one light, and the mean of the rescaled reliefs of four."""
    px = views.pixels(spark, sf_dir)
    g = stencil.gradient(px, views.shape(px), SPACING)
    multi = sum(((radar_relief + 1) / 2 for radar_relief in (stencil.relief(a, 30) for a in (0, 90, 180, 270))), F.lit(0.0)) / 4
    return g.withColumn("single", F.greatest(F.lit(0.0), F.least(F.lit(1.0), stencil.relief(315, 45)))).withColumn("multi", multi).select(*at("single", "multi"))


def _border(v: str, n: str, rule: str) -> str:
    return {
        "reflect": f"CASE WHEN {v} < 0 THEN -1 - ({v}) WHEN {v} >= {n} THEN 2 * {n} - 1 - ({v}) ELSE {v} END",
        "mirror": f"CASE WHEN {v} < 0 THEN -({v}) WHEN {v} >= {n} THEN 2 * {n} - 2 - ({v}) ELSE {v} END",
        "nearest": f"greatest(0, least({n} - 1, {v}))",
    }[rule]


_BOX = ", ".join(f"{rule} AS (SELECT p.line, p.sample, avg(q.z) AS v FROM (SELECT p.line, p.sample, {_border('p.line + dl', 'nl', rule)} AS ql, {_border('p.sample + ds', 'ns', rule)} AS qs FROM px p, n, {NEAR5} o) p JOIN px q ON q.line = ql AND q.sample = qs GROUP BY ALL)" for rule in ("reflect", "mirror", "nearest"))


@query(f"""WITH px AS {PX}, n AS (SELECT max(line) + 1 AS nl, max(sample) + 1 AS ns FROM px), {_BOX},
valid AS (SELECT p.line, p.sample, avg(q.z) AS v, sum(q.z) / 25 AS zeros, count(*) AS cells FROM px p, {NEAR5} o JOIN px q ON q.line = p.line + dl AND q.sample = p.sample + ds GROUP BY ALL)
SELECT line, sample, round(a.v, 6) AS reflect, round(b.v, 6) AS mirror, round(c.v, 6) AS nearest, round(d.v, 6) AS valid, round(zeros, 6) AS zeros, cells
FROM reflect a JOIN mirror b USING (line, sample) JOIN nearest c USING (line, sample) JOIN valid d USING (line, sample)""")
def box_means(spark, sf_dir):
    """5 x 5 box means under each rule for what lies beyond the border."""
    px = views.pixels(spark, sf_dir).select("line", "sample", "z")
    shape, out = views.shape(px), None
    for rule in ("reflect", "mirror", "nearest", "valid"):
        b = stencil.box(px, shape, 5, {"s": F.col("z")}, rule).select("line", "sample", r6(F.col("s") / F.col("n")).alias(rule), *([r6(F.col("s") / 25).alias("zeros"), F.col("n").alias("cells")] if rule == "valid" else []))
        out = b if out is None else out.join(b, ["line", "sample"])
    return out


@query(f"""WITH px AS {RATIOS}, w AS (SELECT p.line, p.sample, count(*) AS n, var_samp(ln(q.lh / q.lv)) AS v FROM px p, {NEAR5} o JOIN px q ON q.line = p.line + dl AND q.sample = p.sample + ds WHERE q.measured GROUP BY ALL)
SELECT line, sample, n, round(v, 6) AS variance FROM w WHERE n > 12""")
def local_variance(spark, sf_dir):
    """Windowed variance of the log ratio of two channels over measured pixels, where the window has enough of them."""
    px = views.pixels(spark, sf_dir)
    x = F.when(F.col("measured"), F.log(F.col("lh") / F.col("lv")))
    b = stencil.box(px, views.shape(px), 5, {"s": x, "q": x * x}).where("n > 12")
    return b.select("line", "sample", "n", r6(F.expr("(q - s * s / n) / (n - 1)")).alias("variance"))


@query(f"""WITH px AS {RATIOS}, w AS (SELECT p.line, p.sample, count(*) AS n, round(var_samp(ln(q.lh / q.lv)), 6) AS v FROM px p, {NEAR5} o JOIN px q ON q.line = p.line + dl AND q.sample = p.sample + ds WHERE q.measured GROUP BY ALL)
SELECT line, sample, round({laws.halved_sql('v', '2 * ' + laws.trigamma_sql('{x}'))}, 4) AS looks FROM w WHERE n > 12""")
def local_looks(spark, sf_dir):
    """Number of looks of each window's variance, by the inverse trigamma function."""
    return local_variance(spark, sf_dir).select("line", "sample", F.round(radar.looks_of("variance"), 4).alias("looks"))


@query(f"""WITH px AS {PX}, w AS (
  SELECT p.line, p.sample, count(*) AS n, sum(q.z) AS s, sum(q.z * q.z) AS q, sum(q.z * ds) AS sx, sum(q.z * dl) AS sy
  FROM px p, {NEAR5} o JOIN px q ON q.line = p.line + dl AND q.sample = p.sample + ds GROUP BY ALL HAVING count(*) = 25)
SELECT line, sample, round(sqrt(greatest(0, (q - s * s / 25 - sx * sx / 50 - sy * sy / 50) / 25)), 6) AS rms FROM w""")
def detrended_rms(spark, sf_dir):
    """RMS about the plane fitted to each full 5 x 5 window, from moments."""
    px = views.pixels(spark, sf_dir)
    z = F.col("z")
    b = stencil.box(px, views.shape(px), 5, {"s": z, "q": z * z, "xs": z * F.col("sample"), "ys": z * F.col("line")}).where("n = 25")
    sx, sy = F.col("xs") - F.col("s") * F.col("sample"), F.col("ys") - F.col("s") * F.col("line")
    return b.select("line", "sample", r6(F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("s") ** 2 / 25 - sx**2 / 50 - sy**2 / 50) / 25))).alias("rms"))


@query(f"""WITH px AS {PX} SELECT p.line, p.sample, coalesce(floor(p.z / 25) <> floor(r.z / 25), false) OR coalesce(floor(p.z / 25) <> floor(d.z / 25), false) AS contour
FROM px p LEFT JOIN px r ON r.line = p.line AND r.sample = p.sample + 1 LEFT JOIN px d ON d.line = p.line + 1 AND d.sample = p.sample""")
def contours(spark, sf_dir):
    px = views.pixels(spark, sf_dir)
    t = stencil.neighbours(px, views.shape(px), "z", {"r": ("sample", 1), "d": ("line", 1)})
    level = lambda c: F.floor(F.col(c) / 25)
    return t.select("line", "sample", (F.coalesce(level("z") != level("r"), F.lit(False)) | F.coalesce(level("z") != level("d"), F.lit(False))).alias("contour"))


@query(f"""WITH px AS {PX} SELECT p.line, p.sample, max(q.z) AS highest, min(q.z) AS lowest, count(*) FILTER (q.measured) = 25 AS kept, round(p.z - avg(q.z), 6) + 0.0 AS high_pass
FROM px p, {NEAR5} o JOIN px q ON q.line = p.line + dl AND q.sample = p.sample + ds GROUP BY p.line, p.sample, p.z""")
def morphology(spark, sf_dir):
    """Dilation, erosion, eroded mask and high-pass over 5 x 5 boxes."""
    px = views.pixels(spark, sf_dir)
    shape = views.shape(px)
    up = stencil.extremes(px, shape, 5, "z", "max").select("line", "sample", F.col("max").alias("highest"))
    low = stencil.extremes(px, shape, 5, "z", "min").select("line", "sample", F.col("min").alias("lowest"))
    b = stencil.box(px, shape, 5, {"s": F.col("z"), "m": F.col("measured").cast("long")})
    b = b.select("line", "sample", (F.col("m") == 25).alias("kept"), r6(F.col("z") - F.col("s") / F.col("n")).alias("high_pass"))
    return up.join(low, ["line", "sample"]).join(b, ["line", "sample"])


@query(f"""WITH px AS {PX} SELECT line // 8 AS block_line, sample // 8 AS block_sample, round(avg(z), 9) AS mean, max(z) AS highest, bool_or(measured) AS some, round(avg(z) FILTER (measured), 9) AS measured_mean, count(*) FILTER (measured) AS n
FROM px, (SELECT max(line) + 1 AS nl, max(sample) + 1 AS ns FROM px) WHERE line < nl - nl % 8 AND sample < ns - ns % 8 GROUP BY 1, 2""")
def block_reduce(spark, sf_dir):
    """Mean, maximum, any and masked mean over 8 x 8 blocks; ragged edges are dropped."""
    px = views.pixels(spark, sf_dir)
    nl, ns = views.shape(px)
    p = px.where((F.col("line") < nl - nl % 8) & (F.col("sample") < ns - ns % 8))
    return p.groupBy(F.expr("line div 8").alias("block_line"), F.expr("sample div 8").alias("block_sample")).agg(
        F.round(F.avg("z"), 9).alias("mean"), F.max("z").alias("highest"), F.bool_or("measured").alias("some"), F.round(F.avg(F.when(F.col("measured"), F.col("z"))), 9).alias("measured_mean"), F.count_if("measured").alias("n")
    )


@query(f"""WITH px AS {RATIOS}, t AS (SELECT line, sample FROM px WHERE measured AND cpr > 0.4)
SELECT p.line, p.sample, round(sqrt(min(pow(p.line - t.line, 2) + pow(p.sample - t.sample, 2))), 6) AS distance FROM px p, t GROUP BY ALL""")
def distance_transform(spark, sf_dir):
    px = ratios(views.pixels(spark, sf_dir))
    return stencil.distance(px.withColumn("hit", F.col("measured") & (F.col("cpr") > 0.4)), views.shape(px), "hit").select(*at("distance"))


def ratios(px: DataFrame) -> DataFrame:
    cpr, dop = radar.amplitude_ratios()
    return px.withColumn("cpr", cpr).withColumn("dop", dop)


@query(f"SELECT line, sample, round(cpr, 6) AS cpr, round(dop, 6) AS dop, CASE WHEN cpr > 0.3 AND dop < 0.6 THEN 'both' WHEN cpr > 0.3 THEN 'cpr' WHEN dop < 0.6 THEN 'dop' ELSE 'none' END AS class, CASE WHEN NOT measured THEN NULL ELSE cpr > 0.3 END AS evidence FROM {RATIOS}")
def polarimetric_class(spark, sf_dir):
    px = ratios(views.pixels(spark, sf_dir))
    kind = F.when((F.col("cpr") > 0.3) & (F.col("dop") < 0.6), "both").when(F.col("cpr") > 0.3, "cpr").when(F.col("dop") < 0.6, "dop").otherwise("none")
    return px.select(*at("cpr", "dop"), kind.alias("class"), F.when(F.col("measured"), F.col("cpr") > 0.3).alias("evidence"))


@query(f"""SELECT count(*) FILTER (measured) AS n_measured, count(*) FILTER (hit) AS n_hit, count(*) FILTER (hit) / nullif(count(*) FILTER (measured), 0) AS fraction, count(*) FILTER (hit) * 600.0 / 1e6 AS area_km2,
round(max(cpr) FILTER (measured), 6) AS peak, round(median(cpr) FILTER (measured), 6) AS median, CASE WHEN count(*) FILTER (hit) = 0 THEN 'none' WHEN count(*) FILTER (hit) < 100 THEN 'low' ELSE 'high' END AS confidence,
round(max(cpr) FILTER (measured AND dop < 0.6), 6) AS ceiling FROM (SELECT *, measured AND cpr > 0.3 AND dop < 0.6 AS hit FROM {RATIOS})""")
def dual_threshold_screen(spark, sf_dir):
    px = ratios(views.pixels(spark, sf_dir)).withColumn("hit", F.expr("measured and cpr > 0.3 and dop < 0.6"))
    px = graph.kept(px.select("measured", "hit", "cpr", "dop"), "screen")
    seen = F.when(F.col("measured"), F.col("cpr"))
    median = order.wide(order.quantiles(px.where("measured"), "cpr", [0.5]), {"median": 0.5})
    n, hits = F.count_if("measured"), F.count_if("hit")
    return px.agg(
        n.alias("n_measured"), hits.alias("n_hit"), F.try_divide(hits, n).alias("fraction"), (hits * F.lit(600.0) / F.lit(1e6)).alias("area_km2"), r6(F.max(seen)).alias("peak"),
        F.when(hits == 0, "none").when(hits < 100, "low").otherwise("high").alias("confidence"), r6(F.max(F.expr("if(measured and dop < 0.6, cpr, null)"))).alias("ceiling"),
    ).join(F.broadcast(median))


@query(f"""WITH px AS {RATIOS}, m AS (SELECT measured AS a, cpr > 0.2 AS b, z < 400 AS seen FROM px)
SELECT CASE WHEN NOT seen THEN 'never observed' WHEN a THEN 'measured' ELSE 'no return' END AS coverage, count(*) AS n, count(*) FILTER (a AND b) AS n_and, count(*) FILTER (a OR b) AS n_or, count(*) FILTER (a AND NOT b) AS n_only, count(*) FILTER (a AND b) / nullif(count(*) FILTER (a OR b), 0) AS iou FROM m GROUP BY 1""")
def coverage(spark, sf_dir):
    """Coverage classes, with the overlap of two masks in each."""
    m = ratios(views.pixels(spark, sf_dir)).select(F.col("measured").alias("a"), (F.col("cpr") > 0.2).alias("b"), (F.col("z") < 400).alias("seen"))
    kind = F.when(~F.col("seen"), "never observed").when(F.col("a"), "measured").otherwise("no return")
    return m.groupBy(kind.alias("coverage")).agg(F.count("*").alias("n"), F.count_if(F.expr("a and b")).alias("n_and"), F.count_if(F.expr("a or b")).alias("n_or"), F.count_if(F.expr("a and not b")).alias("n_only"), F.try_divide(F.count_if(F.expr("a and b")), F.count_if(F.expr("a or b"))).alias("iou"))


@query(f"""WITH RECURSIVE m AS (SELECT line, sample FROM {RATIOS} WHERE measured AND cpr > 0.25), o AS (SELECT a.v AS dl, b.v AS ds FROM range(-1, 2) a(v), range(-1, 2) b(v)),
r AS (SELECT line, sample, line * 1000000 + sample AS root FROM m UNION SELECT m.line, m.sample, r.root FROM r, o JOIN m ON m.line = r.line + dl AND m.sample = r.sample + ds WHERE r.root < m.line * 1000000 + m.sample),
c AS (SELECT line, sample, min(root) AS root FROM r GROUP BY 1, 2)
SELECT line, sample, root // 1000000 AS root_line, root % 1000000 AS root_sample, count(*) OVER (PARTITION BY root) AS size FROM c""")
def connected_components(spark, sf_dir):
    c = graph.components(ratios(views.pixels(spark, sf_dir)), "measured and cpr > 0.25", sized=True)
    return c.select("line", "sample", F.col("label.line").alias("root_line"), F.col("label.sample").alias("root_sample"), "size")


@query()
def shortest_paths(spark, sf_dir):
    """Least cost from the first passable block over an undirected grid of blocks of 20 lines and 10 samples (relaxation: no SQL; tested against a heap)."""
    px = views.pixels(spark, sf_dir).groupBy(F.expr("line div 20").alias("line"), F.expr("sample div 10").alias("sample")).agg(F.least(F.lit(1.0), F.avg("z") / 100).alias("h"))
    px = graph.kept(px, "blocks")
    number, place, part = graph.numbered(views.shape(px))
    e = graph.grid_edges(px, "h < 0.65", carry=["h"])
    start = px.where("h < 0.65").agg(F.min(F.struct("line", "sample")).alias("v")).select(number("v").alias("v"))
    got = graph.cheapest(e.select(number("src").alias("src"), number("dst").alias("dst"), (F.col("step") * (1 + (F.col("src_h") + F.col("dst_h")) / 2)).alias("cost")), start, part)
    return got.select(place("v").alias("v"), "cost").select("v.line", "v.sample", r6("cost").alias("cost"))


_NMS = ["WITH px AS (SELECT line, sample, z AS score FROM " + PX + " WHERE measured)"]
for _k in range(4):
    _far = "".join(f" AND greatest(abs(line - (SELECT line FROM s{j})), abs(sample - (SELECT sample FROM s{j}))) > 7" for j in range(_k))
    _NMS.append(f"s{_k} AS (SELECT {_k + 1} AS rank, line, sample, score FROM px WHERE true{_far} ORDER BY score DESC, line, sample LIMIT 1)")


@query(", ".join(_NMS) + " " + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(4)))
def top_sites(spark, sf_dir):
    """The best four pixels, each more than 7 lines or samples from better ones: a row of the answer for each scan."""
    left, found = views.pixels(spark, sf_dir).where("measured").select("line", "sample", F.col("z").alias("score")), []
    for k in range(4):  # the number of sites is the feature's limit; one row a round reaches the driver
        best = left.orderBy(F.desc("score"), "line", "sample").limit(1).collect()
        if not best:
            break
        line, sample, score = best[0]
        found.append((k + 1, line, sample, score))
        left = left.where(F.greatest(F.abs(F.col("line") - line), F.abs(F.col("sample") - sample)) > 7)
    return spark.createDataFrame(found, "rank int, line long, sample long, score double")


@query(f"""WITH px AS {PX}, t AS (SELECT line, sample, line + 0.25 AS y, sample + 0.5 AS x FROM px), k AS (SELECT t.*, floor(y)::BIGINT + a.v AS cl, floor(x)::BIGINT + b.v AS cs, (1 - abs(y - floor(y) - a.v)) * (1 - abs(x - floor(x) - b.v)) AS w FROM t, range(2) a(v), range(2) b(v))
SELECT k.line, k.sample, CASE WHEN sum(w) > 0.999 THEN round(sum(w * p.z) / sum(w), 6) END AS z FROM k LEFT JOIN px p ON p.line = cl AND p.sample = cs AND p.measured GROUP BY ALL HAVING true""".replace("sum(w) > 0.999", "sum(w) FILTER (p.z IS NOT NULL) > 0.999").replace("/ sum(w)", "/ sum(w) FILTER (p.z IS NOT NULL)"))
def bilinear_resample(spark, sf_dir):
    """Values a quarter of a line and half a sample further, from four corners; null unless all of the weight is measured."""
    px = views.pixels(spark, sf_dir)
    corners = F.explode(F.expr("transform(array(0, 1, 2, 3), i -> struct(line + i div 2 as cl, sample + i % 2 as cs, if(i div 2 = 0, 0.75D, 0.25D) * 0.5D as w))"))
    k = px.select("line", "sample", corners.alias("c")).select("line", "sample", "c.*")
    have = px.where("measured").select(F.col("line").alias("cl"), F.col("sample").alias("cs"), "z")
    j = k.join(have, ["cl", "cs"], "left").withColumn("w", F.when(F.col("z").isNotNull(), F.col("w")))
    return j.groupBy("line", "sample").agg(F.when(F.sum("w") > 0.999, r6(F.sum(F.col("w") * F.col("z")) / F.sum("w"))).alias("z"))


@query(f"""WITH px AS {PX}, h AS (SELECT a.line, a.sample, max((b.z - a.z) / ((b.sample - a.sample) * 30.0)) AS t FROM px a JOIN px b ON a.line = b.line AND b.sample > a.sample GROUP BY 1, 2)
SELECT line, sample, round(degrees(atan(t)), 6) + 0.0 AS horizon, t < tan(radians(5)) AS lit FROM h""")
def horizon(spark, sf_dir):
    """Angle of the horizon along increasing samples, and whether a light of 5 degrees reaches the pixel: a linear scan a line. The last pixel of a line has none."""
    px = views.pixels(spark, sf_dir)
    t = skylines(px, views.shape(px), "sample", (30.0, 20.0), ways=(True, False)).where("ahead is not null")
    return t.select("line", "sample", r6(F.degrees(F.atan("ahead"))).alias("horizon"), (F.col("ahead") < F.tan(F.radians(F.lit(5)))).alias("lit"))


@query(f"""WITH p AS (SELECT line, sample, -80.0 - line % 90 / 10.0 AS lat, sample * 3.6 - 180 AS lon FROM {PX}), r AS (SELECT *, 2 * 1737400.0 * tan(pi() / 4 + radians(lat) / 2) AS rho FROM p)
SELECT line, sample, round(rho * sin(radians(lon)), 4) + 0.0 AS x, round(rho * cos(radians(lon)), 4) + 0.0 AS y, round(lat, 6) AS lat, round(lon, 6) AS lon,
round(2 * 1737400.0 * asin(least(1, sqrt(pow(sin(radians(-85.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(-85.0)) * pow(sin(radians(10.0 - lon) / 2), 2)))), 4) AS metres FROM r""")
def projection(spark, sf_dir):
    """Stereographic metres, the way back, and the great-circle distance to a place."""
    p = views.pixels(spark, sf_dir).select("line", "sample", F.expr("-80.0D - line % 90 / 10.0D").alias("la"), F.expr("sample * 3.6D - 180").alias("lo"))
    x, y = radar.stereographic("la", "lo")
    p = p.withColumn("x", x).withColumn("y", y)
    lat, lon = radar.geographic("x", "y")
    return p.select("line", "sample", (F.round("x", 4) + F.lit(0.0)).alias("x"), (F.round("y", 4) + F.lit(0.0)).alias("y"), F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"), F.round(radar.haversine("la", "lo", "-85.0D", "10.0D"), 4).alias("metres"))


@query("""WITH e AS (SELECT vec_id AS line, unnest(range(0, 16)) AS sample, embedding FROM embeddings), l AS (SELECT line, sample, embedding[4 * sample + 1]::DOUBLE AS a, embedding[4 * sample + 2]::DOUBLE AS b, embedding[4 * sample + 3]::DOUBLE AS c, embedding[4 * sample + 4]::DOUBLE AS d FROM e),
g AS (SELECT line // 4 AS cell, sample, avg(a * a + b * b) AS hh, avg(c * c + d * d) AS vv, avg(a * c + b * d) AS re, avg(b * c - a * d) AS im FROM l GROUP BY 1, 2)
SELECT cell, sample, round(hh, 9) AS hh, round(vv, 9) AS vv, round(re, 9) + 0.0 AS re, round(im, 9) + 0.0 AS im, round(sqrt(re * re + im * im) / sqrt(hh * vv), 6) AS coherence,
round(sqrt(pow(hh - vv, 2) + 4 * (re * re + im * im)) / (hh + vv), 6) AS dop, round(ln(greatest(hh + vv - 2 * im, 1e-12) / greatest(hh + vv + 2 * im, 1e-12)), 6) + 0.0 AS log_ratio FROM g""")
def coherency(spark, sf_dir):
    """Coherency of two complex channels over four lines, with coherence, degree of polarisation and log circular ratio."""
    g = views.looks(spark, sf_dir).groupBy(F.expr("line div 4").alias("cell"), "sample").agg(
        *[F.avg(F.expr(x)).alias(n) for n, x in {"hh": "re_h * re_h + im_h * im_h", "vv": "re_v * re_v + im_v * im_v", "re": "re_h * re_v + im_h * im_v", "im": "im_h * re_v - re_h * im_v"}.items()]
    )
    n9 = lambda c: (F.round(c, 9) + F.lit(0.0)).alias(c)
    return g.select(
        "cell", "sample", n9("hh"), n9("vv"), n9("re"), n9("im"), r6(F.expr("sqrt(re * re + im * im) / sqrt(hh * vv)")).alias("coherence"),
        r6(F.expr("sqrt(pow(hh - vv, 2) + 4 * (re * re + im * im)) / (hh + vv)")).alias("dop"), r6(F.expr("ln(greatest(hh + vv - 2 * im, 1e-12) / greatest(hh + vv + 2 * im, 1e-12))")).alias("log_ratio"),
    )


@query(f"SELECT line, sample, round(lh * lh * sin(radians(20 + sample / 10.0)) / (pow(10, 3.0) * 4), 9) AS sigma0, round(greatest(0, least(10, greatest(s0 - s3, 0) / greatest(s0 + s3, 1e-12))), 6) AS cpr, round(least(1, sqrt(s1 * s1 + s3 * s3) / s0), 6) AS dop FROM (SELECT *, lh * lh + lv * lv AS s0, lh * lh - lv * lv AS s1, lh * lv AS s3 FROM {PX})")
def radiometry(spark, sf_dir):
    px = views.pixels(spark, sf_dir).withColumns({"s0": F.expr("lh * lh + lv * lv"), "s1": F.expr("lh * lh - lv * lv"), "s3": F.expr("lh * lv")})
    return px.select("line", "sample", F.round(radar.sigma0("lh", "(20 + sample / 10.0D)", 30.0, 2.0), 9).alias("sigma0"), r6(radar.stokes_cpr("s0", "s3")).alias("cpr"), r6(radar.stokes_dop("s0", "s1", "0", "s3")).alias("dop"))


@query(f"""WITH px AS {PX}, sh AS (SELECT a.v AS dl, b.v AS ds FROM range(-2, 3) a(v), range(-2, 3) b(v)), c AS (SELECT dl, ds, count(*) AS n, corr(p.lh, q.lv) AS r FROM sh, px p JOIN px q ON q.line = p.line + dl AND q.sample = p.sample + ds GROUP BY 1, 2)
SELECT dl, ds, n, round(r, 6) + 0.0 AS r FROM c""")
def registration(spark, sf_dir):
    """Correlation of one channel with the other, shifted by up to two lines and samples."""
    px = views.pixels(spark, sf_dir)
    return shifted_correlation(px, views.shape(px), 2).select("dl", "ds", "n", r6("r").alias("r"))


def shifted_correlation(px: DataFrame, shape: tuple[int, int], reach: int) -> DataFrame:
    s = stencil.shifted_sums(px, shape, "lh", "lv", reach)
    return s.withColumn("r", F.expr("(ab / n - a / n * (b / n)) / nullif(sqrt(aa / n - pow(a / n, 2)) * sqrt(bb / n - pow(b / n, 2)), 0)"))


@query(f"""WITH px AS {PX}, sh AS (SELECT a.v AS dl, b.v AS ds FROM range(-12, 13) a(v), range(-12, 13) b(v)), m AS MATERIALIZED (SELECT dl, ds, line + dl AS line, sample + ds AS sample, lh FROM sh, px), q AS MATERIALIZED (SELECT line, sample, lv FROM px),
c AS (SELECT dl, ds, count(*) AS n, corr(lh, lv) AS r FROM m JOIN q USING (line, sample) GROUP BY 1, 2)
SELECT dl, ds, n, round(r, 6) + 0.0 AS r, row_number() OVER (ORDER BY round(r, 6) DESC, abs(dl) + abs(ds), dl, ds) = 1 AS best FROM c""")
def wide_registration(spark, sf_dir):
    """Correlation under all 625 shifts of up to twelve lines and samples, summed in tiles with halos, and the best of them."""
    px = views.pixels(spark, sf_dir)
    c = staged(shifted_correlation(px, views.shape(px), 12).select("dl", "ds", "n", r6("r").alias("r")), "shifts")
    best = c.orderBy(F.desc_nulls_last("r"), F.expr("abs(dl) + abs(ds)"), "dl", "ds").limit(1).select(F.col("dl").alias("_l"), F.col("ds").alias("_s"))
    return c.join(F.broadcast(best)).withColumn("best", F.expr("dl = _l and ds = _s")).drop("_l", "_s")  # one row


_STOPS = 5


@query(f"WITH s AS (SELECT row_number() OVER (ORDER BY z DESC, line, sample) - 1 AS i, line AS l, sample AS s FROM {PX} ORDER BY i LIMIT {_STOPS}), d AS (SELECT a.i AS f, b.i AS t, sqrt(pow(20.0 * (a.l - b.l), 2) + pow(30.0 * (a.s - b.s), 2)) AS m FROM s a, s b), p AS ("
       + " UNION ALL ".join(f"SELECT '{'-'.join(map(str, (0, *o)))}' AS tour, {' + '.join(f'(SELECT m FROM d WHERE f = {x} AND t = {y})' for x, y in zip((0, *o), o))} AS metres" for o in permutations(range(1, 5)))
       + ") SELECT tour, round(metres, 6) AS metres FROM p")
def tours(spark, sf_dir):
    """Length of each order of the five highest pixels, from the highest."""
    stops = [(r.line, r["sample"]) for r in views.pixels(spark, sf_dir).orderBy(F.desc("z"), "line", "sample").select("line", "sample").limit(_STOPS).collect()]
    d = {(i, j): ((20.0 * (a - c)) ** 2 + (30.0 * (b - e)) ** 2) ** 0.5 for i, (a, b) in enumerate(stops) for j, (c, e) in enumerate(stops)}
    legs = spark.createDataFrame([(f"{i}-{j}", m) for (i, j), m in d.items()], "leg string, m double")
    order = spark.createDataFrame([("-".join(map(str, (0, *o))),) for o in permutations(range(1, 5))], "tour string")
    leg = order.withColumn("x", F.split("tour", "-")).select("tour", F.explode(F.expr("transform(sequence(0, 3), k -> concat(x[k], '-', x[k + 1]))")).alias("leg"))
    return leg.join(F.broadcast(legs), "leg").groupBy("tour").agg(r6(F.sum("m")).alias("metres"))


@query(f"""WITH px AS {PX}, p AS (SELECT line, sample, line - lag(line, 1, line) OVER w AS dl, 1 AS ds, z, z - lag(z, 1, z) OVER w AS climb FROM px WINDOW w AS (PARTITION BY line ORDER BY sample)),
e AS (SELECT *, CASE WHEN sample = 0 THEN 0.0 ELSE 30.0 END AS step FROM p)
SELECT line, sample, sum(step) OVER w AS metres, round(sum(greatest(0, climb)) OVER w, 6) AS climbed, round(sum(step * (0.5 + 0.02 * greatest(0, least(30, degrees(atan(climb / 30.0)))))) OVER w, 6) AS energy FROM e WINDOW w AS (PARTITION BY line ORDER BY sample ROWS UNBOUNDED PRECEDING)""")
def path_profile(spark, sf_dir):
    """Distance, climb and energy so far along each line."""
    w = Window.partitionBy("line").orderBy("sample")
    p = views.pixels(spark, sf_dir).withColumn("climb", F.col("z") - F.lag("z").over(w)).na.fill(0.0, ["climb"]).withColumn("step", F.when(F.col("sample") == 0, 0.0).otherwise(30.0))
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    energy = F.expr("step * (0.5 + 0.02 * greatest(0, least(30, degrees(atan(climb / 30.0)))))")
    return p.select("line", "sample", F.sum("step").over(up).alias("metres"), r6(F.sum(F.greatest(F.lit(0.0), F.col("climb"))).over(up)).alias("climbed"), r6(F.sum(energy).over(up)).alias("energy"))


@query(f"""WITH px AS {PX}, d AS (SELECT line, sample, round(line / 10.0)::BIGINT AS dl, round(sample / 10.0)::BIGINT AS ds FROM px), k AS (SELECT *, row_number() OVER (PARTITION BY dl, ds ORDER BY pow(line - 10 * dl, 2) + pow(sample - 10 * ds, 2), line, sample) AS n, count(*) OVER (PARTITION BY dl, ds) AS have FROM d)
SELECT dl AS disc_line, ds AS disc_sample, n, line, sample FROM k WHERE n <= 20 AND have >= 20""")
def lattice_discs(spark, sf_dir):
    """Each pixel's disc on a square lattice; the nearest 20 pixels of discs that have as many."""
    d = views.pixels(spark, sf_dir).select("line", "sample", F.round(F.col("line") / 10).cast("long").alias("disc_line"), F.round(F.col("sample") / 10).cast("long").alias("disc_sample"))
    disc = Window.partitionBy("disc_line", "disc_sample")
    near = F.expr("pow(line - 10 * disc_line, 2) + pow(sample - 10 * disc_sample, 2)")
    k = d.withColumn("n", F.row_number().over(disc.orderBy(near, "line", "sample")).cast("long")).withColumn("have", F.count("*").over(disc))
    return k.where("n <= 20 and have >= 20").select("disc_line", "disc_sample", "n", "line", "sample")
