"""Queries on complex channels and on correlation: noise, ellipticity, gates, local coherence, lags, scores, routes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.operators import graph, order, stencil
from terrafold.plans.raster import GRADIENT, ROUGH, SPACING, r6, roughened
from terrafold.plans.registry import PX, query
from terrafold.plans.studies import dbl, ex
from terrafold.shared import staged
from terrafold.sources import views

_LOOKS = "(SELECT vec_id AS line, sample, embedding[4 * sample + 1]::DOUBLE AS re_h, embedding[4 * sample + 2]::DOUBLE AS im_h, embedding[4 * sample + 3]::DOUBLE AS re_v, embedding[4 * sample + 4]::DOUBLE AS im_v FROM (SELECT vec_id, embedding, unnest(range(0, 16)) AS sample FROM embeddings))"
_CELLS = f"(SELECT line // 4 AS cell, sample, avg(re_h * re_h + im_h * im_h) AS hh, avg(re_v * re_v + im_v * im_v) AS vv, avg(re_h * re_v + im_h * im_v) AS re, avg(im_h * re_v - re_h * im_v) AS im FROM {_LOOKS} GROUP BY 1, 2)"


def cells(spark, sf_dir) -> DataFrame:
    """cell, sample, hh, vv, re, im: coherency over four lines."""
    return views.looks(spark, sf_dir).groupBy(F.expr("line div 4").alias("cell"), "sample").agg(
        *[F.avg(F.expr(x)).alias(n) for n, x in {"hh": "re_h * re_h + im_h * im_h", "vv": "re_v * re_v + im_v * im_v", "re": "re_h * re_v + im_h * im_v", "im": "im_h * re_v - re_h * im_v"}.items()]
    )


def _n9(e):
    return F.round(e, 9) + F.lit(0.0)


_FLOOR = "(0.002 + 0.0002 * sample)"


@query(f"""WITH n AS (SELECT *, hh - {_FLOOR} AS hc, vv - {_FLOOR} AS vc, sqrt(re * re + im * im) AS amp FROM {_CELLS}), b AS (SELECT *, hc > 0 AND vc > 0 AS pos, CASE WHEN hc > 0 AND vc > 0 THEN sqrt(hc * vc) END AS bound FROM n)
SELECT cell, sample, pos, coalesce(pos AND amp > bound, false) AS projected, round(CASE WHEN pos THEN hc ELSE 0 END, 9) + 0.0 AS hh, round(CASE WHEN pos THEN vc ELSE 0 END, 9) + 0.0 AS vv, round(CASE WHEN pos AND amp > bound THEN re * bound / amp ELSE re END, 9) + 0.0 AS re, round(CASE WHEN pos AND amp > bound THEN im * bound / amp ELSE im END, 9) + 0.0 AS im FROM b""")
def noise_corrected(spark, sf_dir):
    """Coherency less a noise floor that rises with range; the cross term is scaled to what the powers allow."""
    n = cells(spark, sf_dir).withColumn("hc", ex(f"hh - {_FLOOR}")).withColumn("vc", ex(f"vv - {_FLOOR}")).withColumn("amp", F.expr("sqrt(re * re + im * im)"))
    n = n.withColumn("pos", F.expr("hc > 0 and vc > 0")).withColumn("bound", F.expr("if(pos, sqrt(hc * vc), null)")).withColumn("projected", F.expr("coalesce(pos and amp > bound, false)"))
    cross = lambda c: _n9(F.expr(f"if(projected, {c} * bound / amp, {c})")).alias(c)
    return n.select("cell", "sample", "pos", "projected", _n9(F.expr("if(pos, hc, 0D)")).alias("hh"), _n9(F.expr("if(pos, vc, 0D)")).alias("vv"), cross("re"), cross("im"))


_ER, _EI = "(0.1 * cos(radians(30)))", "(0.1 * sin(radians(30)))"
_ELL = f"""b AS (SELECT cell, sample, 0.5 * (hh + vv + 2 * im) AS sc, 0.5 * (hh + vv - 2 * im) AS oc, 0.5 * (hh - vv) AS xr, re AS xi FROM {{cells}}),
e AS (SELECT *, sc + 0.01 * oc + 2 * ({_ER} * xr + {_EI} * xi) AS sc2, oc + 0.01 * sc + 2 * ({_ER} * xr - {_EI} * xi) AS oc2, xr + {_ER} * oc + {_ER} * sc + 0.01 * xr AS xr2, xi + {_EI} * oc - {_EI} * sc - 0.01 * xi AS xi2 FROM b)"""


@query(f"WITH {_ELL.format(cells=_CELLS)} SELECT cell, sample, round(0.5 * (sc2 + oc2 + 2 * xr2), 9) + 0.0 AS hh, round(0.5 * (sc2 + oc2 - 2 * xr2), 9) + 0.0 AS vv, round(xi2, 9) + 0.0 AS re, round(-0.5 * (oc2 - sc2), 9) + 0.0 AS im FROM e")
def ellipticity(spark, sf_dir):
    """Coherency under a transmitted wave that is a tenth elliptical at 30 degrees: both circular channels mixed, and back."""
    cells(spark, sf_dir).createOrReplaceTempView("_coherency_cells")
    e = spark.sql(dbl(f"WITH {_ELL.format(cells='_coherency_cells')} SELECT * FROM e"))
    return e.select("cell", "sample", _n9(ex("0.5 * (sc2 + oc2 + 2 * xr2)")).alias("hh"), _n9(ex("0.5 * (sc2 + oc2 - 2 * xr2)")).alias("vv"), _n9(F.col("xi2")).alias("re"), _n9(ex("-0.5 * (oc2 - sc2)")).alias("im"))


_RULE = "hh > 0 AND vv > 0 AND hh + vv - 2 * im > 0 AND hh + vv + 2 * im > 0"


@query(f"""WITH g AS (SELECT *, {_RULE} AS ok, hh > 2 * {_FLOOR} AND vv > 2 * {_FLOOR} AS loud FROM {_CELLS}), f AS (SELECT *, CASE WHEN ok THEN (hh + vv + 2 * im) / (hh + vv - 2 * im) END AS ratio, CASE WHEN ok THEN sqrt(pow(hh - vv, 2) + 4 * (re * re + im * im)) / (hh + vv) END AS dop FROM g)
SELECT sample, count(*) AS cells, count(*) FILTER (ok) AS usable, count(*) FILTER (loud) AS loud, count(*) FILTER (ok AND loud AND ratio > 1) AS over, count(*) FILTER (ok AND loud AND ratio > 1 AND dop < 0.9) AS fires, round(avg(dop), 6) AS mean_dop FROM f GROUP BY 1""")
def signal_gate(spark, sf_dir):
    """Cells over a noise floor that rises with range, and those where the ratio and the polarisation both fire."""
    g = cells(spark, sf_dir).withColumn("ok", F.expr(_RULE)).withColumn("loud", ex(f"hh > 2 * {_FLOOR} and vv > 2 * {_FLOOR}"))
    f = g.withColumn("ratio", F.expr("if(ok, (hh + vv + 2 * im) / (hh + vv - 2 * im), null)")).withColumn("dop", F.expr("if(ok, sqrt(pow(hh - vv, 2) + 4 * (re * re + im * im)) / (hh + vv), null)"))
    n = lambda e: F.count_if(ex(e))
    return f.groupBy("sample").agg(F.count("*").alias("cells"), n("ok").alias("usable"), n("loud").alias("loud"), n("ok and loud and ratio > 1").alias("over"), n("ok and loud and ratio > 1 and dop < 0.9").alias("fires"), r6(F.avg("dop")).alias("mean_dop"))


_NEAR3 = "(SELECT a.v AS dl, b.v AS ds FROM range(-1, 2) a(v), range(-1, 2) b(v))"


@query(f"""WITH l AS {_LOOKS}, w AS (SELECT p.line, p.sample, sum(q.re_h * q.re_v + q.im_h * q.im_v) AS re, sum(q.im_h * q.re_v - q.re_h * q.im_v) AS im, sum(q.re_h * q.re_h + q.im_h * q.im_h) AS a, sum(q.re_v * q.re_v + q.im_v * q.im_v) AS b FROM l p, {_NEAR3} o JOIN l q ON q.line = p.line + dl AND q.sample = p.sample + ds GROUP BY 1, 2)
SELECT count(*) AS n, round(median(sqrt(re * re + im * im) / sqrt(a * b)), 6) AS median, round(quantile_cont(sqrt(re * re + im * im) / sqrt(a * b), 0.95), 6) AS p95 FROM w WHERE a * b > 0""")
def local_coherence(spark, sf_dir):
    """Coherence of two complex channels over the 3 x 3 windows around each look: box sums of their products."""
    l = views.looks(spark, sf_dir)
    sums = {n: F.expr(x) for n, x in {"re": "re_h * re_v + im_h * im_v", "im": "im_h * re_v - re_h * im_v", "a": "re_h * re_h + im_h * im_h", "b": "re_v * re_v + im_v * im_v"}.items()}
    w = stencil.box(l, views.shape(l), 3, sums).where("a * b > 0").select(F.expr("sqrt(re * re + im * im) / sqrt(a * b)").alias("c"))
    w = staged(w, "coherence")
    return w.agg(F.count("*").alias("n")).join(F.broadcast(order.wide(order.quantiles(w, "c", [0.5, 0.95]), {"median": 0.5, "p95": 0.95})))


@query(f"""WITH p AS (SELECT line // 5 AS a, sample // 5 AS b, line, sample, z, count(*) FILTER (z > 0.5) OVER (PARTITION BY line // 5, sample // 5) AS n, z - avg(z) OVER (PARTITION BY line // 5, sample // 5) AS d FROM {PX}), f AS (SELECT * FROM p WHERE n = 25), k AS (SELECT unnest(range(1, 4)) AS lag),
x AS (SELECT 'lines' AS axis, lag, f.d AS u, g.d AS v FROM k, f JOIN f g ON g.a = f.a AND g.b = f.b AND g.sample = f.sample AND g.line = f.line + lag UNION ALL SELECT 'samples', lag, f.d, g.d FROM k, f JOIN f g ON g.a = f.a AND g.b = f.b AND g.line = f.line AND g.sample = f.sample + lag)
SELECT axis, lag, count(*) AS pairs, round(avg(u * v) / sqrt(avg(u * u) * avg(v * v)), 6) + 0.0 AS r FROM x GROUP BY 1, 2""")
def lag_correlation(spark, sf_dir):
    """Correlation with itself at small lags inside full patches of 5 x 5, after removing each patch's mean: windows within the patch, no join."""
    patch = Window.partitionBy(F.expr("line div 5"), F.expr("sample div 5"))
    p = views.pixels(spark, sf_dir).select("line", "sample", F.expr("line div 5").alias("a"), F.expr("sample div 5").alias("b"), F.count_if(F.col("z") > 0.5).over(patch).alias("n"), (F.col("z") - F.avg("z").over(patch)).alias("d")).where("n = 25")
    lags = {"lines": Window.partitionBy("a", "b", "sample").orderBy("line"), "samples": Window.partitionBy("a", "b", "line").orderBy("sample")}
    p = p.select("d", *[F.lead("d", k).over(w).alias(f"{axis}_{k}") for axis, w in lags.items() for k in (1, 2, 3)])
    pairs = F.array(*[F.struct(F.lit(axis).alias("axis"), F.lit(k).cast("long").alias("lag"), F.col(f"{axis}_{k}").alias("v")) for axis in lags for k in (1, 2, 3)])
    x = p.select(F.col("d").alias("u"), F.explode(pairs).alias("x")).select("u", "x.*").where("v is not null")
    return x.groupBy("axis", "lag").agg(F.count("*").alias("pairs"), r6(F.expr("avg(u * v) / sqrt(avg(u * u) * avg(v * v))")).alias("r"))


@query(f"""WITH n AS (SELECT max(line) + 1 AS nl, max(sample) + 1 AS ns FROM {PX}), p AS (SELECT px.*, least(2, line * 3 // nl) AS third, least(1, sample * 2 // ns) AS half FROM {PX} px, n),
v AS (SELECT a.third, a.half, corr(a.z, b.z) AS r FROM p a JOIN p b ON b.line = a.line + 1 AND b.sample = a.sample AND b.third = a.third AND b.half = a.half WHERE a.measured AND b.measured GROUP BY 1, 2), h AS (SELECT a.third, a.half, corr(a.z, b.z) AS r FROM p a JOIN p b ON b.line = a.line AND b.sample = a.sample + 1 AND b.third = a.third AND b.half = a.half WHERE a.measured AND b.measured GROUP BY 1, 2)
SELECT p.third, p.half, count(*) FILTER (measured) AS n_valid, round(any_value(v.r), 6) + 0.0 AS lag_lines, round(any_value(h.r), 6) + 0.0 AS lag_samples FROM p LEFT JOIN v ON v.third = p.third AND v.half = p.half LEFT JOIN h ON h.third = p.third AND h.half = p.half GROUP BY 1, 2""")
def stationarity(spark, sf_dir):
    """Correlation with the next line and the next sample in each of six blocks of the raster."""
    px = views.pixels(spark, sf_dir)
    nl, ns = views.shape(px)
    p = px.select("line", "sample", "z", "measured", F.when(F.col("measured"), F.col("z")).alias("m"), F.expr(f"least(2, line * 3 div {nl})").alias("third"), F.expr(f"least(1, sample * 2 div {ns})").alias("half"))
    t = p.withColumn("key", F.when(F.col("measured"), F.struct("m", "third", "half")))
    t = stencil.neighbours(t, (nl, ns), "key", {"down": ("line", 1), "right": ("sample", 1)})
    same = lambda k: F.when((F.col(f"{k}.third") == F.col("third")) & (F.col(f"{k}.half") == F.col("half")), F.col(f"{k}.m"))
    t = t.withColumn("d", same("down")).withColumn("r", same("right"))
    both = lambda k: r6(F.corr(F.when(F.col(k).isNotNull(), F.col("m")), F.when(F.col("m").isNotNull(), F.col(k))))
    return t.groupBy("third", "half").agg(F.count_if("measured").alias("n_valid"), both("d").alias("lag_lines"), both("r").alias("lag_samples"))


# ---- scores and routes

_TERMS = {"gentle": "1 - least(1, slope / 60)", "smooth": "1 - least(1, roughness / 80)", "power": "least(1, lv / 13)", "flat": "1.0"}
_WEIGHT = {"gentle": 0.4, "smooth": 0.3, "power": 0.3, "flat": 0.0}


@query(f"WITH {GRADIENT}, {ROUGH}, h AS (SELECT s.*, roughness FROM slo s JOIN rough USING (line, sample) WHERE measured), t AS (" + " UNION ALL ".join(f"SELECT '{k}' AS term, {e} AS v, {_WEIGHT[k]} AS w FROM h" for k, e in _TERMS.items())
       + ") SELECT term, round(max(v) - min(v), 6) AS span, round(avg(v * w), 6) AS share, max(v) - min(v) < 1e-9 AS inert FROM t GROUP BY 1")
def score_terms(spark, sf_dir):
    """How far each term of a site's score ranges, what it adds on average, and whether it can't tell sites apart."""
    px = views.pixels(spark, sf_dir)
    shape = views.shape(px)
    h = roughened(stencil.slope_aspect(px, shape, SPACING), shape).where("measured")
    one = h.agg(*[x for k, e in _TERMS.items() for x in ((F.max(ex(e)) - F.min(ex(e))).alias(f"s_{k}"), F.avg(ex(f"({e}) * {_WEIGHT[k]}")).alias(f"a_{k}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("term"), F.col(f"s_{k}").cast("double").alias("s"), F.col(f"a_{k}").alias("a")) for k in _TERMS]))
    return one.select(rows.alias("x")).select("x.term", r6("x.s").alias("span"), r6("x.a").alias("share"), (F.col("x.s") < 1e-9).alias("inert"))


_OFFSETS = [(0, 0), (2, 9), (-2, -9), (3, -12), (-3, 15)]
_OFF_SQL = "(VALUES " + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(_OFFSETS)) + ") o(k, dl, ds)"


@query(f"""WITH px AS {PX}, c AS (SELECT avg(line)::INT AS cl, avg(sample)::INT AS cs FROM (SELECT floor(avg(line)) AS line, floor(avg(sample)) AS sample FROM px WHERE measured AND z > 100)), p AS (SELECT k, cl + dl AS line, cs + ds AS sample, sqrt(dl * dl + ds * ds) AS far FROM {_OFF_SQL}, c),
g AS (SELECT k, p.line, p.sample, any_value(far) AS far, count(q.z) AS cells, avg(q.z) AS z, avg(q.measured::INT) AS safe FROM p LEFT JOIN px q ON abs(q.line - p.line) <= 1 AND abs(q.sample - p.sample) <= 1 GROUP BY 1, 2, 3)
SELECT k, line, sample, cells, round(0.5 * safe + 0.3 * (1 - least(1, z / 200)) + 0.2 * (1 - far / 20), 6) AS score, k = first(k) OVER (ORDER BY round(0.5 * safe + 0.3 * (1 - least(1, z / 200)) + 0.2 * (1 - far / 20), 6) DESC NULLS LAST, k) AS best FROM g""")
def candidate_scores(spark, sf_dir):
    """Candidates at fixed offsets from the centre of the high pixels, scored by the means of the 3 x 3 pixels around them."""
    px = views.pixels(spark, sf_dir)
    c = px.where("measured and z > 100").agg(F.floor(F.avg("line")).alias("cl"), F.floor(F.avg("sample")).alias("cs"))
    p = c.select("cl", "cs", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(a).alias("dl"), F.lit(b).alias("ds")) for i, (a, b) in enumerate(_OFFSETS)])).alias("o"))
    p = p.select("o.k", (F.col("cl") + F.col("o.dl")).alias("line"), (F.col("cs") + F.col("o.ds")).alias("sample"), F.expr("sqrt(o.dl * o.dl + o.ds * o.ds)").alias("far"))
    near = p.select("*", F.explode(F.expr("flatten(transform(sequence(-1, 1), a -> transform(sequence(-1, 1), b -> struct(line + a as nl, sample + b as ns))))")).alias("n")).select("k", "line", "sample", "far", "n.*")
    q = px.select(F.col("line").alias("nl"), F.col("sample").alias("ns"), "z", "measured")
    g = near.join(q, ["nl", "ns"], "left").groupBy("k", "line", "sample", "far").agg(F.count("z").alias("cells"), F.avg("z").alias("z"), F.avg(F.col("measured").cast("int")).alias("safe"))
    g = g.withColumn("score", r6(ex("0.5 * safe + 0.3 * (1 - least(1, z / 200)) + 0.2 * (1 - far / 20)")))
    return g.select("k", "line", "sample", "cells", "score", (F.col("k") == F.first("k").over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("score"), "k"))).alias("best"))  # five rows


@query(f"""WITH {GRADIENT}, m AS (SELECT line, sample, slope FROM slo WHERE measured AND z > 60), c AS (SELECT floor(avg(line))::BIGINT AS cl, floor(avg(sample))::BIGINT AS cs FROM m)
SELECT line, sample, round(sqrt(pow(line - cl, 2) + pow(sample - cs, 2)), 6) AS distance, round(slope, 6) AS slope FROM m, c WHERE slope < 60 ORDER BY pow(line - cl, 2) + pow(sample - cs, 2), line, sample LIMIT 1""")
def target_cell(spark, sf_dir):
    """The gentle candidate nearest to the candidates' centre, whose coordinates are cut to whole pixels."""
    px = views.pixels(spark, sf_dir)
    m = stencil.slope_aspect(px, views.shape(px), SPACING).where("measured and z > 60").select("line", "sample", "slope")
    c = m.agg(F.floor(F.avg("line")).alias("cl"), F.floor(F.avg("sample")).alias("cs"))
    j = m.join(F.broadcast(c)).where("slope < 60").withColumn("d", F.expr("pow(line - cl, 2) + pow(sample - cs, 2)"))
    return j.agg(F.min_by(F.struct("line", "sample", "d", "slope"), F.struct("d", "line", "sample")).alias("x")).select("x.line", "x.sample", r6(F.sqrt("x.d")).alias("distance"), r6("x.slope").alias("slope"))


def _blocks(spark, sf_dir) -> DataFrame:
    px = views.pixels(spark, sf_dir).groupBy(F.expr("line div 4").alias("line"), F.expr("sample div 5").alias("sample")).agg(F.least(F.lit(1.0), F.avg("z") / 100).alias("h"))
    return staged(px, "blocks")


_BLOCKS = f"(SELECT line // 4 AS line, sample // 5 AS sample, least(1, avg(z) / 100) AS h FROM {PX} GROUP BY 1, 2)"


@query(f"""WITH RECURSIVE b AS {_BLOCKS}, m AS (SELECT line, sample FROM b WHERE h < 0.5), o AS (SELECT a.v AS dl, c.v AS ds FROM range(-1, 2) a(v), range(-1, 2) c(v)), s AS (SELECT line, sample FROM m ORDER BY line, sample LIMIT 1),
r AS (SELECT line, sample FROM s UNION SELECT m.line, m.sample FROM r, o JOIN m ON m.line = r.line + dl AND m.sample = r.sample + ds)
SELECT b.line, b.sample, CASE WHEN b.h >= 0.5 THEN 'BLOCKED' WHEN r.line IS NULL THEN 'UNREACHABLE' ELSE 'REACHABLE' END AS state FROM b LEFT JOIN r USING (line, sample)""")
def reachability(spark, sf_dir):
    """Which blocks a path from the first passable one reaches, told by its component before any distance is computed."""
    b = _blocks(spark, sf_dir)
    c = staged(graph.components(b, "h < 0.5D"), "components")
    start = c.agg(F.min_by("label", F.struct("line", "sample")).alias("start"))
    j = b.join(c, ["line", "sample"], "left").join(F.broadcast(start))
    return j.select("line", "sample", F.when(F.expr("h >= 0.5D"), "BLOCKED").when(F.coalesce(F.col("label") == F.col("start"), F.lit(False)), "REACHABLE").otherwise("UNREACHABLE").alias("state"))


@query(f"""WITH RECURSIVE b AS {_BLOCKS}, m AS (SELECT line, sample, h, line * 1000 + sample AS v FROM b WHERE h < 0.65), o AS (SELECT a.v AS dl, c.v AS ds FROM range(-1, 2) a(v), range(-1, 2) c(v) WHERE a.v <> 0 OR c.v <> 0),
e AS (SELECT p.v AS src, q.v AS dst, sqrt(dl * dl + ds * ds) * (1 + (p.h + q.h) / 2) AS w FROM m p, o JOIN m q ON q.line = p.line + dl AND q.sample = p.sample + ds), s AS (SELECT min(v) AS v FROM m),
r(v, cost, n) USING KEY (v) AS (SELECT v, 0.0::DOUBLE, 0 FROM s UNION SELECT e.dst, min(r.cost + e.w), max(r.n) + 1 FROM r JOIN e ON e.src = r.v LEFT JOIN recurring.r AS k ON k.v = e.dst WHERE r.cost + e.w < coalesce(k.cost, 1e300) - 1e-12 GROUP BY e.dst),
t AS (SELECT v FROM m WHERE h > 0.55 AND v % 7 = 3)
SELECT t.v // 1000 AS line, t.v % 1000 AS sample, round(cost, 6) AS cost, cost = min(cost) OVER () AS nearest FROM t JOIN r USING (v)""")
def route_targets(spark, sf_dir):
    """Least cost from the first passable block to each target it reaches, and which of them is nearest."""
    best, t, place = routed(spark, sf_dir)
    j = staged(best.join(t, "v").select(place("v").alias("v"), "cost"), "targets")
    low = j.agg(F.min("cost").alias("low"))
    return j.join(F.broadcast(low)).select("v.line", "v.sample", r6("cost").alias("cost"), (F.col("cost") == F.col("low")).alias("nearest"))


def routed(spark, sf_dir) -> tuple[DataFrame, DataFrame, Callable[[str], Column]]:
    """What each block costs, with the block before it; the targets; and the place of a block's number."""
    b = _blocks(spark, sf_dir)
    number, place, part = graph.numbered(views.shape(b))
    e = graph.grid_edges(b, "h < 0.65D", carry=["h"])
    start = b.where("h < 0.65D").agg(F.min(F.struct("line", "sample")).alias("v")).select(number("v").alias("v"))
    best = graph.cheapest(e.select(number("src").alias("src"), number("dst").alias("dst"), (F.col("step") * (1 + (F.col("src_h") + F.col("dst_h")) / 2)).alias("cost")), start, part)
    t = b.where("h > 0.55D and h < 0.65D and (line * 1000 + sample) % 7 = 3").select(F.struct("line", "sample").alias("v"))
    return best, t.select(number("v").alias("v")), place


@query()
def route_walk(spark, sf_dir):
    """The way to the nearest target, block by block from its end: place, cost so far, climb and energy (iterative: no SQL; tested for its invariants)."""
    best, t, place = routed(spark, sf_dir)
    end = best.join(t, "v").agg(F.min_by("v", F.struct("cost", "v")).alias("v"))
    walk = graph.walk_back(best, end).select(place("v").alias("x"), "cost", "place").select(F.struct("x.line", "x.sample").alias("v"), "cost", "place")
    h = _blocks(spark, sf_dir).select(F.struct("line", "sample").alias("v"), "h")
    w = Window.partitionBy(F.lit(0)).orderBy("place")  # one path: no longer than the grid's width and height together, or some of that
    p = walk.join(h, "v").withColumn("climb", F.greatest(F.lit(0.0), F.col("h") - F.coalesce(F.lag("h").over(w), F.col("h"))))
    return p.select("place", "v.line", "v.sample", r6("cost").alias("cost"), r6(F.sum("climb").over(w)).alias("climbed"), r6(F.col("cost") * 0.5 + F.sum("climb").over(w) * 1.62).alias("energy"))
