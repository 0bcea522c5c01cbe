"""Queries of audits and checks: tie grids, conventions, incidence, bands, conversions, JSON leaves, strategies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrafold.operators import graph, order, stencil
from terrafold.plans.channels import _BLOCKS, _blocks
from terrafold.plans.raster import GRADIENT, SPACING, r6
from terrafold.plans.registry import DISC, PX, query
from terrafold.plans.statistics import strata
from terrafold.plans.studies import ex
from terrafold.shared import staged
from terrafold.sources import views

_STEP = 5
_CORNERS = "(VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(a, b)"


@query(f"""WITH px AS {PX}, p AS (SELECT *, line // {_STEP} AS nl, sample // {_STEP} AS ns, line % {_STEP} / {_STEP}::DOUBLE AS fy, sample % {_STEP} / {_STEP}::DOUBLE AS fx FROM px), k AS (SELECT p.*, (nl + a) * {_STEP} AS tl, (ns + b) * {_STEP} AS ts, (CASE WHEN a = 1 THEN fy ELSE 1 - fy END) * (CASE WHEN b = 1 THEN fx ELSE 1 - fx END) AS w FROM p, {_CORNERS}),
i AS (SELECT k.line, k.sample, any_value(k.z) AS z, sum(w * t.z) AS f, count(t.z) AS n FROM k LEFT JOIN px t ON t.line = tl AND t.sample = ts GROUP BY 1, 2)
SELECT count(*) AS pixels, count(*) FILTER (n = 4) AS inside, round(max(abs(z - f)) FILTER (n = 4), 6) AS max_residual, round(sqrt(avg(pow(z - f, 2)) FILTER (n = 4)), 6) AS rms_residual FROM i""")
def tie_grid(spark, sf_dir):
    """Values interpolated from a grid of tie points against the pixels' own: each pixel asks for its four corners by key."""
    px = views.pixels(spark, sf_dir).select("line", "sample", "z")
    corner = F.explode(F.expr(f"transform(array(0, 1, 2, 3), c -> struct((line div {_STEP} + c div 2) * {_STEP} as tl, (sample div {_STEP} + c % 2) * {_STEP} as ts, if(c div 2 = 1, line % {_STEP} / {_STEP}D, 1 - line % {_STEP} / {_STEP}D) * if(c % 2 = 1, sample % {_STEP} / {_STEP}D, 1 - sample % {_STEP} / {_STEP}D) as w))")).alias("c")
    ties = px.where(f"line % {_STEP} = 0 and sample % {_STEP} = 0").select(F.col("line").alias("tl"), F.col("sample").alias("ts"), F.col("z").alias("t"))
    i = px.select("line", "sample", "z", corner).select("line", "sample", "z", "c.*").join(ties, ["tl", "ts"], "left").groupBy("line", "sample").agg(F.first("z").alias("z"), F.sum(F.col("w") * F.col("t")).alias("f"), F.count("t").alias("n"))
    inside = lambda e: F.when(F.col("n") == 4, F.expr(e))
    return i.agg(F.count("*").alias("pixels"), F.count_if(F.col("n") == 4).alias("inside"), r6(F.max(inside("abs(z - f)"))).alias("max_residual"), r6(F.sqrt(F.avg(inside("pow(z - f, 2)")))).alias("rms_residual"))


@query(f"""WITH t AS (SELECT line // {_STEP} AS l, sample // {_STEP} AS s, z FROM {PX} WHERE line % {_STEP} = 0 AND sample % {_STEP} = 0)
SELECT count(*) AS held_out, round(max(abs(t.z - (a.z + b.z) / 2)), 6) AS max_closure, round(sqrt(avg(pow(t.z - (a.z + b.z) / 2, 2))), 6) AS rms_closure, round(avg(abs((b.z - a.z) / (2 * {_STEP}))), 6) AS mean_slope FROM t JOIN t a ON a.l = t.l AND a.s = t.s - 1 JOIN t b ON b.l = t.l AND b.s = t.s + 1 WHERE t.s % 2 = 1""")
def tie_hold_out(spark, sf_dir):
    """Every other tie point left out and closed from its neighbours, with the local slope: windows along the tie lines."""
    t = views.pixels(spark, sf_dir).where(f"line % {_STEP} = 0 and sample % {_STEP} = 0").selectExpr(f"line div {_STEP} as l", f"sample div {_STEP} as s", "z")
    w = Window.partitionBy("l").orderBy("s")
    t = t.select("s", "z", F.lag("z").over(w).alias("a"), F.lead("z").over(w).alias("b")).where("s % 2 = 1 and a is not null and b is not null")
    return t.agg(F.count("*").alias("held_out"), r6(F.max(F.expr("abs(z - (a + b) / 2)"))).alias("max_closure"), r6(F.sqrt(F.avg(F.expr("pow(z - (a + b) / 2, 2)")))).alias("rms_closure"), r6(F.avg(F.expr(f"abs((b - a) / {2 * _STEP}D)"))).alias("mean_slope"))


@query(f"""WITH p AS (SELECT sample * 25.0 + 12.4 AS x, sample AS s FROM {PX}), c AS (SELECT unnest([0.0, 0.5, 1.0])::DOUBLE AS base), r AS (SELECT base, sqrt(avg(pow(x - (s + base) * 25.0, 2))) AS rms FROM p, c GROUP BY 1) SELECT base, round(rms, 6) AS rms, rms = min(rms) OVER () AS chosen FROM r""")
def pixel_convention(spark, sf_dir):
    """Which of three places within a pixel fits given coordinates best."""
    p = views.pixels(spark, sf_dir).select(ex("sample * 25.0 + 12.4").alias("x"), F.col("sample").alias("s"))
    one = p.agg(*[F.sqrt(F.avg(ex(f"pow(x - (s + {b}) * 25.0, 2)"))).alias(f"r{i}") for i, b in enumerate((0.0, 0.5, 1.0))])
    r = one.select(F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.col(f"r{i}").alias("rms"), (F.col(f"r{i}") == F.least("r0", "r1", "r2")).alias("chosen")) for i, b in enumerate((0.0, 0.5, 1.0))])).alias("x"))
    return r.select("x.base", r6("x.rms").alias("rms"), "x.chosen")


@query(f"""SELECT min(line) >= 0 AND min(sample) >= 0 AS starts_inside, max(line) + 1 AS n_lines, max(sample) + 1 AS n_samples, count(*) = (max(line) + 1) * (max(sample) + 1) AS gapless, count(*) = count(DISTINCT line * 1000000 + sample) AS once, max(line) <= 1000000 AND max(sample) <= 99 AS covered FROM {PX}""")
def frame_coverage(spark, sf_dir):
    """Whether a raster starts at its corner, has every pixel once, and lies inside another frame."""
    p = views.pixels(spark, sf_dir)
    per = p.groupBy("line", "sample").agg(F.count("*").alias("n"))
    g = per.agg(F.min("line").alias("l0"), F.min("sample").alias("s0"), (F.max("line") + 1).alias("n_lines"), (F.max("sample") + 1).alias("n_samples"), F.sum("n").alias("c"), F.count("*").alias("d"))
    return g.select(F.expr("l0 >= 0 and s0 >= 0").alias("starts_inside"), "n_lines", "n_samples", F.expr("c = n_lines * n_samples").alias("gapless"), F.expr("c = d").alias("once"), F.expr("n_lines <= 1000001 and n_samples <= 100").alias("covered"))


_INC = f"(SELECT s.line, s.sample, slope, z, 20 + sample / 10.0 AS look, 20 + sample / 10.0 + lv / 10 AS inc FROM slo s WHERE measured)"
_IDENTITY = "degrees(asin(least(1, (1737400.0 + 100000.0) / 1737400.0 * sin(radians(look)))))"


@query(f"""WITH {GRADIENT}, i AS {_INC}, s AS (SELECT abs(inc - lag(inc) OVER (PARTITION BY line ORDER BY sample)) AS d FROM i), q AS (SELECT quantile_cont(d, 0.5) AS p50 FROM s)
SELECT count(*) AS n, round(avg((inc < look)::INT), 6) AS below_look, round(avg(abs(inc - {_IDENTITY})), 6) AS mean_departure, round(any_value(p50) / 0.1, 6) AS step_ratio, round(corr(inc, slope), 6) + 0.0 AS with_slope, any_value(p50) / 0.1 < 3 AND abs(corr(inc, slope)) < 0.3 AND avg((inc < look)::INT) < 0.01 AS passed,
CASE WHEN any_value(p50) / 0.1 < 3 AND abs(corr(inc, slope)) < 0.3 AND avg((inc < look)::INT) < 0.01 THEN count(*) FILTER (inc < 28) END AS criterion FROM i, q""")
def incidence_audit(spark, sf_dir):
    """Whether an incidence layer is geometry or terrain: its departure from the sphere's identity, its steps and its correlation with slope; what depends on it is withheld where it fails."""
    px = views.pixels(spark, sf_dir)
    s = stencil.slope_aspect(px, views.shape(px), SPACING).where("measured").select("line", "sample", "slope", ex("20 + sample / 10.0").alias("look"), ex("20 + sample / 10.0 + lv / 10").alias("inc"))
    s = staged(s, "incidence")
    d = staged(s.select(F.abs(F.col("inc") - F.lag("inc").over(Window.partitionBy("line").orderBy("sample"))).alias("d")).where("d is not null"), "steps")
    q = order.quantiles(d, "d", [0.5]).select(F.col("value").alias("p50"))
    g = s.agg(F.count("*").alias("n"), F.avg(F.expr("int(inc < look)")).alias("b"), F.avg(ex(f"abs(inc - {_IDENTITY})")).alias("m"), F.corr("inc", "slope").alias("c"), F.count_if(F.expr("inc < 28")).alias("k")).join(F.broadcast(q))
    g = g.withColumn("passed", ex("p50 / 0.1 < 3 and abs(c) < 0.3 and b < 0.01"))
    return g.select("n", r6("b").alias("below_look"), r6("m").alias("mean_departure"), r6(ex("p50 / 0.1")).alias("step_ratio"), r6("c").alias("with_slope"), "passed", F.when(F.col("passed"), F.col("k")).alias("criterion"))


@query(f"""WITH p AS (SELECT line, sample, lh * lh + lv * lv AS s0 FROM {PX}), b AS (SELECT line, sample, lh * lh - lv * lv AS s1 FROM {PX} WHERE measured), c AS (SELECT line, sample, lh * lv AS s3 FROM {PX} WHERE z > 5)
SELECT line, sample, round(s0, 6) AS s0, round(coalesce(s1, 0), 6) + 0.0 AS s1, 0.0::DOUBLE AS s2, round(coalesce(s3, 0), 6) + 0.0 AS s3 FROM p LEFT JOIN b USING (line, sample) LEFT JOIN c USING (line, sample)""")
def stokes_bands(spark, sf_dir):
    """Bands of separate files joined by pixel; a missing band, or pixel of one, is zero."""
    px = views.pixels(spark, sf_dir)
    s0 = px.select("line", "sample", F.expr("lh * lh + lv * lv").alias("s0"))
    s1 = px.where("measured").select("line", "sample", F.expr("lh * lh - lv * lv").alias("s1"))
    s3 = px.where("z > 5").select("line", "sample", F.expr("lh * lv").alias("s3"))
    zero = lambda c: r6(F.coalesce(F.col(c), F.lit(0.0))).alias(c)
    return s0.join(s1, ["line", "sample"], "left").join(s3, ["line", "sample"], "left").select("line", "sample", r6("s0").alias("s0"), zero("s1"), F.lit(0.0).alias("s2"), zero("s3"))


@query(f"SELECT least(9, floor(lh / 2))::BIGINT AS a, least(9, floor(lv / 2))::BIGINT AS b, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM {PX} WHERE measured GROUP BY 1, 2")
def joint_histogram(spark, sf_dir):
    """Two layers' joint histogram, its last cells open."""
    h = views.pixels(spark, sf_dir).where("measured").groupBy(F.least(F.lit(9), F.floor(F.col("lh") / 2)).cast("long").alias("a"), F.least(F.lit(9), F.floor(F.col("lv") / 2)).cast("long").alias("b")).agg(F.count("*").alias("n"))
    total = h.agg(F.sum("n").alias("t"))
    return h.join(F.broadcast(total)).select("a", "b", "n", F.round(F.col("n") / F.col("t"), 9).alias("share"))


@query("SELECT mark, n, rank() OVER (ORDER BY n DESC) AS place FROM (SELECT o_orderpriority || ' ' || o_orderstatus AS mark, count(*) AS n FROM orders GROUP BY 1)")
def ranked_marks(spark, sf_dir):
    """How often each mark stands, ranked."""
    o = views.table(spark, sf_dir, "orders").groupBy(F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("mark")).agg(F.count("*").alias("n"))
    return o.withColumn("place", F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"))).cast("long"))  # a row for each mark


@query(f"""WITH p AS (SELECT line, sample, floor(z * 4)::INT - 200 AS dn FROM {PX}) SELECT line, sample, dn, CASE WHEN dn > -199 THEN dn * 0.5 + 1737400.0 END AS radius_m, round((sample - 49.5) * 80.0, 3) AS x, round((4.5 - line) * 80.0, 3) AS y, round((sample - 49.5) * 80.0 / 80.0 + 49.5, 6) AS back FROM p""")
def raw_to_metres(spark, sf_dir):
    """Raw numbers to metres, null where the product has none, and pixels to the polar product's metres and back."""
    p = views.pixels(spark, sf_dir).select("line", "sample", F.expr("int(floor(z * 4)) - 200").alias("dn"))
    x = ex("(sample - 49.5) * 80.0")
    return p.select("line", "sample", "dn", ex("if(dn > -199, dn * 0.5 + 1737400.0, null)").alias("radius_m"), F.round(x, 3).alias("x"), F.round(ex("(4.5 - line) * 80.0"), 3).alias("y"), r6(x / 80.0 + 49.5).alias("back"))


@query("""WITH l AS (SELECT event_type, unnest(json_keys(props)) AS leaf, props FROM events) SELECT event_type, leaf, count(*) AS n, count(DISTINCT json_extract_string(props, '$.' || leaf)) AS kinds FROM l GROUP BY 1, 2""")
def json_leaves(spark, sf_dir):
    """A table of all leaves of JSON objects, whatever their names."""
    e = views.table(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("leaf", "value"))
    return e.groupBy("event_type", "leaf").agg(F.count("*").alias("n"), F.count_distinct("value").alias("kinds"))


@query(f"""WITH b AS (SELECT line // 5 % 2 AS half, line // 5 AS block, avg(z) AS m, var_samp(z) AS v FROM {PX} WHERE measured GROUP BY 1, 2), h AS (SELECT half, count(*) AS blocks, avg(m * m / v) AS looks FROM b GROUP BY 1) SELECT half, blocks, round(looks, 6) AS looks, round(looks - (SELECT avg(looks) FROM h), 6) + 0.0 AS departure FROM h""")
def split_sample(spark, sf_dir):
    """An estimate from either half of the blocks, and how far it is from their mean."""
    b = views.pixels(spark, sf_dir).where("measured").groupBy(F.expr("line div 5 % 2").alias("half"), F.expr("line div 5").alias("block")).agg(F.avg("z").alias("m"), F.var_samp("z").alias("v"))
    h = b.groupBy("half").agg(F.count("*").alias("blocks"), F.avg(F.expr("m * m / v")).alias("looks"))
    return h.withColumn("mean", F.avg("looks").over(Window.partitionBy(F.lit(0)))).select("half", "blocks", r6("looks").alias("looks"), r6(F.expr("looks - mean")).alias("departure"))  # two rows


@query(f"""WITH t AS (SELECT unnest(range(0, 20)) AS dl), p AS (SELECT line, sample, lh, lv FROM {PX}), n AS (SELECT max(line) + 1 AS nl FROM p), r AS (SELECT dl, round(corr(p.lh, q.lv), 9) AS r FROM t, n, p JOIN p q ON q.line = (p.line + dl) % nl AND q.sample = p.sample WHERE dl < nl GROUP BY 1)
SELECT count(*) FILTER (dl > 0) AS shifts, round(max(r) FILTER (dl = 0), 6) + 0.0 AS observed, round((1 + count(*) FILTER (dl > 0 AND abs(r) >= (SELECT abs(r) FROM r WHERE dl = 0))) / (1 + count(*) FILTER (dl > 0)), 6) AS p FROM r""")
def shift_test(spark, sf_dir):
    """Permutation test by toroidal shifts of lines: how often a shifted layer correlates as much as the given one."""
    px = views.pixels(spark, sf_dir)
    n = views.shape(px)[0]
    s = px.select("lh", "line", "sample", F.explode(F.sequence(F.lit(0), F.lit(min(19, n - 1)))).alias("dl")).select("lh", "sample", "dl", ((F.col("line") + F.col("dl")) % n).alias("line"))
    r = staged(s.join(px.select("line", "sample", "lv"), ["line", "sample"]).groupBy("dl").agg(F.round(F.corr("lh", "lv"), 9).alias("r")), "shifts")
    own = r.where("dl = 0").select(F.col("r").alias("own"))
    shifted = F.col("dl") > 0
    g = r.join(F.broadcast(own)).agg(F.count_if(shifted).alias("shifts"), F.first("own").alias("own"), F.count_if(shifted & (F.abs("r") >= F.abs("own"))).alias("k"))
    return g.select("shifts", r6("own").alias("observed"), r6(F.expr("(1 + k) / (1 + shifts)")).alias("p"))


@query(f"""WITH n AS (SELECT count(*) FILTER (z < 20) AS dark, count(*) AS cells FROM {PX}), d AS (SELECT line // 4 AS line, sample // 4 AS sample, bool_or(z < 20) AS any_dark, avg((z < 20)::INT) AS share FROM {PX} GROUP BY 1, 2)
SELECT line, sample, any_dark, round(share, 6) AS share, dark AS native_dark, round(dark / cells, 6) AS native_share FROM d, n""")
def display_summary(spark, sf_dir):
    """A mask at display size beside its summary at native size, which is taken before any resampling."""
    px = views.pixels(spark, sf_dir).withColumn("d", F.col("z") < 20)
    n = px.agg(F.count_if("d").alias("native_dark"), r6(F.count_if("d") / F.count("*")).alias("native_share"))
    d = px.groupBy(F.expr("line div 4").alias("line"), F.expr("sample div 4").alias("sample")).agg(F.bool_or("d").alias("any_dark"), r6(F.avg(F.col("d").cast("int"))).alias("share"))
    return d.join(F.broadcast(n))


@query(f"""WITH d AS (SELECT CASE WHEN x > 9.5 THEN 'rare' WHEN id % 2 = 0 THEN 'L' ELSE 'S' END AS band, exposed, outcome AND x <= 9.5 AS outcome FROM {DISC}), t AS (SELECT band, count(*) FILTER (exposed AND outcome) AS a, count(*) FILTER (exposed AND NOT outcome) AS b, count(*) FILTER (NOT exposed AND outcome) AS c, count(*) FILTER (NOT exposed AND NOT outcome) AS d, count(*) AS n FROM d GROUP BY 1)
SELECT band, n, a + c AS events, CASE WHEN a + c = 0 OR b + d = 0 THEN NULL ELSE round((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)), 6) END AS odds_ratio FROM t""")
def band_tables(spark, sf_dir):
    """Discs and odds by band; a band without an event has no fit."""
    d = views.discs(spark, sf_dir).select(F.expr("case when x > 9.5D then 'rare' when id % 2 = 0 then 'L' else 'S' end").alias("band"), "exposed", F.expr("outcome and x <= 9.5D").alias("outcome"))
    t = strata(d, "band")
    return t.select("band", "n", F.expr("a + c").alias("events"), F.expr("if(a + c = 0 or b + d = 0, null, round((a + 0.5D) * (d + 0.5D) / ((b + 0.5D) * (c + 0.5D)), 6))").alias("odds_ratio"))


_STRATEGIES = {"short": (0.0, 0.0), "safe": (1.0, 0.5), "science": (0.25, -0.5)}
_STRAT_SQL = "(VALUES " + ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in _STRATEGIES.items()) + ") g(strategy, rough, bright)"


@query(f"""WITH RECURSIVE b AS {_BLOCKS}, m AS (SELECT line, sample, h, line * 1000 + sample AS v FROM b WHERE h < 0.65), o AS (SELECT a.v AS dl, c.v AS ds FROM range(-1, 2) a(v), range(-1, 2) c(v) WHERE a.v <> 0 OR c.v <> 0),
e AS (SELECT strategy, p.v AS src, q.v AS dst, sqrt(dl * dl + ds * ds) * (1 + rough * q.h + bright * q.h * q.h) AS w FROM {_STRAT_SQL}, m p, o JOIN m q ON q.line = p.line + dl AND q.sample = p.sample + ds), s AS (SELECT min(v) AS v FROM m),
r(strategy, v, cost, n) USING KEY (strategy, v) AS (SELECT strategy, v, 0.0::DOUBLE, 0 FROM s, {_STRAT_SQL} UNION SELECT e.strategy, e.dst, min(r.cost + e.w), max(r.n) + 1 FROM r JOIN e ON e.src = r.v AND e.strategy = r.strategy LEFT JOIN recurring.r AS k ON k.v = e.dst AND k.strategy = e.strategy WHERE r.cost + e.w < coalesce(k.cost, 1e300) - 1e-12 GROUP BY 1, 2)
SELECT strategy, count(*) AS reached, round(max(cost), 6) AS farthest, round(avg(cost), 6) AS mean FROM r GROUP BY 1""")
def strategy_routes(spark, sf_dir):
    """Least costs under three strategies at once, each with its own cost of entering a block: costs differ by direction. The strategy is part of the vertex."""
    b = _blocks(spark, sf_dir)
    number, place, part = graph.numbered(views.shape(b))
    s = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("rough"), F.lit(y).alias("bright")) for k, (x, y) in enumerate(_STRATEGIES.values())]))
    e = graph.grid_edges(b, "h < 0.65D", carry=["h"]).select("*", s.alias("s"))
    e = e.select(number("src", "s.k").alias("src"), number("dst", "s.k").alias("dst"), F.expr("step * (1 + s.rough * dst_h + s.bright * dst_h * dst_h)").alias("cost"))
    start = b.where("h < 0.65D").agg(F.min(F.struct("line", "sample")).alias("v")).select("v", F.explode(F.sequence(F.lit(0), F.lit(len(_STRATEGIES) - 1))).alias("k")).select(number("v", "k").alias("v"))
    best = graph.cheapest(e, start, part).withColumn("v", place("v"))
    strategy = F.element_at(F.array(*[F.lit(k) for k in _STRATEGIES]), (F.col("v.layer") + 1).cast("int"))
    return best.groupBy(strategy.alias("strategy")).agg(F.count("*").alias("reached"), r6(F.max("cost")).alias("farthest"), r6(F.avg("cost")).alias("mean"))
