"""Queries of edges and small high blocks: gradients thinned across, weak edges kept where they touch strong ones, top-hats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.operators import graph, stencil
from terrafold.plans.raster import NEAR5, r6
from terrafold.plans.registry import PX, query
from terrafold.shared import staged
from terrafold.sources import views

#: Gradients (of heights in 256 steps) above which an edge is weak and strong; edge of a cell of the result.
WEAK, STRONG, CELL = 150, 500, 10
#: A gradient across, along or between, by the tangents of 22.5 and 67.5 degrees.
FLAT, STEEP = 0.41421356237309503, 2.414213562373095
_BEFORE = f"CASE WHEN abs(gy) < {FLAT} * abs(gx) THEN l WHEN abs(gy) > {STEEP} * abs(gx) THEN u WHEN gx * gy > 0 THEN ul ELSE ur END"
_AFTER = f"CASE WHEN abs(gy) < {FLAT} * abs(gx) THEN r WHEN abs(gy) > {STEEP} * abs(gx) THEN w WHEN gx * gy > 0 THEN wr ELSE wl END"


def gradients(px: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """line, sample, v, gx, gy, size and its eight neighbours' sizes (l, r, u, w, ul, ur, wl, wr): 3 x 3 gradients, smoothed across; a border's pixels repeat, and beyond it no gradient is."""
    t = stencil.neighbours(px, shape, "v", {"_left": ("sample", -1), "_right": ("sample", 1)})
    t = t.select("line", "sample", "v", F.expr("struct(coalesce(_right, v) - coalesce(_left, v) as d, coalesce(_left, v) + 2 * v + coalesce(_right, v) as s)").alias("row"))
    t = stencil.neighbours(t, shape, "row", {"_up": ("line", -1), "_down": ("line", 1)})
    t = t.withColumn("_up", F.coalesce("_up", "row")).withColumn("_down", F.coalesce("_down", "row")).select("line", "sample", "v", F.expr("_up.d + 2 * row.d + _down.d").alias("gx"), F.expr("_down.s - _up.s").alias("gy"))
    t = t.withColumn("size", F.expr("abs(gx) + abs(gy)"))
    t = stencil.neighbours(t, shape, "size", {"_left": ("sample", -1), "_right": ("sample", 1)})
    t = t.withColumn("row", F.expr("struct(coalesce(_left, 0L) as l, size as c, coalesce(_right, 0L) as r)")).drop("_left", "_right")
    t = stencil.neighbours(t, shape, "row", {"_up": ("line", -1), "_down": ("line", 1)})
    near = {"l": "row.l", "r": "row.r", "u": "_up.c", "w": "_down.c", "ul": "_up.l", "ur": "_up.r", "wl": "_down.l", "wr": "_down.r"}
    return t.select("line", "sample", "v", "gx", "gy", "size", *[F.expr(f"coalesce({e}, 0L)").alias(k) for k, e in near.items()])


def edges(px: DataFrame, shape: tuple[int, int], weak: float, strong: float) -> DataFrame:
    """line, sample, v, edge: whether a pixel's gradient is the largest across it and above weak, in a component of such pixels of which one is above strong."""
    g = staged(gradients(px, shape).select("line", "sample", "v", "size", F.expr(f"size > {weak} and size > {_BEFORE} and size >= {_AFTER}").alias("thin")), "gradients")
    labels = graph.components(g, "thin")
    seeds = labels.join(g.where(f"thin and size > {strong}").select("line", "sample"), ["line", "sample"]).select("label").distinct()
    kept = labels.join(seeds, "label", "left_semi").select("line", "sample", F.lit(True).alias("edge"))
    g, kept = (stencil.spread(t, shape, "line", "sample") for t in (g, kept))
    return g.join(kept, ["line", "sample"], "left").select("line", "sample", "v", F.coalesce("edge", F.lit(False)).alias("edge"))


def scaled(px: DataFrame) -> DataFrame:
    """line, sample, v: heights in 256 whole steps of their range."""
    span = px.agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    return px.crossJoin(F.broadcast(span)).select("line", "sample", F.expr("bigint(floor((z - lo) / (hi - lo + 1e-6D) * 255))").alias("v"))  # one row


_V = f"m AS (SELECT min(z) AS lo, max(z) AS hi FROM {PX}), p AS (SELECT line, sample, floor((z - lo) / (hi - lo + 1e-6::DOUBLE) * 255)::BIGINT AS v FROM {PX}, m)"
_EDGES = f"""rows AS (SELECT p.line, p.sample, p.v, coalesce(r.v, p.v) - coalesce(l.v, p.v) AS d, coalesce(l.v, p.v) + 2 * p.v + coalesce(r.v, p.v) AS s FROM p LEFT JOIN p l ON l.line = p.line AND l.sample = p.sample - 1 LEFT JOIN p r ON r.line = p.line AND r.sample = p.sample + 1),
g AS (SELECT x.line, x.sample, coalesce(a.d, x.d) + 2 * x.d + coalesce(b.d, x.d) AS gx, coalesce(b.s, x.s) - coalesce(a.s, x.s) AS gy FROM rows x LEFT JOIN rows a ON a.line = x.line - 1 AND a.sample = x.sample LEFT JOIN rows b ON b.line = x.line + 1 AND b.sample = x.sample),
z AS (SELECT *, abs(gx) + abs(gy) AS size FROM g),
k AS (SELECT z.line, z.sample, z.gx, z.gy, z.size, {', '.join(f"coalesce(max(q.size) FILTER (q.line = z.line + {a} AND q.sample = z.sample + {b}), 0) AS {n}" for n, a, b in (('l', 0, -1), ('r', 0, 1), ('u', -1, 0), ('w', 1, 0), ('ul', -1, -1), ('ur', -1, 1), ('wl', 1, -1), ('wr', 1, 1)))}
FROM z JOIN z q ON q.line BETWEEN z.line - 1 AND z.line + 1 AND q.sample BETWEEN z.sample - 1 AND z.sample + 1 GROUP BY 1, 2, 3, 4, 5),
thin AS (SELECT line, sample, size FROM k WHERE size > {WEAK} AND size > {_BEFORE} AND size >= {_AFTER}),
e AS (SELECT line, sample FROM thin WHERE size > {STRONG} UNION SELECT t.line, t.sample FROM e JOIN thin t ON t.line BETWEEN e.line - 1 AND e.line + 1 AND t.sample BETWEEN e.sample - 1 AND e.sample + 1)"""


@query(f"""WITH RECURSIVE {_V}, {_EDGES},
low AS (SELECT p.line, p.sample, min(q.v) AS v FROM p, {NEAR5} o JOIN p q ON q.line = p.line + dl AND q.sample = p.sample + ds GROUP BY 1, 2),
opened AS (SELECT p.line, p.sample, max(q.v) AS v FROM low p, {NEAR5} o JOIN low q ON q.line = p.line + dl AND q.sample = p.sample + ds GROUP BY 1, 2),
r AS (SELECT p.line, p.sample, p.v - o.v AS hat, e.line IS NOT NULL AS edge FROM p JOIN opened o USING (line, sample) LEFT JOIN e ON e.line = p.line AND e.sample = p.sample)
SELECT line // {CELL} AS cell_line, sample // {CELL} AS cell_sample, round(avg(greatest(hat / 255, edge::INT)), 6) AS risk, max(hat) AS highest, count(*) FILTER (edge) AS edges FROM r GROUP BY 1, 2""")
def boulder_risk(spark, sf_dir):
    """Small high blocks by cells of 10 x 10: a top-hat of 5 x 5, and edges with hysteresis, whose weak parts are components that touch a strong one."""
    px = views.pixels(spark, sf_dir)
    shape = views.shape(px)
    v = staged(scaled(px), "scaled")
    low = stencil.extremes(v, shape, 5, "v", "min").select("line", "sample", "v", "min")
    hat = stencil.extremes(low, shape, 5, "min", "max").select("line", "sample", (F.col("v") - F.col("max")).alias("hat"))
    r = edges(v, shape, WEAK, STRONG).join(stencil.spread(hat, shape, "line", "sample"), ["line", "sample"])
    risk = F.greatest(F.col("hat") / 255, F.col("edge").cast("int").cast("double"))
    return r.groupBy(F.expr(f"line div {CELL}").alias("cell_line"), F.expr(f"sample div {CELL}").alias("cell_sample")).agg(r6(F.avg(risk)).alias("risk"), F.max("hat").alias("highest"), F.count_if("edge").alias("edges"))
