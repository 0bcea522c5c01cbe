"""Graphs of grids in parts: what crosses parts, what many steps cost."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from terrafold.operators import graph


def maze(lines, samples, seed, share=0.62):
    rng = random.Random(seed)
    return [(a - 3, b, rng.uniform(0, 1)) for a in range(lines) for b in range(samples) if rng.random() < share]


@pytest.mark.parametrize("diagonal", [True, False])
@pytest.mark.parametrize("edge", [2, 5, 256])
def test_components_across_tiles(spark, monkeypatch, edge, diagonal):
    monkeypatch.setattr(graph, "EDGE", edge)
    cells = {(a, b) for a, b, _ in maze(17, 14, edge)}
    px = spark.createDataFrame([(a, b, True) for a, b in cells] + [(90, 90, False)], "line long, sample long, hit boolean")
    want, sizes = {}, {}
    for first in sorted(cells):
        if first not in want:
            left, want[first] = [first], first
            while left:
                a, b = left.pop()
                for x in ((a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if diagonal or 0 in (i, j)):
                    if x in cells and x not in want:
                        want[x] = first
                        left.append(x)
    for root in want.values():
        sizes[root] = sizes.get(root, 0) + 1
    assert {(r.line, r["sample"]): tuple(r.label) for r in graph.components(px, "hit", diagonal).collect()} == want
    got = graph.components(px, "hit", diagonal, sized=True).collect()
    assert {(r.line, r["sample"]): (tuple(r.label), r.size) for r in got} == {k: (v, sizes[v]) for k, v in want.items()} and len(got) == len(want)
    assert graph.components(px.where("line = 90"), "hit", diagonal).collect() == []


@pytest.mark.parametrize("part", [7, 40, 1 << 17])
def test_paths_across_parts(spark, monkeypatch, part):
    """Ways that leave a part and come back, layers with costs of their own, vertices that nothing reaches."""
    monkeypatch.setattr(graph, "PART", part)
    monkeypatch.setattr(graph, "ACROSS", 4)
    h = {(a + 3, b): x for a, b, x in maze(13, 11, part)}
    px = spark.createDataFrame([(a, b, x) for (a, b), x in h.items()], "line long, sample long, h double")
    number, place, of = graph.numbered((13, 11))
    e = graph.grid_edges(px, "true", carry=["h"]).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    e = e.select(number("src", "k").alias("src"), number("dst", "k").alias("dst"), F.expr("step * (1 + (1 - k) * src_h + 9 * k * dst_h)").alias("cost"))
    first = min(h)
    source = spark.createDataFrame([(first, k) for k in (0, 1)], "v struct<line: long, sample: long>, k int").select(number("v", "k").alias("v"))
    rows = graph.cheapest(e, source, of).withColumn("v", place("v")).withColumn("before", place("before")).collect()
    got = {(r.v.layer, r.v.line, r.v["sample"]): r for r in rows}
    assert len(got) == len(rows)
    want = {}
    for k in (0, 1):
        heap = [(0.0, first)]
        while heap:
            c, (a, b) = heapq.heappop(heap)
            if (k, a, b) not in want:
                want[k, a, b] = c
                for i, j in ((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (a + i, b + j) in h):
                    heapq.heappush(heap, (c + math.hypot(i, j) * (1 + (1 - k) * h[a, b] + 9 * k * h[a + i, b + j]), (a + i, b + j)))
    assert {v: r.cost for v, r in got.items()} == pytest.approx(want)
    for r in rows:
        before = got[tuple(r.before[c] for c in ("layer", "line", "sample"))]
        assert r.hops == (before.hops + 1 if before is not r else 0)


def test_rounds_of_long_paths(spark, monkeypatch):
    """A path of a thousand steps within a part takes a few tables, not one for each step; so does a snake of pixels."""
    tables, real = [], graph.kept
    monkeypatch.setattr(graph, "kept", lambda df, name: tables.append(name) or real(df, name))
    px = spark.range(1000).selectExpr("id AS line", "0L AS sample", "true AS hit")
    number, _, part = graph.numbered((1000, 1))
    e = graph.grid_edges(px, "hit").select(number("src").alias("src"), number("dst").alias("dst"), F.col("step").alias("cost"))
    got = graph.cheapest(e, spark.createDataFrame([(0,)], "v long"), part)
    assert got.agg(F.max("cost"), F.count("*")).first()[:] == (999.0, 1000) and len(tables) <= 5
    tables.clear()
    labels = graph.components(px, "hit", sized=True).select("label", "size").distinct().collect()
    assert [(tuple(r.label), r.size) for r in labels] == [((0, 0), 1000)] and len(tables) <= 10


def test_no_way_on(spark):
    """A source without edges, none at all, and a part whose edges lead nowhere new."""
    e = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "src long, dst long, cost double")
    assert [tuple(r) for r in graph.cheapest(e, spark.createDataFrame([(7,)], "v long")).collect()] == [(7, 0.0, 0, 7)]
    assert graph.cheapest(e, spark.createDataFrame([(None,)], "v long")).collect() == []
    assert graph.cheapest(e.where("src > 5"), spark.createDataFrame([(7,)], "v long")).count() == 1
