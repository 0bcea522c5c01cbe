"""Operators on rasters with many lines: what they cost grows with the pixels."""

import math
import random
import re

from terrafold.operators import skyline, stencil
from terrafold.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_distance_frames(spark, monkeypatch):
    """No window looks from each row to its partition's end; groups of several lines give each line its own distances."""
    rng = random.Random(2)
    rows = [(a, b, rng.random() < 0.03) for a in range(40) for b in range(9)]
    df = spark.createDataFrame(rows, "line long, sample long, hit boolean")
    d = stencil.distance(df, (40, 9), "hit")
    assert "unboundedfollowing" not in d._jdf.queryExecution().toString().lower()
    hits = [r for r in rows if r[2]]
    want = {(a, b): min(math.hypot(a - x, b - y) for x, y, _ in hits) for a, b, _ in rows}
    for lines_of in (1, 27, 1 << 16):
        monkeypatch.setattr(stencil, "LINES_OF", lines_of)
        got = {(r.line, r.sample): r.distance for r in stencil.distance(df, (40, 9), "hit").collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    assert {r.distance for r in stencil.distance(df.withColumn("hit", df.hit & False), (40, 9), "hit").collect()} == {None}


def test_crests_meet_pixels(spark, monkeypatch):
    """Crests go only to segments that have pixels of their strip, and a profile of one segment sends none."""
    tables = {}
    real = skyline.staged
    monkeypatch.setattr(skyline, "staged", lambda df, name: tables.setdefault(name, real(df, name)) if name in ("points", "far") else real(df, name))
    df = spark.createDataFrame([(a, b, float((a * 7 + b * 5) % 11)) for a in range(150) for b in range(4)], "line long, sample long, z double")
    skyline.horizons(df, (150, 4), [0.0, 30.0, 90.0], (1.0, 1.0), segment=16)
    strips = lambda t: {(r.rot, r.prof // skyline.STRIP, r.seg) for r in tables[t].collect()}
    assert strips("far") and strips("far") <= strips("points")
    assert {r[0] for r in strips("far")} == {1, 2}


def test_tasks_grow_with_pixels(spark, monkeypatch):
    """Beyond PER_TASK pixels a task, stencils and the joins of their results are dealt to more tasks, with the same result."""
    px = spark.range(1000).selectExpr("id div 10 AS line", "id % 10 AS sample", "double(hash(id) % 97) AS z")
    assert stencil.tiled(px, (100, 10), 1).rdd.getNumPartitions() <= 4
    want = sorted(QUERIES["boulder_risk"](spark, SF).collect())
    monkeypatch.setattr(stencil, "PER_TASK", 60)
    assert stencil.tiled(px, (100, 10), 1).rdd.getNumPartitions() == 17
    got = QUERIES["boulder_risk"](spark, SF)
    assert sorted(got.collect()) == want
    deals = re.findall(r"hashpartitioning\(line#\d+L?, sample#\d+L?, (\d+)\)", got._jdf.queryExecution().executedPlan().toString())
    assert len(deals) >= 3 and set(deals) == {"17"}
