"""Every query that SQL can express against DuckDB, on the smallest tables; the others against what must hold."""

import glob
import heapq
import math
import os

import duckdb
import pytest

from terrafold.functions import radar
from terrafold.operators import graph, stencil
from terrafold.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    return v if isinstance(v, (bool, str)) or hasattr(v, "year") else float(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    rel = db.sql(registry.SQL[name])
    assert sorted(rel.columns) == names
    want = sorted((tuple(plain(r[rel.columns.index(c)]) for c in names) for r in rel.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=str) == want


def test_ratio_tail(spark):
    rows = spark.createDataFrame([(14, 1 / 0.7, 0.1754492519), (5, 2.978, 0.0500118)], "n int, x double, want double")
    for r in rows.select(radar.ratio_tail("n", "x").alias("got"), "want").collect():
        assert r.got == pytest.approx(r.want, abs=1e-7)


def test_looks(spark):
    # trigamma(1) is pi**2 / 6, and trigamma(n + 1) is trigamma(n) - 1 / n**2.
    rows = [(n, 2 * (math.pi**2 / 6 - sum(1 / k**2 for k in range(1, n)))) for n in (1, 2, 5, 14)]
    for r in spark.createDataFrame(rows, "n int, v double").select("n", radar.looks_of("v").alias("got")).collect():
        assert r.got == pytest.approx(r.n, rel=1e-6)
    assert spark.sql("SELECT CAST(NULL AS DOUBLE) AS v").select(radar.looks_of("v")).first()[0] is None


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(-85.0, 10.0), (-89.9, -170.0), (-60.0, 179.0)], "la double, lo double")
    x, y = radar.stereographic("la", "lo")
    lat, lon = radar.geographic("x", "y")
    for r in df.withColumn("x", x).withColumn("y", y).select("la", "lo", lat.alias("a"), lon.alias("b")).collect():
        assert (r.a, r.b) == (pytest.approx(r.la), pytest.approx(r.lo))


def test_tiles_change_nothing(spark, monkeypatch):
    from pyspark.sql import functions as F

    px = spark.range(35 * 41).selectExpr("id div 41 AS line", "id % 41 AS sample", "double(hash(id) % 97) AS z")
    for rule in ("reflect", "mirror", "nearest", "valid"):
        whole = sorted(stencil.box(px, (35, 41), 5, {"s": F.col("z")}, rule).collect())
        monkeypatch.setattr(stencil, "EDGE", 8)
        assert sorted(stencil.box(px, (35, 41), 5, {"s": F.col("z")}, rule).collect()) == whole
        monkeypatch.undo()


def test_cheapest(spark):
    import random

    rng = random.Random(2)
    edges = [(rng.randrange(30), rng.randrange(30), rng.randrange(1, 20)) for _ in range(90)]
    best, heap = {}, [(0.0, 0)]
    while heap:
        c, v = heapq.heappop(heap)
        if v not in best:
            best[v] = c
            for a, b, w in edges:
                if a == v:
                    heapq.heappush(heap, (c + w, b))
    e = spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src long, dst long, cost double")
    got = graph.cheapest(e, spark.createDataFrame([(0,)], "v long"))
    assert {r.v: r.cost for r in got.collect()} == best


def test_logistic(spark):
    from terrafold.plans.statistics import logistic

    df = spark.createDataFrame([(1, 0, 30), (0, 0, 70), (1, 1, 60), (0, 1, 40)], "y int, x int, n int").selectExpr("y", "x", "explode(sequence(1, n))")
    beta, _ = logistic(df, "y", ["x"])
    assert beta == [pytest.approx(math.log(3 / 7)), pytest.approx(math.log(60 / 40) - math.log(3 / 7))]


def test_simulations(spark):
    r = registry.QUERIES["look_sums"](spark, SF).first()
    assert abs(r.rate - 0.1754492519) < 5 * r.se
    b = registry.QUERIES["block_bootstrap"](spark, SF).first()
    assert b.low <= b.median <= b.high


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    from terrafold.streaming.windows import hourly_totals

    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = hourly_totals(stream).writeStream.format("memory").queryName("hourly_test").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(spark.table("hourly_test").collect()) == sorted(hourly_totals(table).collect())
