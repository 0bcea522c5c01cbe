"""Exact order statistics for any distribution, without one task that orders everything.

Different values are counted first and written once. A table of few (SMALL, counted) is ordered by group; a larger one in
ranges that Spark cuts at sampled values, so that a range holds its share however values lie, and is ordered range by
range after the counts of the ranges before it. Null and NaN (a raster's mark of absence) are no values; infinities are
values at the ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.shared import staged

#: Different values that are ordered without ranges; values in a range, about; rows of a table that is broadcast.
SMALL, RANGE, BROADCAST_ROWS = 200_000, 1_000_000, 200_000


def small(df: DataFrame) -> DataFrame:
    """df, staged, with a broadcast hint where its counted rows are few."""
    df = staged(df, "counts")
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def ranked(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """by, _v, _n, _below, _all: each different value, how often it stands, how many smaller ones there are, and how many in all."""
    by = by or []
    known = df.where(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double")).where("not isnan(_v)")
    v = staged(known.groupBy(*by, "_v").agg(F.count("*").alias("_n")), "values")
    n, group = v.count(), by or [F.lit(0)]
    if n <= SMALL:
        w = Window.partitionBy(*group)
        upto = F.sum("_n").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return v.select(*by, "_v", "_n", (upto - F.col("_n")).alias("_below"), F.sum("_n").over(w).alias("_all"))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE))
    v = staged(v.repartitionByRange(parts, *by, "_v").withColumn("_part", F.spark_partition_id()), "ranges")
    w = Window.partitionBy(*group)  # a row for each range that a group meets
    sums = v.groupBy(*by, "_part").agg(F.sum("_n").alias("_c"))
    sums = sums.select(*by, "_part", (F.sum("_c").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_c")).alias("_before"), F.sum("_c").over(w).alias("_all"))
    # A group of null is a group, too.
    keys = [F.col(f"s.{c}").eqNullSafe(F.col(f"v.{c}")) for c in [*by, "_part"]]
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    j = v.alias("v").join(small(sums).alias("s"), on).select(*[F.col(f"v.{c}").alias(c) for c in v.columns], "_before", "_all")
    upto = F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return j.select(*by, "_v", "_n", (upto - F.col("_n") + F.col("_before")).alias("_below"), "_all")


def quantiles(df: DataFrame, value: str, qs: list[float], by: list[str] | None = None) -> DataFrame:
    """by, q, value: exact quantiles, between two values interpolated linearly; a group without values has none."""
    by = by or []
    at = F.explode(F.expr(f"array({', '.join(f'{float(x)!r}D' for x in qs)})")).alias("_q")
    got = ranked(df, value, by).select(*by, "_v", "_n", "_below", "_all", at).withColumn("_r", F.expr("(_all - 1) * _q"))
    got = got.where("floor(_r) between _below and _below + _n - 1 or ceil(_r) between _below and _below + _n - 1")
    got = got.groupBy(*by, "_q").agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.first("_r").alias("_r"))
    # Two equal ends, infinite ones too, are their value.
    return got.select(*by, F.col("_q").alias("q"), F.expr("if(_a = _b, _a, _a + (_b - _a) * (_r - floor(_r)))").alias("value"))


def wide(q: DataFrame, names: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """quantiles() with a column for each name, rounded to six places."""
    cols = [(F.round(F.max(F.when(F.col("q") == x, F.col("value"))), 6) + F.lit(0.0)).alias(n) for n, x in names.items()]
    return q.groupBy(*by).agg(*cols) if by else q.agg(*cols)


def numbered(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the place, from 1, of each row by a value that tells rows apart; rows without a value are left out."""
    r = ranked(df, value).select("_v", (F.col("_below") + 1).alias(name))
    return df.join(r, F.col(value).cast("double") == F.col("_v")).drop("_v")


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the average rank of each row's value; rows without a value are left out."""
    r = ranked(df, value).select("_v", (F.col("_below") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(r, F.col(value).cast("double") == F.col("_v")).drop("_v")
