"""Raster views of tables: pixels of events, elements and complex looks of embeddings, samples of customers.

A raster is a table of pixels (line, sample, layers...); an absent value is null, never zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line, sample, z, lh, lv (channel amplitudes), measured, kind: one row for each event, WIDTH to a line."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.expr(f"event_id div {WIDTH}").alias("line"),
        F.expr(f"event_id % {WIDTH}").alias("sample"),
        F.col("value").alias("z"),
        F.sqrt("value").alias("lh"),
        F.sqrt(F.col("user_id") + 1.0).alias("lv"),
        (F.col("user_id") % 7 != 0).alias("measured"),
        F.col("event_type").alias("kind"),
    )


def shape(px: DataFrame) -> tuple[int, int]:
    """Lines and samples of a raster that starts at (0, 0)."""
    got = px.agg(F.max("line").alias("l"), F.max("sample").alias("s")).first()
    return ((got["l"] or 0) + 1, (got["s"] or 0) + 1)


def looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line, sample, re_h, im_h, re_v, im_v: four elements in a row are a complex look of two channels."""
    e = table(spark, sf_dir, "embeddings")
    one = F.expr("explode(transform(sequence(0, size(embedding) div 4 - 1), k -> struct(bigint(k) as sample, double(embedding[4 * k]) as re_h, double(embedding[4 * k + 1]) as im_h, double(embedding[4 * k + 2]) as re_v, double(embedding[4 * k + 3]) as im_v)))")
    return e.select(F.col("vec_id").alias("line"), one.alias("x")).select("line", "x.*")


def discs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, stratum, exposed, outcome, x: one row for each customer."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("stratum"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("exposed"), (F.col("c_acctbal") < 1000).alias("outcome"), (F.col("c_acctbal") / 1000).alias("x"))
