"""Windowed aggregates that run on tables and on streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_totals(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """event_type, hour, n, total in tumbling windows of an hour; on a stream, rows later than `late` are dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select("event_type", F.col("w.start").alias("hour"), "n", (F.round("total", 6) + F.lit(0.0)).alias("total"))
