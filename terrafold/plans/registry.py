"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: DuckDB's view of the pixels, looks and discs that terrafold.sources.views makes.
PX = "(SELECT event_id // 100 AS line, event_id % 100 AS sample, value AS z, sqrt(value) AS lh, sqrt(user_id + 1.0) AS lv, user_id % 7 <> 0 AS measured, event_type AS kind FROM events)"
DISC = "(SELECT c_custkey AS id, c_nationkey AS stratum, c_mktsegment IN ('BUILDING', 'MACHINERY') AS exposed, c_acctbal < 1000 AS outcome, c_acctbal / 1000 AS x FROM customer)"
RATIOS = f"(SELECT *, 0.5 * pow(lh - lv, 2) / (0.5 * pow(lh + lv, 2) + 1e-8) AS cpr, least(1, abs(lh * lh - lv * lv) / (lh * lh + lv * lv + 1e-8)) AS dop FROM {PX})"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if that can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


from terrafold.plans import audits, channels, edges, frames, matrices, products, raster, resamples, shadows, spectral, statistics, studies  # noqa: E402, F401  they register their queries
