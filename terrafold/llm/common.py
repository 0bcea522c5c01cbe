"""What several corpus operators share: the shared folder, staged tables, size-checked broadcasts, word rules."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.shared import shared_dir, staged

__all__ = ["shared_dir", "staged", "small", "small_batches", "ascii_lower"]

#: A table is broadcast only when its rows were counted and are at most so many.
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words between white space; words of letters and digits (every character beyond ASCII counts as a letter).
SPACE_WORD, ALNUM_WORD = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (counted), else df, for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(text: str) -> str:
    """SQL that lower-cases A-Z alone; lower() does the same, faster, where all characters are ASCII."""
    return f"if(octet_length({text}) = char_length({text}), lower({text}), translate({text}, '{UPPER}', '{LOWER}'))"


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Within it, jobs send Python batches of at most so many bytes (or one row), whatever rows hold; the session's setting comes back afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, old) if old is not None else spark.conf.unset(key)
