"""The corpus operators' queries: each applies its operator, with production parameters, to its whole table.

All take null and repeated ids, null and empty texts, empty tables (no row comes back) and further columns, whatever
their names; the operators' docstrings say what such rows get.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrafold.llm import clusters, decontam, divergence, licenses, lines, mixing, neardup, packing, quality, sql, suffixes, urls, warc, wrappers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens. Null and empty texts are one end token; see packing.pack."""
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), added=True)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that each document loses, and the digest of what it keeps; nulls, ties and repeated rows as in lines.line_table."""
    return lines.line_table(_table(spark, sf_dir, "documents"), lines.GRADED, short=True)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that each document loses to strings of 50 bytes in documents with smaller ids; see suffixes.remove_repeats."""
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents with 85 % of their three-word shingles in common; see neardup.near_duplicates."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), k=3, num=85, den=100)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of each document, whether the base rules fail, and its host's verdict; see quality.quality_table."""
    return quality.quality_table(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages hold when they are read back; see warc.archived."""
    return warc.archived(_table(spark, sf_dir, "pages"))


def op7_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page; empty for null and empty html; see wrappers.extract."""
    return wrappers.extract(_table(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases, labels and the share of words inside them, for each document; see licenses.scan."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside the benchmark's windows, and the items they are of; see decontam.per_document."""
    return decontam.digest_table(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's rule, and its verdict by rule or model; see urls.filter_urls."""
    return urls.filter_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source's terms are from its language's other sources, and the terms that lead in it; see divergence.divergences."""
    return divergence.divergences(_table(spark, sf_dir, "documents"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of each whole vector after ten rounds; see clusters.clustered."""
    return clusters.clustered(_table(spark, sf_dir, "embeddings"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; see mixing.mix."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pattern_packing, op2_line_dedup, op3_suffix_dedup, op4_minhash_near_dedup, op5_quality_rules,
        op6_warc, op7_wrapper_text, op8_license_scan, op9_decontaminate, op10_url_filter,
        op11_source_divergence, op12_centroid_clusters, op13_source_mix,
    )
}
SQL: dict[str, str] = sql.ALL
