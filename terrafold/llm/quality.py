"""Operator 5, host-level quality rules.

Every document is measured by word, symbol and repetition rules; failures are summed by host, each host's failure rate
is shrunk towards a beta prior that is fitted to all hosts, and the host's verdict is joined back to its documents.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import SPACE_WORD, small, staged

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Soft rules: mean word length in code points, symbols a word, share of lines that repeat an earlier one.
MEAN_WORD, MAX_SYMBOLS, MAX_DUP_LINES = (2.0, 15.0), 0.25, 0.5
#: Shrunk failure rates: from the first on, a host's documents that break a soft rule go; from the second on, all go.
SUSPECT_RATE, BLOCKED_RATE = 0.4, 0.9

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns in keep, FEATURES, base_failed and soft_failed, row by row.

    Null and empty texts have no words and fail the base rules. A word in several repeated 3-word windows counts once.
    No shuffle: windows are compared as 64-bit hashes within the row, and sorted only in texts that repeat one.
    """
    w = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    w = w.select(
        *keep,
        F.expr("regexp_count(__t, '[#*$%&|<>]')").cast("long").alias("n_symbols"),
        F.expr(r"filter(split(__t, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("__l"),
        F.regexp_extract_all("__t", F.lit(SPACE_WORD), F.lit(0)).alias("__w"),
    )
    w = w.select(
        *keep,
        "n_symbols",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.size("__l").alias("__n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.expr("if(size(__w) < 3, array(), transform(sequence(0, size(__w) - 3), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2])))").alias("__h"),
    )
    w = w.withColumn("__s", F.expr("if(size(array_distinct(__h)) = size(__h), array(), sort_array(transform(__h, (h, i) -> struct(h, i))))"))
    w = w.withColumn("__r", F.expr("array_sort(transform(filter(__s, (x, k) -> x.h = get(__s, k - 1).h or x.h = get(__s, k + 1).h), x -> x.i))"))
    w = w.withColumn(
        "n_repeat_words",
        F.expr("aggregate(transform(__r, (x, k) -> least(3, coalesce(get(__r, k + 1) - x, 3))), 0L, (a, x) -> a + x)"),
    )
    n = F.col("n_words")
    mean = F.col("word_chars") / F.greatest(n, F.lit(1))
    return w.select(
        *keep,
        *FEATURES,
        ((n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)).alias("base_failed"),
        (
            (mean < MEAN_WORD[0]) | (mean > MEAN_WORD[1]) | (F.col("n_symbols") > MAX_SYMBOLS * n) | (F.col("n_dup_lines") > MAX_DUP_LINES * F.col("__n_lines"))
        ).alias("soft_failed"),
    )


def host_verdicts(measured: DataFrame, host: str) -> DataFrame:
    """One row a host: host, n, failures, rate (posterior mean), verdict (ok, suspect or blocked).

    The prior's mean and strength come from the moments of all hosts' rates, summed in Spark; one row reaches the
    driver. Where hosts don't differ, or there is one host, the prior is worth as much as one document.
    """
    hosts = measured.groupBy(host).agg(F.count("*").alias("n"), F.sum((F.col("base_failed") | F.col("soft_failed")).cast("long")).alias("failures"))
    rate = F.col("failures") / F.col("n")
    got = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).first()
    m, v = got["m"] or 0.0, got["v"] or 0.0
    strength = max(1.0, m * (1 - m) / v - 1) if v > 0 else 1.0
    shrunk = (F.col("failures") + F.lit(m * strength)) / (F.col("n") + F.lit(strength))
    return hosts.withColumn("rate", shrunk).withColumn(
        "verdict", F.when(F.col("rate") >= BLOCKED_RATE, "blocked").when(F.col("rate") >= SUSPECT_RATE, "suspect").otherwise("ok")
    )


def judged(measured: DataFrame, verdicts: DataFrame, host: str) -> DataFrame:
    """measured with kept: false where the base rules fail, where the host is blocked, and where it is suspect and a soft rule fails."""
    bad = verdicts.where("verdict <> 'ok'").select(F.col(host).alias("__h"), F.col("verdict").alias("__v"))
    joined = measured.join(small(bad), F.col(host) == F.col("__h"), "left")
    lost = F.col("base_failed") | (F.coalesce("__v", F.lit("ok")) == "blocked") | ((F.coalesce("__v", F.lit("ok")) == "suspect") & F.col("soft_failed"))
    return joined.withColumn("kept", ~lost).drop("__h", "__v")


def quality_table(docs: DataFrame) -> DataFrame:
    """doc_id, FEATURES, base_failed, kept for each row of docs (doc_id, text, source; others are ignored).

    Repeated rows and null ids each keep their row; a null source is a host of its own. An empty table gives none.
    """
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("host"), "text")
    measured = staged(features(rows, ["doc_id", "host"]), "quality")
    return judged(measured, host_verdicts(measured, "host"), "host").select("doc_id", *FEATURES, "base_failed", "kept")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the rules and their hosts' verdicts keep.

    The measured rows are written once: hosts are summed from them, and Catalyst can't move the filter below the
    measures, where it would make the texts' word arrays anew for every window.
    """
    own, host = F.struct(*[docs[c] for c in docs.columns]).alias("__row"), F.coalesce(docs["source"], F.lit("")).alias("__host")
    measured = staged(features(docs.select(own, host, docs["text"].alias("__text")), ["__row", "__host"], "__text"), "quality")
    return judged(measured, host_verdicts(measured, "__host"), "__host").where("kept").select("__row.*")
