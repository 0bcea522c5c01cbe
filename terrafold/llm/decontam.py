"""Operator 9, benchmark decontamination.

The benchmark's word windows form a hash table with a checked size, which is broadcast; every window of every document
is looked up in it by a 64-bit hash, hits are verified word by word, and spans or documents are removed.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import ALNUM_WORD, ascii_lower, small, staged

WINDOW = 10
#: Broadcast bound: more benchmark windows than this are joined by a shuffle instead.
MAX_BROADCAST_WINDOWS = 500_000


def words_of(text: str = "__t") -> str:
    return f"regexp_extract_all({ascii_lower(text)}, '{ALNUM_WORD}', 0)".replace("\\", "\\\\")


def windows_sql(hashes: str, n: int) -> str:
    """An array of longs, one for each run of n words: the hash of n and the words' hashes."""
    one = ", ".join(f"{hashes}[i + {k}]" for k in range(n))  # not slice(), which copies the whole array each time
    return f"if(size({hashes}) < {n}, array(), transform(sequence(0, size({hashes}) - {n}), i -> xxhash64({n}, {one})))"


def benchmark_windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """h, size, words, items (ids of the items that hold the window), one row for each distinct window.

    An item of fewer words, but not none, is one window. Items with null or empty text have none.
    """
    w = bench.select("item_id", F.coalesce("text", F.lit("")).alias("__t")).select("item_id", F.expr(words_of()).alias("w")).where("size(w) > 0")
    w = w.select("item_id", "w", F.expr(f"explode(transform(sequence(0, greatest(size(w) - {window}, 0)), i -> slice(w, i + 1, {window})))").alias("words"))
    return (
        w.groupBy("words")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
        .select(F.expr("xxhash64(size(words), transform(words, x -> xxhash64(x)))").alias("h"), F.size("words").alias("size"), "words", "items")
    )


def hits(docs: DataFrame, bench: DataFrame, keep: list[str], text: str = "text", window: int = WINDOW) -> DataFrame:
    """keep (the first of them tells rows apart), n_words and each verified hit (pos, size, items); one row with pos -1 for every row of docs besides."""
    spark = docs.sparkSession
    table = staged(benchmark_windows(bench, window), "windows")
    sizes = sorted(r[0] for r in table.select("size").distinct().collect())  # at most `window` values
    named = lambda t: t.select(F.col("h").alias("b_h"), F.col("size").alias("b_size"), "words", "items")
    d = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__t")).select(*keep, F.expr(words_of()).alias("__w"))
    d = d.select(*keep, "__w", F.expr("transform(__w, x -> xxhash64(x))").alias("__h"))
    looked = ", ".join(["array(0L)", *[windows_sql("__h", n) for n in sizes if n]])
    d = d.select(*keep, "__w", F.expr(f"concat({looked})").alias("__l"))
    # Place 0 always hits; then come the windows of each size in turn.
    pos, before = "case b_size when 0 then -1", "1"
    for n in sizes:
        if n:
            pos, before = f"{pos} when {n} then __i - ({before})", f"{before} + greatest(0, size(__w) - {n - 1})"
    same = " and ".join(f"(b_size <= {k} or get(__w, pos + {k}) = get(words, {k}))" for k in range(window))
    out = [*keep, F.size("__w").cast("long").alias("n_words"), "pos", F.col("b_size").alias("size"), "items"]
    if table.count() <= MAX_BROADCAST_WINDOWS:
        always = spark.range(1).select(F.lit(0).cast("long").alias("h"), F.lit(0).alias("size"), F.expr("cast(array() as array<string>)").alias("words"), F.array().cast(table.schema["items"].dataType).alias("items"))
        # outer: so no filter on the array is pushed below, where the array would be made again
        d = d.select(*keep, "__w", F.posexplode_outer("__l").alias("__i", "__h"))
        found = d.join(F.broadcast(named(table.unionByName(always))), F.col("__h") == F.col("b_h")).withColumn("pos", F.expr(f"{pos} end"))
        return found.where(f"b_size = 0 and __i = 0 or b_size > 0 and pos >= 0 and {same}").select(*out)
    # Beyond a broadcast, only rows, places and hashes are shuffled; words are compared where a hash is found, by a second join.
    row = keep[0]
    looks = d.select(row, F.posexplode("__l").alias("__i", "__h")).where("__i > 0")
    at = looks.join(table.select(F.col("h").alias("__h")).distinct(), "__h").groupBy(row).agg(F.collect_list(F.struct("__i", "__h")).alias("__x"))  # a text's own hits
    met = d.join(staged(at, "hits"), row).select(*keep, "__w", F.explode("__x").alias("__x")).select(*keep, "__w", "__x.*")
    found = met.join(named(table), F.col("__h") == F.col("b_h")).withColumn("pos", F.expr(f"{pos} end")).where(f"pos >= 0 and {same}")
    every = d.select(*keep, F.size("__w").cast("long").alias("n_words"), F.lit(-1).alias("pos"), F.lit(0).alias("size"), F.array().cast(table.schema["items"].dataType).alias("items"))
    return every.unionByName(found.select(*out))


#: Words inside any of the sorted (start, end) hits.
COVERED = "aggregate({s}, struct(0L as n, 0L as upto), (a, x) -> struct(a.n + greatest(0L, x.e - greatest(x.b, a.upto)) as n, greatest(a.upto, x.e) as upto), a -> a.n)"


def per_document(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids, contaminated for each row of docs, also repeated rows and null ids.

    Null and empty texts have no words and no hit. An empty benchmark contaminates nothing.
    """
    rows = docs.select("doc_id", "text").withColumn("__row", F.monotonically_increasing_id())
    hit = hits(rows, bench, ["__row", "doc_id"], window=window)
    out = hit.groupBy("__row").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set(F.expr("if(pos < 0, null, struct(bigint(pos) as b, bigint(pos + size) as e))"))).alias("__s"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"),
    )
    return out.select(
        "doc_id",
        "n_words",
        F.expr(COVERED.format(s="__s")).alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        "item_ids",
        (F.size("__s") > 0).alias("contaminated"),
    )


def digest_table(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """per_document with its items as the SHA-256 of their comma-joined, string-sorted ids."""
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return per_document(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def decontaminate(docs: DataFrame, bench: DataFrame, remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """docs without what the benchmark holds; all columns stay.

    remove="documents" drops rows with a hit. remove="spans" cuts the hit words, with what separates them, out of the
    text; texts without a hit stay as they are, null included. Rows are matched by position, not id, so null and
    repeated ids are safe.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove!r}")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs["text"].alias("__text"), F.monotonically_increasing_id().alias("__id"))
    spans = (
        hits(rows, bench, ["__id"], "__text", window)
        .where("pos >= 0")
        .groupBy("__id")
        .agg(F.array_sort(F.collect_set(F.expr("struct(pos as b, pos + size as e)"))).alias("__s"))
    )
    spans = small(staged(spans, "spans"))
    if remove == "documents":
        return rows.join(spans, "__id", "left_anti").select("__row.*")
    cut = rows.join(spans, "__id", "left")
    piece = "regexp_extract_all(__text, '" + f"[^A-Za-z0-9\\x80-\\x{{10FFFF}}]*[A-Za-z0-9\\x80-\\x{{10FFFF}}]+|[^A-Za-z0-9\\x80-\\x{{10FFFF}}]+$".replace("\\", "\\\\") + "', 0)"
    cut = cut.withColumn("__p", F.expr(f"if(__s is null, null, {piece})"))
    cut = cut.withColumn("__c", F.expr("if(__s is null, null, flatten(transform(__s, x -> sequence(x.b, x.e - 1))))"))
    cut = cut.withColumn("__k", F.expr("if(__s is null, __text, array_join(transform(array_except(sequence(0, size(__p) - 1), __c), i -> __p[i]), ''))"))
    kept = [F.col("__k").alias(c) if c == "text" else F.col(f"__row.`{c}`") for c in docs.columns]
    return cut.select(*kept)
