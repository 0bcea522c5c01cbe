"""Operator 13, mixing sources to target weights by systematic sampling. DataFrame functions only.

Documents stand in one order, by source, then size. Within its source each one expects target / source size copies; the
prefix sum of expected copies, plus one random offset a source, passes an integer for every copy that is taken. In
order of size the taken words stay within about one longest document of the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm.common import SPACE_WORD, small, staged

#: Weights of the sources in their order, over and over; a target is at most so many times its source's size.
WEIGHTS, MOST = (5, 2, 1), 3
#: Expected copies are counted in 2**-30; the seed of the offsets.
UNIT, SEED = 1 << 30, "mix"


def numbered(df: DataFrame, *keys) -> DataFrame:
    """df with __at, each row's place (from 0) in the order of the keys; written once, in order, so that no task holds more than its part.

    Rows that are equal in all keys take their places in any order.
    """
    at = F.monotonically_increasing_id()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = df.withColumn("__tie", at)
    order = [*keys, F.col("__tie")]
    rows = staged(tie.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("__tie").withColumn("__id", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn("__part", F.expr("shiftright(__id, 33)"))
    # A row for each of the parts, whose number is fixed.
    before = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = before.withColumn("__before", F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("__part", F.coalesce("__before", F.lit(0)).alias("__before"))
    return rows.join(F.broadcast(before), "__part").withColumn("__at", F.expr("__before + __id - shiftleft(__part, 33)")).drop("__part", "__id", "__before")


def level(sources: DataFrame) -> float:
    """Words for a unit of weight (double) once what is above its bound is shared anew, until none is above.

    sources: weight, most, size. Each round sums over all sources; what it learns is one number.
    """
    found, total = None, sources.agg(F.sum("size")).first()[0] or 0
    while True:
        above = F.lit(False) if found is None else F.col("most") <= F.lit(found) * F.col("weight")
        r = sources.agg(F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        if not r[1]:
            return found or 0.0
        new = (total - r[0]) / r[1]
        if new == found:
            return found
        found = new


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies (and the columns in carry) for each row of docs (doc_id, text, source).

    Sources in order of code points, null last ('' is a source of its own), weigh as weights say, over and over, and share all words; no
    target is above most times its source's words. A null or empty text has size 0 and is taken for 0 words; a source
    without words has target 0. Rows are sampled one by one: repeated ones, and null ids, each have a place of their own.
    taken is size times copies; copies are at most `most`. Ties of size are in order of doc_id, so that reruns agree;
    rows that are equal in both are alike. An empty table gives no row; further columns are left alone.
    """
    sized = docs.select(docs["doc_id"], docs["source"], *[docs[c] for c in carry], F.coalesce(F.regexp_count(docs["text"], F.lit(SPACE_WORD)), F.lit(0)).cast("long").alias("size"))
    sized = staged(sized, "sized")
    totals = staged(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")), "totals")
    weight = f"element_at(array({', '.join(map(str, weights))}), int(__at % {len(weights)}) + 1)"
    sources = numbered(totals, F.col("source").asc_nulls_last()).withColumn("weight", F.expr(weight).cast("long")).withColumn("most", F.expr(f"{most} * size"))
    sources = staged(sources, "sources")
    target = F.least(F.col("most").cast("double"), F.lit(level(sources)) * F.col("weight"))
    # One offset for each source, a multiple of 2**-30 below 1.
    offset = F.expr(f"cast(conv(substring(sha2(concat('{seed}:', coalesce(concat('=', source), '')), 256), 1, 8), 16, 10) as long) % {UNIT}")
    sources = sources.select("source", F.col("size").alias("source_size"), target.alias("target"), offset.alias("u"))
    sources = sources.withColumn("each", F.expr(f"if(source_size = 0, 0L, cast(floor(target / source_size * {UNIT}D) as long))"))
    rows = numbered(sized, F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_last())
    firsts = rows.groupBy("source").agg(F.min("__at").alias("first"))
    sources = sources.join(firsts, sources["source"].eqNullSafe(firsts["source"])).select(sources["source"].alias("of"), "source_size", "target", "u", "each", "first")
    sources = small(staged(sources, "shares"))
    rows = rows.join(sources, F.col("source").eqNullSafe(F.col("of")))
    # Integers that r documents have passed: floor((r * each + u) / UNIT), whose products stay below 2**63.
    passed = lambda r: f"(({r}) div {UNIT} * each + (({r}) % {UNIT} * each + u) div {UNIT})"
    copies = F.expr(f"{passed('__at - first + 1')} - {passed('__at - first')}")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), *carry)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: every row of docs, with all columns, as many times as it is taken; see mix."""
    rows = staged(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), F.monotonically_increasing_id().alias("__n")), "rows")
    taken = mix(rows.select("__row.doc_id", "__row.text", "__row.source", "__n"), weights, most, seed, carry=("__n",)).where("copies > 0").select("__n", "copies")
    out = rows.join(taken, "__n").select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(*[F.col(f"__row.`{c}`") for c in docs.columns])
