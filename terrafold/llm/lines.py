"""Operator 2, line deduplication by a segment-partition edit join.

Two lines within k edits share one of the k+1 segments that the shorter is split into, at a place that the lengths and
the segment's number bound. Lines are indexed by segment and probed by those substrings. A line goes if an earlier one is
near: first the earliest line of each of its segments is tried, then, for lines that it didn't settle, the others until
one is near, so that a group of many near lines costs no pair of all. Lines that share a frequent segment are split
again by what its lines don't all share. A banded bit-parallel edit distance on what common start and end leave decides.
DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import BROADCAST_ROWS, small, staged

#: Lines within so many edits are near duplicates; shorter lines have none.
EDITS, MIN_CHARS = 1, 20
#: What the query and the pipeline use, by length of the shorter line: an edit for every ten characters, three at most.
GRADED = [(10, 1), (20, 2), (30, 3)]
#: A line with a word.
WORDED = r"rlike(line, '[^\\x20\\x09-\\x0D]')"
#: A segment that more lines share is not joined but split further.
HOT = 1024


def moves(classes: list[tuple[int, int]]) -> list[tuple]:
    """k, lo, hi, i, shift, d, own: how a text probes for texts of length m = n - d from lo to hi, which are split into k+1 segments.

    Segment i (from 1) of a text of length m starts after (i-1)*m div (k+1) characters. A text's own segments are its
    probes at the same places, too.
    """
    found = []
    for (lo, k), (end, _) in zip(classes, [*classes[1:], (1 << 31, 0)], strict=True):
        for d in range(k + 1):
            for i in range(1, k + 2):
                for shift in range(max(1 - i, d - (k + 1 - i)), min(i - 1, d + (k + 1 - i)) + 1):
                    found.append((k, lo, end - 1, i, shift, d, d == 0 and shift == 0))
    return found


def probes(some: list[tuple]) -> str:
    """SQL array of those moves as structs."""
    return "array(" + ", ".join(f"struct({k} as k, {lo} as lo, {hi} as hi, {i} as i, {shift} as shift, {d} as d, {str(own).lower()} as own)" for k, lo, hi, i, shift, d, own in some) + ")"


def let(name: str, value: str, body: str) -> str:
    """SQL in which a name stands for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def keyed(lines: DataFrame, classes: list[tuple[int, int]], own: bool) -> DataFrame:
    """h, key, own, k: the keys of all probes of each line, or of its own segments only.

    Characters of four bytes each, so that a segment is found without counting; they are made once, ahead of the moves.
    """
    some = [m for m in moves(classes) if m[-1] or not own]
    rows = lines.select("h", F.explode(F.array(F.expr("encode(line, 'UTF-32')"))).alias("b")).select("h", "b", F.expr("int(octet_length(b) div 4)").alias("n"))
    rows = rows.select("h", "b", "n", F.expr(f"inline({probes(some)})")).where("n - d between lo and hi")
    start, end = "(n - d) * (i - 1) div (k + 1)", "(n - d) * i div (k + 1)"
    key = f"xxhash64(0L, i, n - d, substring(b, int(4 * ({start} + shift) + 1), int(4 * ({end} - ({start})))))"
    return rows.select("h", F.expr(key).alias("key"), "own", "k")


def segmented(rows: DataFrame, text: str, prior: str, rest: bool) -> DataFrame:
    """h, key, own, d, k[, m, rest] of rows that have n (the text's length) and the fields of probes().

    The rest is what stands before and behind a segment: where two texts within k edits share one, their rests are
    within k edits as well.
    """
    rows = rows.withColumn("__m", F.expr("n - d")).withColumn("__b", F.expr("int(__m * (i - 1) div (k + 1))"))
    rows = rows.withColumn("__s", F.expr("int(__m * i div (k + 1)) - __b")).withColumn("__b", F.expr("__b + shift"))
    more = ["__m - __s as m", f"concat(substring({text}, 1, __b), substring({text}, __b + __s + 1)) as rest"] if rest else []
    return rows.selectExpr("h", f"xxhash64({prior}, i, __m, encode(substring({text}, __b + 1, __s), 'UTF-32')) as key", "own", "d", "k", *more)


def of_lines(lines: DataFrame, classes: list[tuple[int, int]]) -> DataFrame:
    """h and the fields of segmented() with rests, for each line."""
    rows = lines.select("h", "line", F.length("line").alias("n")).select("h", "line", "n", F.expr(f"inline({probes(moves(classes))})"))
    return segmented(rows.where("n - d between lo and hi"), "line", "0L", True)


def of_rests(rests: DataFrame, classes: list[tuple[int, int]]) -> DataFrame:
    """The next level: h and the fields of segmented() for what the level before left."""
    rows = rests.selectExpr("h", "key", "rest", "length(rest) as n", "own as __own", "d as __d", "k as __k")
    rows = rows.select("*", F.expr(f"inline({probes(moves(classes))})")).where("k = __k and d = if(__own, 0, __d)").withColumn("own", F.expr("own and __own"))
    return segmented(rows, "rest", "key", True)


def stripped(rests: DataFrame) -> DataFrame:
    """rests without what all of a key's rests start and end with, which changes no distance; and tight: what is left is too short to be split."""
    ends = rests.groupBy("key").agg(F.min("rest").alias("a"), F.max("rest").alias("b"), F.min(F.reverse("rest")).alias("c"), F.max(F.reverse("rest")).alias("e"), F.min(F.length("rest")).alias("n"))
    front = common("a", "b", "n", lambda s, m: f"substring({s}, 1, {m})")
    back = common("c", "e", "(n - p)", lambda s, m: f"substring({s}, 1, {m})")
    ends = ends.withColumn("p", F.expr(front)).select("key", "p", "n", F.expr(back).alias("q"))
    out = rests.join(ends, "key").withColumn("rest", F.expr("substring(rest, p + 1, length(rest) - p - q)"))
    return out.withColumn("tight", F.expr("n - p - q <= k")).drop("p", "q", "n")


def sought(lines: DataFrame, classes: list[tuple[int, int]], n: int) -> DataFrame:
    """h, key, own, k of each line's keys, but for probes for what is no text's own segment; n: own segments, about. Lossless: a bit for each own key's hash, some eight bits a key.

    Beyond BROADCAST_ROWS groups of bits, more keys share a bit and more rows stay.
    """
    groups, words = min(BROADCAST_ROWS, 8 * n // 1024 + 1), range(16)
    at = F.expr(f"pmod(key, {groups * 1024}L)").alias("__p")
    cell = [F.expr("__p div 1024").alias("__g"), F.expr("int(__p div 64 % 16)").alias("__w"), F.expr("int(__p % 64)").alias("__bit")]
    own = keyed(lines, classes, True).select(at).select(*cell)
    bits = own.groupBy("__g").agg(*[F.bit_or(F.expr(f"if(__w = {w}, shiftleft(1L, __bit), 0L)")).alias(f"__w{w}") for w in words])
    word = "case __w " + " ".join(f"when {w} then __w{w}" for w in words) + " end"
    rows = keyed(lines, classes, False)
    kept = rows.withColumn("__p", at).select(*rows.columns, *cell).join(F.broadcast(bits), "__g")
    return kept.where(f"own or shiftright({word}, __bit) & 1L = 1L").select(*rows.columns)


def common(a: str, b: str, room: str, cut) -> str:
    """SQL for how many characters of at most room two texts share, by bisection; cut: SQL for so many of a text's characters."""
    mid = "((s.lo + s.hi + 1) div 2)"
    step = f"if({cut(a, mid)} = {cut(b, mid)}, struct(int({mid}) as lo, s.hi as hi), struct(s.lo as lo, int({mid} - 1) as hi))"
    return f"aggregate(sequence(0, int(ceil(log2({room} + 1)))), struct(0 as lo, int({room}) as hi), (s, i) -> {step}, s -> s.lo)"


def near(x: str, y: str, k: int) -> str:
    """SQL: two texts are at most k edits apart, by banded bit vectors over what common start and end leave; where that is k characters at most, they are."""
    if k > 14:
        raise ValueError("a band of more than 30 bits")
    longer = f"greatest(length({x}), length({y})) - cp - cq <= {k}"
    rest = lambda s: f"split(concat(repeat('a', {k + 1}), substring({s}, cp + 1, length({s}) - cp - cq)), '')"
    # The pattern is padded by k on either side; too short a pattern gets equal characters in front.
    w = 2 * k + 2
    full, top = (1 << w) - 1, 1 << (w - 1)
    match = " | ".join(f"if(get(cu, s.i - {k + 1 - b}) = c, {1 << b}, 0)" for b in range(w))
    d0 = f"(((((m & s.vp) + s.vp) ^ s.vp) | m | s.vn) & {full})"
    hp, hn = f"((s.vn | ~(d | s.vp)) & {full})", "(d & s.vp)"
    # Along the diagonal until the pattern ends, then along its last row.
    low = f"shiftright({top >> 1}, greatest(0, s.i - size(cu) + {k}))"
    dist = f"s.e + if(s.i < size(cu) - {k}, if((d & {top}) <> 0, 0, 1), if(({hp} & {low}) <> 0, 1, 0) - if(({hn} & {low}) <> 0, 1, 0))"
    state = f"struct(({hn} | ~(shiftright(d, 1) | {hp})) & {full} as vp, shiftright(d, 1) & {hp} as vn, {dist} as e, s.i + 1 as i)"
    start = f"struct({((1 << (k + 1)) - 1) << (w - k - 1)} as vp, 0 as vn, {k} as e, 0 as i)"
    # Along the diagonal the distance never falls, and along the last row, 2 * k places at most, by one at a place: beyond 3 * k nothing is left to see.
    edits = f"aggregate(cv, {start}, (s, c) -> if(s.e > {3 * k}, s, {let('m', match, let('d', d0, state))}), s -> s.e)"
    banded = "false" if k == 1 else let("cu", rest(x), let("cv", rest(y), f"coalesce(abs(size(cu) - size(cv)) <= {k} and {edits} <= {k}, false)"))
    back = common(x, y, "(cn - cp)", lambda s, m: f"right({s}, int({m}))")
    return let("cn", f"least(length({x}), length({y}))", let("cp", common(x, y, "cn", lambda s, m: f"substring({s}, 1, {m})"), let("cq", back, f"({longer}) or {banded}")))


def within(pairs: DataFrame, k: int) -> DataFrame:
    """The other columns of rows whose columns x and y are different and at most k edits apart."""
    return pairs.where("x <> y").where(near("x", "y", k)).drop("x", "y")


#: One bit for each character (by its code, modulo 64) that a line has an odd number of times: k edits change 2 * k bits at most.
PARITY = "aggregate(split(line, ''), 0L, (s, c) -> s ^ shiftleft(1L, ascii(c)))"


def earlier_near(x: str, y: str, ks: list[int]) -> str:
    """SQL: row y is earlier than row x and near to it; cheap tests that near lines always pass come first."""
    cases = " ".join(f"when {k} then {near(f'{x}.line', f'{y}.line', k)}" for k in ks)
    return f"{y}.first < {x}.first and bit_count({x}.odd ^ {y}.odd) <= 2 * {x}.k and case {x}.k {cases} end"


def exploded(docs: DataFrame, min_chars: int, short: bool, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """row, at (null ids last, doc_id, line number), no, line, h (128 bits): one row for each line of at least min_chars characters; short: and for shorter ones with a word."""
    # Numbered first: beside posexplode, the id would count lines.
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    d = d.select("row", "doc", F.posexplode(F.split("__t", "\n", -1)).alias("no", "line"))
    d = d.where(F.expr(f"length(line) >= {min_chars} or {short} and {WORDED}"))
    return d.select("row", "no", F.struct(F.col("doc").isNull().alias("none"), "doc", "no", "row").alias("at"), "line", F.struct(F.xxhash64("line"), F.xxhash64("line", F.lit(1))).alias("h"))


def near_lines(lines: DataFrame, firsts: DataFrame, classes: list[tuple[int, int]], n: int) -> DataFrame:
    """h of each line that has an earlier line within k edits; n: different lines, about. firsts: h and first, where a line first stands.

    classes has (length, k) by length: k holds where the shorter line has that length or more, up to the next one's.

    Of each key the earliest line, and the earliest that has it as its own segment, are compared with all others. Lines
    that no such line settles are compared with the key's other lines until an earlier one is near. A key that more than
    HOT lines have on both sides is not compared further but split: what its lines have besides the shared segment, and
    besides what they all start and end with, is split into segments in turn, until keys are rare or rests are short.
    """
    ks, level, found, texts = sorted({k for _, k in classes}), 0, [], None
    rows = sought(lines, classes, n * (classes[-1][1] + 1)) if ks[-1] > 1 else keyed(lines, classes, False)
    while True:
        # Equal lines collapse before the shuffle: a line gives each of its keys once.
        m = F.min("m") if level else F.lit(1 << 30)
        keys = staged(rows.groupBy("key", "h").agg(F.max("own").alias("own"), F.max("k").alias("k"), m.alias("m")), "keys")
        busy = keys.groupBy("key").agg(F.count("*").alias("n"), F.count_if("own").alias("owned"), F.max("k").alias("k"), F.min("m").alias("m")).where("n > 1 and owned > 0")
        met = keys.drop("m").join(small(staged(busy.select("key", F.expr(f"owned > {HOT} and n > {HOT} and m > k").alias("hot"), "n", "owned"), "busy")), "key")
        if texts is None:
            met = staged(met, "met")
            ends = small(staged(met.select("h").distinct(), "ends"))
            texts = lines.select("h", "line").join(ends, "h", "left_semi").groupBy("h").agg(F.first("line").alias("line"))
            texts = staged(texts.join(firsts.select("h", "first"), "h").select("h", "line", "first", F.expr(PARITY).alias("odd")), "texts")
        met = staged(met.join(texts, "h"), "lines")
        one = F.struct("first", "h", "line", "odd")
        heads = met.groupBy("key").agg(F.min(F.when(F.col("own"), one)).alias("o"), F.min(one).alias("p"))
        tried = met.join(heads, "key").select("h", "k", "first", "line", "odd", F.explode(F.expr("array(o, if(own, p, null))")).alias("y")).where("y.first < first")
        tried = tried.select("k", F.struct("h", "line", "first", "odd", "k").alias("x"), "y", F.xxhash64("h", "y.h").alias("pair")).dropDuplicates(["pair"])
        found.append(staged(tried.where(earlier_near("x", "y", ks)).select("x.h").distinct(), "near"))
        open_ = met.join(small(found[-1]), "h", "left_anti")
        found.append(staged(others(open_.where("not hot"), met.where("not hot"), ks), "near"))
        hot = small(staged(open_.where("hot").select("key").distinct(), "hot"))
        if not hot.limit(1).count():
            break
        rests = staged(stripped((of_lines(texts, classes) if level == 0 else rows).join(hot, "key", "left_semi")), "rests")
        tight = small(staged(rests.where("tight").select("key").distinct(), "tight"))
        found.append(staged(others(open_.where("hot").join(tight, "key", "left_semi"), met.where("hot").join(tight, "key", "left_semi"), ks), "near"))
        known = reduce(DataFrame.unionByName, found).distinct()
        wanted = open_.where("hot").select("key", "h").join(known, "h", "left_anti").select("key").distinct()
        rows = staged(of_rests(rests.where("not tight").join(wanted, "key", "left_semi"), classes), "rows")
        level += 1
    return reduce(DataFrame.unionByName, found).distinct()


def others(asking: DataFrame, known: DataFrame, ks: list[int]) -> DataFrame:
    """h of the rows that share a key with an earlier near one, which has it as its own segment, or has it where they have it as theirs. A row's search ends where one is found."""
    x, known = asking.where("n > 2").alias("x"), known.where("n > 2")  # of two lines, one is the earliest, which was tried
    by_own = x.where("owned > 1").join(known.where("own and owned > 1").alias("y"), F.expr(f"x.key = y.key and {earlier_near('x', 'y', ks)}"), "left_semi")
    as_own = x.where("own").join(known.where("not own").alias("y"), F.expr(f"x.key = y.key and {earlier_near('x', 'y', ks)}"), "left_semi")
    return by_own.select("h").unionByName(as_own.select("h")).distinct()


def removals(docs: DataFrame, k: int | list[tuple[int, int]] = EDITS, min_chars: int = MIN_CHARS, text: str = "text", doc: str = "doc_id", short: bool = False) -> DataFrame:
    """row, n_exact, n_near, gone (line numbers): what each row of docs loses; rows that lose nothing and repeat nothing are absent. docs must give its rows in the same order each time, as files do.

    k: edits, or (length, edits) by length of the shorter line, which replaces min_chars; see near_lines.
    short: shorter lines with a word go where they repeat an earlier one; equality needs no edit join.
    """
    classes = [(min_chars, k)] if isinstance(k, int) else k
    min_chars = classes[0][0]
    if any(least <= edits for least, edits in classes):
        raise ValueError("lines need a character for each segment")
    lines = exploded(docs, min_chars, short, text, doc)
    firsts = staged(lines.groupBy("h").agg(F.min("at").alias("first"), F.count("*").alias("copies")), "firsts")
    near = staged(near_lines(lines.where(F.length("line") >= min_chars), firsts, classes, firsts.count()), "near").withColumn("near", F.lit(True))
    known = firsts.join(near, "h", "left").where("copies > 1 or near").withColumn("near", F.coalesce("near", F.lit(False)))
    hit = lines.select("row", "no", "at", "h").join(small(staged(known.select("h", "first", "near"), "known")), "h")
    exact = F.col("at") != F.col("first")
    return hit.groupBy("row").agg(
        F.sum(exact.cast("long")).alias("n_exact"),
        F.sum((~exact & F.col("near")).cast("long")).alias("n_near"),
        F.collect_list(F.when(exact | F.col("near"), F.col("no"))).alias("gone"),
    )


def with_kept(docs: DataFrame, k: int | list[tuple[int, int]] = EDITS, min_chars: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """docs as a struct __row, with __kept (the text without its removed lines), n_lines, n_exact, n_near."""
    cut = removals(docs, k, min_chars, short=short)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs["text"].alias("__text"), F.monotonically_increasing_id().alias("row"))
    j = rows.join(cut, "row", "left").withColumn("__l", F.split("__text", "\n", -1))
    kept = F.expr("if(gone is null or size(gone) = 0, __text, array_join(transform(array_except(sequence(0, size(__l) - 1), gone), i -> __l[i]), '\\n'))")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return j.select("__row", kept.alias("__kept"), zero("n_exact"), zero("n_near"), F.when(F.coalesce("__text", F.lit("")) == "", 0).otherwise(F.size("__l")).cast("long").alias("n_lines"))


def line_table(docs: DataFrame, k: int | list[tuple[int, int]] = EDITS, min_chars: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """doc_id, n_lines, n_exact, n_near, kept_sha256 (of the kept lines in UTF-8; null text: empty) for each row of docs.

    A line of at least min_chars characters goes if an equal one stands earlier (n_exact), or if its first copy and an
    earlier line are within k edits of each other (n_near); earlier is by doc_id, then line number; null ids come
    last, repeated ids by row. short: shorter lines with a word go if an equal one stands earlier.
    """
    t = with_kept(docs, k, min_chars, short)
    return t.select("__row.doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.coalesce("__kept", F.lit("")), 256).alias("kept_sha256"))


def dedup_lines(docs: DataFrame, k: int | list[tuple[int, int]] = EDITS, min_chars: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """docs, with all columns, whose texts lack the lines that stand elsewhere before; rows that lose all they had go.

    short: see line_table. Where there is a column n_chars, it is counted again for changed texts.
    """
    t = with_kept(docs, k, min_chars, short).where(r"n_exact + n_near = 0 or __kept rlike '[^\\x20\\x09-\\x0D]'")
    new = {"text": F.col("__kept"), "n_chars": F.when(F.col("n_exact") + F.col("n_near") > 0, F.length("__kept").cast(dict(docs.dtypes).get("n_chars", "long"))).otherwise(F.col("__row.n_chars") if "n_chars" in docs.columns else None)}
    return t.select(*[new[c].alias(c) if c in new else F.col(f"__row.`{c}`") for c in docs.columns])
