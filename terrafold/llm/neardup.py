"""Operator 4, near duplicates by SetSketch registers.

A document is its set of word shingles; equal sets are one class. Each class gets SetSketch registers: exponentially
spaced, truncated minima, which merge by maximum and are equal about as often as the sets are similar. Bands of six
registers are the buckets.

1. Every class is estimated, by the joint likelihood of the registers, against a few hubs of its buckets. Estimates of
   FAMILY or more make families, which are wider than the classes sought.
2. A bucket that still holds several families is compared in blocks, by registers; what may be linked joins families.
   Now every pair that shares a bucket and may be linked is in one family.
3. The full sets go to their family's block, once, and are verified there. A family beyond a block's bounds is first
   verified against hubs; what is outside of its largest component then meets all of it, block by block.

Blocks return spanning links, no more than they have members, so no join carries pairs. Links are joined into
components by joins of root tables, from which a round takes the edges that it has settled.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm.arrowtext import U, chunks, mix, shingle_sets
from terrafold.llm.common import small, staged
from terrafold.operators.graph import connected

#: Base, rate and limit of the registers, which are 16 bits wide. A base near 1 keeps them locality-sensitive.
SKETCH_BASE, SKETCH_RATE, SKETCH_MAX = 1.001, 20.0, 65_535
ROWS = 6
#: Chance that a pair at the threshold meets in no bucket; the number of bands follows.
MISS = 1e-5
#: A pair may be linked if its estimate is within so many standard errors of the threshold.
MARGIN = 5.0
#: Estimates that make a family, at most.
FAMILY = 0.5
#: Kinds of hubs: of a bucket, one is hub; bands share kinds, so that a class meets few hubs more than once.
KINDS = 4
#: Classes of large families are verified against so many hubs first.
HUBS = 2
#: A block has about so many classes, and about so many shingles, at most.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20


def bands_for(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def sketches(sets: list[np.ndarray], m: int) -> np.ndarray:
    """A row of m registers for each set; the sets aren't empty."""
    flat, starts = (np.concatenate(sets) >> U(32)).astype(np.uint32), np.cumsum([0, *map(len, sets[:-1])])
    rng = np.random.default_rng(7)
    seeds, factors = rng.integers(0, 1 << 32, m, dtype=np.uint32), rng.integers(0, 1 << 32, m, dtype=np.uint32) | np.uint32(1)
    least, hashed = np.empty((len(sets), m), np.uint32), np.empty_like(flat)
    for j in range(m):
        np.bitwise_xor(flat, seeds[j], out=hashed)
        np.multiply(hashed, factors[j], out=hashed)
        least[:, j] = np.minimum.reduceat(hashed, starts)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / SKETCH_RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(SKETCH_BASE)), 0, SKETCH_MAX).astype(np.uint16)


def estimates(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of register rows a and b, of sets of n_a and n_b elements."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p = lambda x: -np.log(np.maximum(1 - np.maximum(x, 0) * (SKETCH_BASE - 1) / SKETCH_BASE, 1e-300)) / np.log(SKETCH_BASE)

    def likelihood(j):
        x, y = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        return more * np.log(x) + less * np.log(y) + same * np.log(np.maximum(1 - x - y, 1e-12))

    lo, hi = np.zeros(len(n_a)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one peak
        third = (hi - lo) / 3
        left = likelihood(lo + third) < likelihood(hi - third)
        lo, hi = np.where(left, lo + third, lo), np.where(left, hi, hi - third)
    return (lo + hi) / 2


def _sketch_batches(k: int, m: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("regs", pa.binary()), ("bands", pa.list_(pa.int64()))])
    weights = np.random.default_rng(11).integers(0, 1 << 63, ROWS, dtype=np.uint64) | U(1)

    def run(batches):
        for rows, data, offsets in chunks(batches):
            sets = shingle_sets(data, offsets, k)
            full = [i for i, s in enumerate(sets) if len(s)]
            regs = sketches([sets[i] for i in full], m) if full else np.zeros((0, m), np.uint16)
            values = mix((mix(regs.reshape(len(full), -1, ROWS).astype(np.uint64) + U(1)) * weights).sum(2)).view(np.int64)
            key, packed, bands = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            for i, r, v in zip(full, regs, values, strict=True):
                key[i], packed[i], bands[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), r.tobytes(), v
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(key, pa.binary()), pa.array(packed, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=schema)

    return run, "doc_id long, n_shingles long, key binary, regs binary, bands array<long>"


def _set_batches(k: int):
    """id, key, shingles of each text; a task's repeated rows once."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("shingles", pa.binary())])

    def run(batches):
        seen = set()
        for rows, data, offsets in chunks(batches):
            ids, keys, sets = [], [], []
            for i, s in zip(rows.column(0).to_pylist(), shingle_sets(data, offsets, k), strict=True):
                raw = s.tobytes()
                key = hashlib.blake2b(raw, digest_size=16).digest()
                if (i, key) not in seen:
                    seen.add((i, key))
                    ids.append(i)
                    keys.append(key)
                    sets.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], schema=schema)

    return run, "id long, key binary, shingles binary"


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _estimate_batches():
    def run(batches):
        for b in batches:
            if b.num_rows:
                n_a, n_b = b.column("n_a").to_numpy().astype(float), b.column("n_b").to_numpy().astype(float)
                yield b.select(["a", "b", "n_a", "n_b"]).append_column("est", pa.array(estimates(_registers(b.column("x")), _registers(b.column("y")), n_a, n_b)))

    return run, "a long, b long, n_a long, n_b long, est double"


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    few, many = (x, y) if len(x) < len(y) else (y, x)
    at = np.minimum(np.searchsorted(many, few), len(many) - 1)
    return int((many[at] == few).sum())


def _verify_batches(num: int, den: int):
    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = shared(x, y)
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run, "a long, b long"


class Forest:
    """Joins labels; keeps the pairs that joined two."""

    def __init__(self, labels: np.ndarray):
        _, self.of = np.unique(labels, return_inverse=True)
        self.a: list[int] = []
        self.b: list[int] = []

    def join(self, i: int, others: np.ndarray, ids: np.ndarray) -> None:
        for o in others:
            if self.of[i] != self.of[o]:
                self.of[self.of == self.of[o]] = self.of[i]
                self.a.append(int(min(ids[i], ids[o])))
                self.b.append(int(max(ids[i], ids[o])))

    def table(self) -> pa.Table:
        return pa.table({"a": pa.array(self.a, pa.int64()), "b": pa.array(self.b, pa.int64())})


def _sides(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A block's classes, once each, and which of them stand on its left and on its right."""
    table = table.combine_chunks()
    ids, side = table.column("rep").to_numpy(), table.column("side").to_numpy()
    _, first, where = np.unique(ids, return_index=True, return_inverse=True)
    left, right = (np.unique(where[side != s]) for s in (2, 1))
    return table.take(first), left, right


def _register_block(num: int, den: int, limit: float, spread: float):
    """Of a bucket's block: pairs, across families, that sizes and registers allow; as many as join what they can.

    The share of equal registers is near the estimate; only pairs within `spread` of the limit by it are estimated.
    """

    def run(table: pa.Table) -> pa.Table:
        table, left, right = _sides(table)
        ids, n, regs = table.column("rep").to_numpy(), table.column("n").to_numpy(), _registers(table.column("regs").combine_chunks())
        forest = Forest(table.column("comp").to_numpy())
        for i in left:
            other = right[(forest.of[right] != forest.of[i]) & (den * np.minimum(n[i], n[right]) >= num * np.maximum(n[i], n[right]))]
            other = other[(regs[other] == regs[i]).mean(1) >= limit - spread] if len(other) else other
            if len(other):
                est = estimates(np.repeat(regs[i : i + 1], len(other), 0), regs[other], np.full(len(other), float(n[i])), n[other].astype(float))
                forest.join(i, other[est >= limit], ids)
        return forest.table()

    return run


def _set_block(num: int, den: int):
    """Of a family's block: pairs, across components, that the full sets confirm; as many as join what they can."""

    def run(table: pa.Table) -> pa.Table:
        table, left, right = _sides(table)
        ids = table.column("rep").to_numpy()
        forest = Forest(table.column("comp").to_numpy())
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        n = np.array([len(s) for s in sets])
        if len(left) == 1 or len(right) <= 2:
            for i in left:
                forest.join(i, [o for o in right if o != i and den * (b := shared(sets[i], sets[o])) >= num * (n[i] + n[o] - b)], ids)
            return forest.table()
        words, code = np.unique(np.concatenate([sets[o] for o in right]), return_inverse=True)
        starts = np.cumsum([0, *n[right[:-1]]])
        for i in left:
            if (forest.of[right] == forest.of[i]).all():
                continue
            mark = np.zeros(len(words), np.int32)
            at = np.minimum(np.searchsorted(words, sets[i]), len(words) - 1)
            mark[at[words[at] == sets[i]]] = 1
            both = np.add.reduceat(mark[code], starts)  # how much of set i each set on the right has
            forest.join(i, right[den * both >= num * (n[i] + n[right] - both)], ids)
        return forest.table()

    return run


def blocks(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows (key, rep, comp, n, ...) of keys with several components, with p, q (the block) and side: 1 left, 2 right, 0 both.

    Keys within a block's bounds are one block. Of others, what is outside of the largest component is dealt out on the
    left and everything on the right, and each left part meets each right part.
    """
    comps = rows.groupBy(*key, "comp").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    best = F.max(F.struct("c", "w", "comp"))
    whole = comps.groupBy(*key).agg(F.count("*").alias("comps"), F.sum("c").alias("c"), F.sum("w").alias("w"), best.alias("main")).where("comps > 1")
    parts = lambda c, w: F.greatest(F.ceil(c / BLOCK), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    whole = staged(whole.select(*key, F.col("main.comp").alias("main"), parts(F.col("c"), F.col("w")).alias("right"), parts(F.col("c") - F.col("main.c"), F.col("w") - F.col("main.w")).alias("left")), "blocks")
    at = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    one = F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("side")))
    on_right = F.transform(every("left"), lambda p: F.struct(p.alias("p"), at("right").alias("q"), F.lit(2).alias("side")))
    on_left = F.transform(every("right"), lambda q: F.struct(at("left").alias("p"), q.alias("q"), F.lit(1).alias("side")))
    places = F.when(F.col("right") == 1, one).when(F.col("comp") == F.col("main"), on_right).otherwise(F.concat(on_left, on_right))
    return rows.join(small(whole), key).select(*rows.columns, F.explode(places).alias("x")).select(*rows.columns, "x.*")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text; other columns are ignored).

    Documents are linked if den * intersection >= num * union of their k-word shingle sets (A-Z lower-cased; with fewer
    words the whole sequence is one shingle); component_id is the smallest doc_id that links reach. A text without
    words has an empty set and is linked with nothing. Repeated rows get equal answers. A null id is linked with
    nothing, its component_id is null and it is kept.
    """
    threshold = num / den
    n_bands = bands_for(threshold)
    m = n_bands * ROWS
    spread = MARGIN * math.sqrt(threshold * (1 - threshold) / m)
    limit = threshold - spread
    # Numbered, as few bytes would else be few tasks: what follows computes more than it reads.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    run, schema = _sketch_batches(k, m)
    sk = staged(text.mapInArrow(run, schema), "sketches")
    reps = sk.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), *[F.min(c).alias(n) for c, n in (("n_shingles", "n"), ("regs", "regs"), ("bands", "bands"))])
    reps = staged(reps, "classes")
    # 1. Hubs: in each bucket, for its band's kind, the class with the smallest hash.
    places = reps.select("rep", F.posexplode("bands").alias("band", "value"))
    hashed = F.xxhash64("rep", F.col("band") % KINDS)
    hubs = places.groupBy("band", "value").agg(F.min(F.struct(hashed.alias("h"), F.col("rep").alias("hub"))).alias("x"), F.count("*").alias("size")).where("size > 1")
    common = staged(places.join(hubs.select("band", "value", "x.hub"), ["band", "value"]), "common")
    met = common.where("rep <> hub").select("rep", "hub").distinct()
    one = lambda end, x, n: reps.select(F.col("rep").alias(end), F.col("regs").alias(x), F.col("n").alias(n))
    run, schema = _estimate_batches()
    near = met.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct().join(one("a", "x", "n_a"), "a").join(one("b", "y", "n_b"), "b").repartition(tasks, "a", "b").mapInArrow(run, schema)
    near = staged(near.where(F.col("est") >= min(FAMILY, limit)), "near")
    family = connected(near)
    # 2. Buckets that hold several families.
    of = lambda df: df.join(family, df["rep"] == family["v"], "left").withColumn("comp", F.coalesce("c", "rep")).drop("v", "c")
    seen = of(common.select("rep", "band", "value"))
    apart = staged(seen.groupBy("band", "value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band", "value"), "apart")
    if apart.limit(1).count():
        rows = seen.join(small(apart), ["band", "value"]).join(reps.select("rep", "n", "regs"), "rep")
        at = ["band", "value", "p", "q"]
        more = blocks(rows, at[:2]).repartition(tasks, *at).groupBy(*at).applyInArrow(_register_block(num, den, limit, spread), "a long, b long")
        family = connected(near.select("a", "b").unionByName(staged(more.distinct(), "more")))
    # 3. Families' full sets, in blocks.
    members = family.select(F.col("c").alias("family"), F.col("v").alias("rep")).join(reps.select("rep", "key", "n"), "rep").withColumn("comp", F.col("rep"))
    members = staged(members, "families")
    large = members.groupBy("family").agg(F.count("*").alias("c"), F.sum("n").alias("w")).where((F.col("c") > BLOCK) | (F.col("w") > BLOCK_SHINGLES)).select("family")
    large = staged(large, "large")
    links = None
    if large.limit(1).count():
        inside = members.join(small(large), "family", "left_semi").select("rep", "key")
        pairs = near.where(F.col("est") >= limit).where(f"{den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b)").join(small(inside.select(F.col("rep").alias("a"))), "a", "left_semi")
        ends = pairs.select("*", F.explode(F.array("a", "b")).alias("rep"))
        best = ends.withColumn("k", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("est"), "a", "b"))).where(f"k <= {HUBS}")
        links = staged(_verified(text, inside, best.select("a", "b").distinct(), k, num, den), "links")
        comp = connected(links)
        members = members.drop("comp").join(comp, F.col("rep") == comp["v"], "left").withColumn("comp", F.coalesce("c", "rep")).drop("v", "c")
    dealt = staged(blocks(members.select("family", "rep", "key", "n", "comp"), ["family"]), "dealt")
    sets = _sets(text, dealt.select("rep", "key").distinct(), k)
    rows = dealt.select("family", "rep", "key", "comp", "p", "q", "side").join(sets, (F.col("rep") == sets["id"]) & (dealt["key"] == sets["key"])).select("family", "p", "q", "rep", "comp", "side", "shingles")
    at = ["family", "p", "q"]
    found = rows.repartition(tasks, *at).groupBy(*at).applyInArrow(_set_block(num, den), "a long, b long")
    links = staged(found if links is None else found.unionByName(links), "links")
    comp = connected(links)
    ends = reps.join(comp, reps["rep"] == comp["v"], "left").select("key", F.coalesce("c", "rep").alias("c"))
    out = sk.select("doc_id", "n_shingles", "key").join(ends, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _sets(text: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """id, key, shingles of classes (rep, key). Only their texts are read into sets; a doc_id can occur with other texts, too."""
    run, schema = _set_batches(k)
    ids = small(classes.select("rep").distinct())
    return text.join(ids, text["doc_id"] == ids["rep"], "left_semi").mapInArrow(run, schema)


def _verified(text: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes (rep, key) that the full sets confirm; a few pairs a class."""
    used = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    classes = classes.join(used, "rep", "left_semi")
    made = _sets(text, classes, k)
    sets = staged(made.join(classes, (made["id"] == classes["rep"]) & (made["key"] == classes["key"]), "left_semi").dropDuplicates(["id"]).select("id", "shingles"), "sets")
    run, schema = _verify_batches(num, den)
    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    return with_a.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").mapInArrow(run, schema)


def drop_near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs, with all columns, without rows that a row with a smaller doc_id is linked to, directly or through others.

    Of rows with one doc_id, equal or not, all or none stay.
    """
    gone = near_duplicates(docs, k, num, den).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")
