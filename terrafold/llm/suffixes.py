"""Operator 3, suffix-array deduplication with a depth limit.

Only the first `depth` bytes of each suffix matter, so a suffix is its window of that many bytes. Windows go through
most-significant-digit passes, which drop what stands alone:

1. Each window's first digit is its anchor, the k-gram with the smallest hash inside it. Runs of windows share one. The
   anchors of a group of texts go out as sorted 48-bit values; those that one text alone has are dropped (a bit each
   comes back).
2. Runs with a surviving anchor go to the anchor's part. There their windows are radix-sorted by 8-byte digits, through
   depth bytes; groups that stay together through all digits are exactly the repeated windows. What comes back is
   each group's smallest doc_id.
3. Each group of texts removes the bytes under windows that start in a text with a smaller doc_id.

Equal texts are one text throughout. An anchor that very many groups hold is dealt out window by window instead.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.arrowtext import _BYTES, _INVERSE, BASE, U, mix, powers
from terrafold.llm.common import staged

DEPTH = 50
#: Bytes of text to a group of texts, which grow with the input from the first to the second, so that about MANY groups
#: come of it in between; windows that are hashed at once; the anchors' length (less in short depths).
GROUP_BYTES, MOST_BYTES, MANY, SLICE, GRAM = 4 << 20, 64 << 20, 4096, 1 << 20, 20
#: A group sends a part about so many anchors at least, so that what is exchanged grows with the input, not its square.
#: Buckets of the texts' table, at most; groups beyond them share one.
SENT, BUCKETS = 64, 65_536
#: An anchor in more groups than this is dealt out window by window.
HOT_GROUPS = 64
EMPTY = hashlib.sha256(b"").hexdigest()


def buffer(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and each text's offset in them."""
    texts = [np.frombuffer(x.as_buffer(), np.uint8) for x in column]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=offsets[1:])
    return (np.concatenate(texts) if texts else np.zeros(0, np.uint8)), offsets


def runs(data: np.ndarray, offsets: np.ndarray, depth: int):
    """Of each run of windows with one anchor: first window, number of windows, text, the anchor's hash, the hash of its bytes."""
    k = min(GRAM, max(1, depth // 2))
    grams = depth - k + 1
    found = []
    for lo in range(0, max(0, len(data) - depth + 1), SLICE):
        part = data[lo : min(len(data), lo + SLICE + depth - 1)]
        n = len(part) - depth + 1
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * powers(BASE, len(part)), out=total[1:])
        back = powers(_INVERSE, len(part) + 1)
        least = mix((total[k:] - total[:-k]) * back[: len(part) - k + 1])
        hashes, at, width = least, np.arange(len(least)), 1
        while width < grams:  # leftmost smallest hash of ever wider spans
            step = min(width, grams - width)
            later = least[step:] < least[:-step]
            least, at = np.where(later, least[step:], least[:-step]), np.where(later, at[step:], at[:-step])
            width += step
        owner = np.searchsorted(offsets, np.arange(lo, lo + n), "right") - 1
        good = np.arange(lo, lo + n) + depth <= offsets[owner + 1]
        new = good.copy()
        new[1:] &= (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]) | ~good[:-1]
        first = np.flatnonzero(new)
        if len(first):
            stop = np.flatnonzero(good & np.append(new[1:] | ~good[1:], True))
            count = stop - first + 1
            body = mix((total[stop + depth] - total[first]) * back[first]) + count.astype(np.uint64)
            found.append((first + lo, count, owner[first], hashes[at[first]], body))
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def numbered(body: np.ndarray, doc: np.ndarray):
    """Equal runs under one number: each run's number, a run of each number, the smallest doc_id of each number."""
    _, example, number = np.unique(body, return_index=True, return_inverse=True)
    least = np.full(len(example), np.iinfo(np.int64).max)
    np.minimum.at(least, number, doc)
    return number, example, least


def packed(*arrays: np.ndarray) -> bytes:
    raw = [a.tobytes() for a in arrays]
    whole = b"".join(raw)
    return struct.pack(f"<q{len(raw)}q", len(raw), *map(len, raw)) + bytes(pa.compress(whole, codec="zstd")) if whole else b""


def unpacked(blob: bytes, *types) -> list[np.ndarray]:
    if not blob:
        return [np.zeros(0, t) for t in types]
    n = struct.unpack_from("<q", blob)[0]
    sizes = struct.unpack_from(f"<{n}q", blob, 8)
    whole = pa.decompress(blob[8 + 8 * n :], decompressed_size=sum(sizes), codec="zstd")
    ends = np.cumsum([0, *sizes])
    return [np.frombuffer(whole, t, (b - a) // np.dtype(t).itemsize, a) for t, a, b in zip(types, ends[:-1], ends[1:], strict=True)]


def taken(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of data[first : first + size], one after the other."""
    return data[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]


def _anchors(depth: int, parts: int):
    """Pass 1, out: a group's distinct anchors as 48 bits, and whether several of its texts have them, by part."""

    def run(table: pa.Table) -> pa.Table:
        group = table.column("b")[0].as_py()
        data, offsets = buffer(table.column("t"))
        _, _, owner, anchor, _ = runs(data, offsets, depth)
        doc = table.column("doc_id").to_numpy()[owner]
        value = anchor >> U(16)
        order = np.lexsort((doc, value))
        value, doc = value[order], doc[order]
        start = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
        several = doc[start] != doc[np.append(start[1:], len(doc)) - 1] if len(value) else np.zeros(0, bool)
        value = value[start]
        part = ((value >> U(16)) * U(parts)) >> U(32)
        ends = np.searchsorted(part, np.arange(parts + 1))
        rows = [(p, packed(value[a:b].view(np.uint8).reshape(-1, 8)[:, :6].ravel(), several[a:b])) for p, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "b": pa.array([group] * len(rows), pa.int64()), "blob": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _survivors(table: pa.Table) -> pa.Table:
    """Pass 1, back: a bit for each anchor of each group: several texts have it; and: it is hot."""
    groups, part = table.column("b").to_pylist(), table.column("part")[0].as_py()
    values, several = [], []
    for blob in table.column("blob"):
        v, s = unpacked(blob.as_py(), np.uint8, bool)
        wide = np.zeros((len(v) // 6, 8), np.uint8)
        wide[:, :6] = v.reshape(-1, 6)
        values.append(wide.view(np.uint64).ravel())
        several.append(s)
    _, inverse, count = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    keep, hot = (count[inverse] > 1) | np.concatenate(several), count[inverse] > HOT_GROUPS
    ends = np.cumsum([0, *map(len, values)])
    blobs = [packed(np.packbits(keep[a:b]), np.packbits(hot[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return pa.table({"b": pa.array(groups, pa.int64()), "part": pa.array([part] * len(groups), pa.int32()), "blob": pa.array(blobs, pa.binary())})


def _bodies(depth: int, parts: int):
    """Pass 2, out: a group's distinct runs with a surviving anchor, by part."""

    def run(key, texts: pa.Table, bits: pa.Table) -> pa.Table:
        empty = pa.table({"part": pa.array([], pa.int32()), "b": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
        if not texts.num_rows or not bits.num_rows:
            return empty
        data, offsets = buffer(texts.column("t"))
        first, count, owner, anchor, body = runs(data, offsets, depth)
        value = np.unique(anchor >> U(16))
        part = ((value >> U(16)) * U(parts)) >> U(32)
        ends = np.searchsorted(part, np.arange(parts + 1))
        keep, hot = np.zeros(len(value), bool), np.zeros(len(value), bool)
        for p, blob in zip(bits.column("part").to_pylist(), bits.column("blob"), strict=True):
            k, h = unpacked(blob.as_py(), np.uint8, np.uint8)
            n = ends[p + 1] - ends[p]
            keep[ends[p] : ends[p + 1]], hot[ends[p] : ends[p + 1]] = np.unpackbits(k, count=n), np.unpackbits(h, count=n)
        number, example, least = numbered(body, texts.column("doc_id").to_numpy()[owner])
        at = np.searchsorted(value, anchor[example] >> U(16))
        lid = np.flatnonzero(keep[at])
        hot = hot[at[lid]]
        # Each row: number, first window within the run, windows, where the bytes are, the key that deals it out.
        cold = lid[~hot]
        rows = [(cold, np.zeros(len(cold), np.int64), count[example[cold]], first[example[cold]], anchor[example[cold]])]
        if hot.any():
            warm = lid[hot]
            times = count[example[warm]]
            inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            where = np.repeat(first[example[warm]], times) + inner
            content = mix(np.array([hash_window(data[w : w + depth]) for w in where], np.uint64))
            rows.append((np.repeat(warm, times), inner, np.ones(len(inner), np.int64), where, content))
        lid, inner, n, where, dealt = (np.concatenate(x) for x in zip(*rows, strict=True))
        part = mix(dealt ^ U(0x5DEECE66D)) % U(parts)
        order = np.argsort(part, kind="stable")
        lid, inner, n, where, part = (x[order] for x in (lid, inner, n, where, part))
        ends = np.searchsorted(part, np.arange(parts + 1))
        out = []
        for p, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if b > a:
                size = n[a:b] + depth - 1
                out.append((p, packed(lid[a:b].astype(np.int32), inner[a:b].astype(np.uint8), n[a:b].astype(np.uint8), least[lid[a:b]], taken(data, where[a:b], size))))
        return pa.table({"part": pa.array([r[0] for r in out], pa.int32()), "b": pa.array([key[0].as_py()] * len(out), pa.int64()), "blob": pa.array([r[1] for r in out], pa.binary())})

    return run


def hash_window(w: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(w.tobytes(), digest_size=8).digest(), "little")


def repeated(data: np.ndarray, start: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows at start: those whose bytes occur at several places, and their groups. MSD radix passes of 8-byte digits."""
    live, group = np.arange(len(start)), np.zeros(len(start), np.int64)
    padded = np.append(data, np.zeros(8, np.uint8))
    for d in range(0, depth, 8):
        if not len(live):
            break
        digit = padded[start[live, None] + np.arange(d, d + 8)]
        if depth - d < 8:
            digit[:, depth - d :] = 0
        _, rank = np.unique(np.ascontiguousarray(digit).view(">u8").ravel().astype(np.uint64), return_inverse=True)
        _, group, size = np.unique(group * (int(rank.max()) + 1) + rank, return_inverse=True, return_counts=True)
        alone = size[group] == 1
        live, group = live[~alone], group[~alone]
    return live, group


def _sorted(depth: int):
    """Pass 2, back: for runs of each group, the spans of windows that a text with a smaller doc_id has."""

    def run(table: pa.Table) -> pa.Table:
        groups, cols = table.column("b").to_pylist(), []
        for x in table.column("blob"):
            cols.append(unpacked(x.as_py(), np.int32, np.uint8, np.uint8, np.int64, np.uint8))
        sizes = [len(c[0]) for c in cols]
        lid, inner, n, least, data = (np.concatenate([c[i] for c in cols]) for i in range(5))
        n = n.astype(np.int64)
        body = np.cumsum(n + depth - 1) - (n + depth - 1)
        row = np.repeat(np.arange(len(n)), n)
        window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        live, group = repeated(data, body[row] + window, depth)
        best = np.full(int(group.max()) + 1 if len(group) else 0, np.iinfo(np.int64).max)
        np.minimum.at(best, group, least[row[live]])
        live = live[best[group] < least[row[live]]]
        row, window = row[live], window[live] + inner[row[live]]
        owner = np.searchsorted(np.cumsum(sizes), row, "right")
        rows = []
        for g in np.unique(owner):
            mine = owner == g
            rows.append((groups[g], packed(lid[row[mine]], window[mine].astype(np.uint8))))
        return pa.table({"b": pa.array([r[0] for r in rows], pa.int64()), "blob": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _removed(depth: int, keep_text: bool):
    """Pass 3: each text without the bytes that texts with smaller doc_ids have."""

    def run(key, texts: pa.Table, replies: pa.Table) -> pa.Table:
        data, offsets = buffer(texts.column("t"))
        first, count, owner, _, body = runs(data, offsets, depth)
        doc = texts.column("doc_id").to_numpy()[owner] if len(owner) else np.zeros(0, np.int64)
        number, example, least = numbered(body, doc)
        edge = np.zeros(len(data) + depth + 1, np.int32)
        own = least[number] < doc if len(doc) else np.zeros(0, bool)
        np.add.at(edge, first[own], 1)
        np.add.at(edge, first[own] + count[own] + depth - 1, -1)
        of_number = np.argsort(number, kind="stable")  # all runs of a number, for the replies
        begin = np.searchsorted(number[of_number], np.arange(len(example) + 1))
        for blob in replies.column("blob"):
            lid, window = unpacked(blob.as_py(), np.int32, np.uint8)
            times = begin[lid + 1] - begin[lid]
            run_of = of_number[np.repeat(begin[lid] - np.cumsum(times) + times, times) + np.arange(times.sum())]
            at = first[run_of] + np.repeat(window.astype(np.int64), times)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + depth, -1)
        gone = np.cumsum(edge)[: len(data)] > 0
        out = {"key": texts.column("key"), "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            g = gone[a:b]
            rest = data[a:b][~g].tobytes()
            out["n_removed"].append(int(g.sum()))
            out["n_spans"].append(int((g[1:] & ~g[:-1]).sum() + g[0]) if len(g) else 0)
            out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
            out["kept"].append(rest if keep_text else None)
        return pa.table(out, schema=pa.schema([("key", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]))

    return run


def exchange(total: int) -> tuple[int, int]:
    """How many groups the texts' bytes make, and how many parts their anchors are dealt to."""
    size = min(MOST_BYTES, max(GROUP_BYTES, total // MANY))
    return max(1, -(-total // size)), max(1, min(-(-total // (2 * size)), size // (GRAM * SENT)))


def remove_repeats(docs: DataFrame, depth: int = DEPTH, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes, if asked for) for each row of docs (doc_id, text).

    A byte goes if a string of `depth` bytes that covers it also starts in a document with a smaller doc_id, judged on
    the input. Null texts are empty; texts shorter than depth lose nothing. Repeated rows get equal answers. A null id
    is smaller than none and has none that is smaller: its row keeps all, and removes nothing elsewhere.
    """
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("t")).withColumn("key", F.unhex(F.sha2("t", 256)))
    rows = staged(text.select("doc_id", "key", F.octet_length("t").cast("long").alias("n_bytes")), "rows")
    classes = staged(rows.where("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes")), "classes")
    total = classes.agg(F.sum("n_bytes")).first()[0] or 0
    groups, parts = exchange(total)
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    inner = max(1, -(-2 * groups // shuffled))
    one = text.join(classes.where(f"n_bytes >= {depth}").select("key", "doc_id"), ["key", "doc_id"], "left_semi")
    one = one.withColumn("b", F.spark_partition_id().cast("long") * inner + F.pmod(F.xxhash64("doc_id"), F.lit(inner)))
    name = f"suffixes_{uuid.uuid4().hex}"
    # Bucketed by group: the three passes read the texts where they are, without another shuffle of them.
    one.write.bucketBy(min(groups, BUCKETS), "b").saveAsTable(name)
    try:
        texts = spark.table(name)
        blob = "part int, b long, blob binary"
        sent = texts.groupBy("b").applyInArrow(_anchors(depth, parts), blob)
        bits = staged(sent.groupBy("part").applyInArrow(_survivors, "b long, part int, blob binary"), "anchors")
        sent = texts.groupBy("b").cogroup(bits.groupBy("b")).applyInArrow(_bodies(depth, parts), blob)
        back = staged(sent.groupBy("part").applyInArrow(_sorted(depth), "b long, blob binary"), "spans")
        made = "key binary, n_removed long, n_spans long, kept_sha256 string, kept binary"
        cut = staged(texts.groupBy("b").cogroup(back.groupBy("b")).applyInArrow(_removed(depth, keep_text), made).dropDuplicates(["key"]), "cut")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    firsts = classes.select("key", F.col("doc_id").alias("first"))
    out = rows.join(firsts, "key", "left").join(cut, "key", "left")
    whole = (F.col("doc_id") > F.col("first")) & (F.col("n_bytes") >= depth)
    same = F.col("doc_id") == F.col("first")
    pick = lambda gone, own, rest: F.when(whole, gone).when(same, F.coalesce(own, rest)).otherwise(rest)
    out = out.select(
        "doc_id",
        "n_bytes",
        pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0).cast("long")).alias("n_removed"),
        pick(F.lit(1).cast("long"), F.col("n_spans"), F.lit(0).cast("long")).alias("n_spans"),
        pick(F.lit(EMPTY), F.col("kept_sha256"), F.lower(F.hex("key"))).alias("kept_sha256"),
        *([F.when(whole, F.lit(b"")).when(same, F.col("kept")).alias("kept")] if keep_text else []),
    )
    return out
