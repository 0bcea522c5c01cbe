"""Operator 1, best-fit packing.

Documents become pieces of at most a sequence's length; the pieces' length histogram (at most that many rows) goes to
the driver, which fits repeat counts of few-document patterns to it by non-negative least squares, rounds them down and
packs what is left best-fit decreasing. The plan gives ranges of ranks by length; Spark ranks the pieces and looks
their places up. Neither texts nor pieces reach the driver.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm.arrowtext import chunks
from terrafold.llm.common import small_batches, staged

CAPACITY = 2048
#: Pieces of one length are ranked in parts of about so many.
RANKED = 200
#: Bytes of text that are parted at once; the words that a task remembers.
SLICE, WORDS = 2 << 20, 400_000
#: Bounds of the fit, which lose no piece: patterns that are fitted, the commonest lengths that patterns of three are made of, sweeps.
PATTERNS, COMMON, SWEEPS = 4_000, 300, 30


class Numbered(dict):
    """Numbers words as they come; fresh has those that are new."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = n = len(self)
        return n


# Fixed value: what the tokens that end a word end in.
WORD_END = "</w>"
# Kinds of bytes: white space, letter, numeral, other.
_SPACE, _LETTER, _NUMERAL, _OTHER = range(4)


def _kind(c: str) -> int:
    return _SPACE if c.isspace() else {"L": _LETTER, "N": _NUMERAL}.get(unicodedata.category(c)[0], _OTHER)


#: Characters that are lower-cased and parted here: printable ones below U+0180, of one or two bytes, but for that whose lower case is two.
USUAL = [c for c in map(chr, range(0x180)) if c in "\t\n\r" or (" " <= c and not "\x7f" <= c <= "\xa0" and c != "İ")]
_KINDS = np.array([_kind(chr(c)) for c in range(0x180)], np.uint8)


def segments(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where segments of lower-case text start, then its length: runs of letters, of white space and of other characters, single numerals, and 's 't 're 've 'm 'll 'd. first: where texts start."""
    kind = _KINDS[data]
    lead = np.flatnonzero(data >= 0xC2)
    lead = lead[data[lead] <= 0xC5]
    if len(lead):  # two bytes
        kind[lead] = kind[lead + 1] = _KINDS[((data[lead].astype(np.int64) & 0x1F) << 6) | (data[lead + 1] & 0x3F)]
    start = first.copy()
    start[0] = True
    start[1:] |= (kind[1:] != kind[:-1]) | ((kind[1:] == _NUMERAL) & (data[1:] & 0xC0 != 0x80))
    at = np.flatnonzero(start)
    size, sort = np.diff(at, append=len(data)), kind[at]
    mark = np.flatnonzero((sort[:-1] == _OTHER) & (size[:-1] == 1) & (data[at[:-1]] == ord("'")) & (sort[1:] == _LETTER) & ~first[at[1:]])
    if len(mark):  # an apostrophe alone, and letters behind it
        a = data[at[mark + 1]]
        b = np.where(size[mark + 1] > 1, data[np.minimum(at[mark + 1] + 1, len(data) - 1)], 0)
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        step = np.where(np.isin(a, list(b"stmd")), 1, np.where(two, 2, 0))
        at[mark + 1] += step
        at = np.delete(at, mark[step == size[mark + 1]] + 1)
    return np.append(at, len(data))


class WordEncoder:
    """Token ids of whole texts by a tokenizers file whose tokens never cross words; each word is encoded once.

    Texts of usual characters are lower-cased and parted in bulk, as the file's own pattern does, and their distinct
    words tokenised; other texts go through the tokenizer whole, so that its Unicode rules hold. added: added tokens in
    a text get their ids, as by the tokenizer's own default, and texts that hold one go through it whole; else they are
    ordinary text.
    """

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        names = self.tokenizer.get_vocab()
        self.last = np.zeros(max(names.values()) + 1, bool)
        self.last[[i for t, i in names.items() if t.endswith(WORD_END)]] = True
        self.unusual = "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in USUAL) + "]"
        self.forget()

    def forget(self) -> None:
        self.known = Numbered()
        self.ids, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def learn(self) -> None:
        """Keep the new words' ids, one after the other. They are tokenised as one text, a space between them; a word's last token tells that it is."""
        fresh, self.known.fresh = self.known.fresh, []
        ids = np.array(self.tokenizer.encode(" ".join(fresh), add_special_tokens=False).ids, np.uint32)
        size, worded = np.zeros(len(fresh), np.int64), np.array([not w.isspace() for w in fresh], bool)
        ends = np.flatnonzero(self.last[ids])
        if len(ends) == worded.sum():
            size[worded] = np.diff(ends, prepend=-1)
        else:
            made = [e.ids for e in self.tokenizer.encode_batch(fresh, add_special_tokens=False)]
            ids, size = np.fromiter(chain.from_iterable(made), np.uint32), np.array([len(m) for m in made], np.int64)
        self.ids = np.concatenate([self.ids, ids])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(size)])

    def encoded(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a slice that starts and ends between words; where its segments start, and how many ids each has."""
        at = segments(data, first)
        words = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        if len(self.known) > WORDS:
            self.forget()
        number = np.fromiter(map(self.known.__getitem__, words.dictionary.to_pylist()), np.int64)
        if self.known.fresh:
            self.learn()
        number = number[words.indices.to_numpy()]
        begin, size = self.begin[number], self.begin[number + 1] - self.begin[number]
        return self.ids[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())], at[:-1], size

    def __call__(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        low = pc.utf8_lower(texts)
        whole = pc.match_substring_regex(texts, self.unusual)
        for a in self.added:
            whole = pc.or_(whole, pc.match_substring(low, a))
        plain = low.filter(pc.invert(whole))
        offsets = np.frombuffer(plain.buffers()[1], np.int32)[plain.offset : plain.offset + len(plain) + 1].astype(np.int64) if len(plain) else np.zeros(1, np.int64)
        data = np.frombuffer(plain.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        first = np.zeros(len(data) + 1, bool)
        first[offsets[:-1]] = True
        ids, seen, lo = [np.zeros(0, np.uint32)], np.zeros(len(offsets), np.int64), 0
        for hi in cuts(data, first):
            got, at, size = self.encoded(data[lo:hi], first[lo:hi])
            # seen[i]: how many ids stand before text i.
            inside = np.flatnonzero((offsets > lo) & (offsets <= hi))
            seen[inside] = seen[-1] + np.append(0, np.cumsum(size))[np.searchsorted(at, offsets[inside] - lo)]
            seen[-1] += len(got) if offsets[-1] > hi else 0
            ids.append(got)
            lo = hi
        flat, out, k = np.concatenate(ids), [], 0
        for i, unlike in enumerate(whole.to_pylist()):
            if unlike:
                out.append(np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32))
            else:
                out.append(flat[seen[k] : seen[k + 1]])
                k += 1
        return out


def cuts(data: np.ndarray, first: np.ndarray) -> Iterator[int]:
    """Ends of slices of about SLICE bytes; each is at white space or a text's start, so longer only where a word is."""
    lo = 0
    while lo < len(data):
        hi, size = len(data), SLICE
        while lo + size < len(data):
            may = np.flatnonzero((_KINDS[data[lo + 1 : lo + size]] == _SPACE) & (data[lo + 1 : lo + size] < 0x80) | first[lo + 1 : lo + size])
            if len(may):
                hi = lo + 1 + int(may[-1])
                break
            size *= 2
        yield hi
        lo = hi


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, added: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each row's ids and end_id, cut where they are longer than a sequence."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        encode = WordEncoder(tokenizer, added)
        for b in batches:
            for part, _, _ in chunks([b], "text", SLICE):
                rows: dict[str, list] = {n: [] for n in names}
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1)), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        cut = ids[start : start + capacity]
                        for n, v in zip(names, (doc, k, start, len(cut), zlib.crc32(cut.tobytes())), strict=True):
                            rows[n].append(v)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(rows[n], t) for n, t in zip(names, types, strict=True)], names)

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return text.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """Few-document length patterns that fill a sequence exactly: one, two or three lengths, and even repeats; the likeliest first."""
    have = sorted(counts, reverse=True)
    found: dict[tuple[int, ...], float] = {}
    for a in have:
        if capacity % a == 0:
            found[(a,) * (capacity // a)] = counts[a] * a / capacity
        if capacity - a in counts and a >= capacity - a:
            found[a, capacity - a] = min(counts[a], counts[capacity - a])
    often = sorted(counts, key=lambda x: (-counts[x], -x))[:COMMON]
    for i, b in enumerate(often):
        for c in often[i:]:
            if (a := capacity - b - c) in counts and a >= b:
                found[tuple(sorted((a, b, c), reverse=True))] = min(counts[a], counts[b], counts[c]) / 2
    return sorted(found, key=lambda p: (-found[p], p))[:PATTERNS]


def fitted(counts: dict[int, int], pool: list[tuple[int, ...]]) -> list[float]:
    """Repeat counts x >= 0 that bring the patterns' lengths nearest to the histogram by least squares: coordinate descent."""
    rest = {n: float(c) for n, c in counts.items()}
    columns = [[(n, p.count(n)) for n in set(p)] for p in pool]
    x = [0.0] * len(pool)
    for _ in range(SWEEPS):
        moved = 0.0
        for k, col in enumerate(columns):
            step = max(-x[k], sum(rest[n] * m for n, m in col) / sum(m * m for _, m in col))
            if step:
                x[k] += step
                moved = max(moved, abs(step))
                for n, m in col:
                    rest[n] -= m * step
        if moved < 0.01:
            break
    return x


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, and how many sequences each fills; together they hold the histogram exactly."""
    left = {n: c for n, c in counts.items() if c}
    pool = patterns(left, capacity)
    made = []
    for p, x in sorted(zip(pool, fitted(left, pool), strict=True), key=lambda y: -y[1]):
        if (n := min([int(x + 1e-9), *(left[a] // p.count(a) for a in set(p))])) > 0:
            made.append((p, n))
            for a in p:
                left[a] -= n
    # Best-fit decreasing over counts: open sequences stand together by what they hold and how much room they have.
    room: dict[int, list[list]] = defaultdict(list)
    for a in sorted(left, reverse=True):
        n = left[a]
        while n:
            fit = next((r for r in range(a, capacity) if room.get(r)), None)
            if fit is None:
                each = capacity // a
                if n // each:
                    room[capacity - a * each].append([(a,) * each, n // each])
                if n % each:
                    room[capacity - a * (n % each)].append([(a,) * (n % each), 1])
                n = 0
                continue
            group = room[fit][-1]
            take = min(n, group[1])
            group[1] -= take
            if not group[1]:
                room[fit].pop()
            room[fit - a].append([(*group[0], a), take])
            n -= take
    return made + [(p, n) for groups in room.values() for p, n in groups]


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, added: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs (doc_id, text).

    Null and empty texts are one piece of the end id. Repeated rows and null ids are packed like others. An empty table
    gives no row. Which of equal lengths stands where follows doc_id and piece. added: see WordEncoder.
    """
    with small_batches(docs.sparkSession):
        cut = staged(pieces(docs, tokenizer, capacity, end_id, added), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    spans, sequence = [], 0
    taken: dict[int, int] = defaultdict(int)
    for p, n in plan(counts, capacity):
        at = 0
        for a in p:
            spans.append((a, taken[a], sequence, at))
            taken[a] += n
            at += a
        sequence += n
    spans.sort()
    lengths, ranks, first, offset = (np.array(x, np.int64) for x in (zip(*spans, strict=True) if spans else ([], [], [], [])))
    starts = (lengths << 44) | ranks

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(starts, (length << 44) | rank, "right") - 1
            out = b.drop_columns(["rank"]).append_column("sequence_id", pa.array(first[at] + rank - ranks[at])).append_column("offset", pa.array(offset[at]))
            yield out

    # Ranks by length: parts of a length are counted, then numbered, so that no length is one task's.
    parts = cut.sparkSession.createDataFrame([(n, -(-c // RANKED)) for n, c in counts.items() if c > RANKED], "length long, parts int")  # at most `capacity` rows
    cut = cut.join(F.broadcast(parts), "length", "left").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.coalesce("parts", F.lit(1)))).drop("parts")
    before = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = before.select("length", "part", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = cut.withColumn("k", F.row_number().over(order)).join(before, ["length", "part"]).withColumn("rank", (F.col("k") - 1 + F.col("before")).cast("long"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
