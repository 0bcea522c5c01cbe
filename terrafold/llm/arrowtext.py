"""Texts in Arrow batches as NumPy arrays: bounded chunks, word hashes, sets of word shingles. Used inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20
U = np.uint64
#: Odd multiplier of the rolling hash and its inverse modulo 2**64; a random value for each byte.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for further calls."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, CHUNK + 1), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def chunks(batches: Iterator[pa.RecordBatch], column: str = "t", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with at most so many bytes of text (or one row): the rows, the bytes, and each text's offset in them."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        n = batch.num_rows
        if not n:
            continue
        text = batch.column(at)
        ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + n + 1].astype(np.int64)
        data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo), data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
            lo = hi


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (A-Z lower-cased, parted by white space) and the index of its text. Words never cross texts."""
    hashes, owners, lo, n = [], [], 0, len(data)
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    while lo < n:
        hi, size = n, CHUNK
        while lo + size < n:  # cut where a word ends, so that slices stay bounded but for longer words
            cut = np.flatnonzero(SPACE[data[lo : lo + size]] | first[lo : lo + size])
            cut = cut[cut > 0]
            if len(cut):
                hi = lo + int(cut[-1])
                break
            size *= 2
        part = LOWERED[data[lo:hi]]
        word = ~SPACE[part]
        before = np.empty(len(part), bool)
        before[0], before[1:] = False, word[:-1]
        start = np.flatnonzero(word & (~before | first[lo:hi]))
        after = np.empty(len(part), bool)
        after[-1], after[:-1] = True, ~word[1:] | first[lo + 1 : hi]
        end = np.flatnonzero(word & after) + 1
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * powers(BASE, len(part)), out=run[1:])
        h = (run[end] - run[start]) * powers(_INVERSE, len(part))[start]
        hashes.append(mix(h ^ (end - start).astype(np.uint64)))
        owners.append(np.searchsorted(offsets, start + lo, "right") - 1)
        lo = hi
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct k-word shingles as 64-bit hashes; of a text with fewer words, but not none, the whole sequence as one."""
    words, owner = word_hashes(data, offsets)
    bounds = np.searchsorted(owner, np.arange(len(offsets)))
    chained = words.copy()
    for j in range(1, k):
        if len(words) > j:
            chained[: len(words) - j] = mix(chained[: len(words) - j] * U(3) + U(j)) ^ words[j:]
    chained = mix(chained)
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            sets.append(np.unique(chained[a : b - k + 1]))
        elif b > a:
            one = words[a : a + 1]
            for w in words[a + 1 : b]:
                one = mix(one * U(5) + U(11)) ^ w
            sets.append(mix(one + U(b - a)))
        else:
            sets.append(words[:0])
    return sets
