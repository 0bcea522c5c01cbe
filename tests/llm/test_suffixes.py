"""Suffix deduplication against a table of all windows."""

import hashlib
import random

from terrafold.llm import suffixes


def brute(rows, depth):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - depth + 1):
            if d is not None:
                w = b[i : i + depth]
                least[w] = min(d, least.get(w, d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - depth + 1):
            if d is not None and least[b[i : i + depth]] < d:
                gone[i : i + depth] = [True] * depth
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(3)
    words = ["the", "of", "Ünï", "cat", "sat", "漢字", "on", "mat", "a"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [line(25) for _ in range(4)]
    rows = []
    for i in range(60):
        rows.append((i * 3 % 61, " ".join([line(rng.randrange(40)), rng.choice(shared)[rng.randrange(30) :], line(rng.randrange(30)), rng.choice(["", shared[0]])])))
    rows += [(100, rows[5][1]), (101, rows[5][1]), (101, rows[5][1]), (None, rows[5][1]), (None, line(40)), (102, None), (103, ""), (104, "short"), (105, "short")]
    rows += [(106, "ab" * 400), (107, "ab" * 300 + "c"), (108, "x" * 49), (109, "x" * 49), (110, "x" * 50), (111, "x" * 51), (3, line(60))]
    return rows


def test_all_windows(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "z", 1) for d, t in rows], "doc_id long, text string, key string, b int").repartition(3)
    for depth, group, piece, hot in ((50, 4 << 20, 1 << 20, 64), (50, 900, 97, 1), (20, 3000, 500, 64)):
        monkeypatch.setattr(suffixes, "GROUP_BYTES", group)
        monkeypatch.setattr(suffixes, "SLICE", piece)
        got = sorted(map(tuple, suffixes.remove_repeats(df, depth).collect()), key=str)
        assert got == brute(rows, depth)


def test_empty(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_hot_anchors_are_dealt_out_by_window():
    import numpy as np
    import pyarrow as pa

    data = b"".join(bytes([97 + i % 20, 98 + i * 7 % 23]) for i in range(100))
    texts = pa.table({"t": pa.array([data], pa.binary()), "doc_id": [4]})
    buf, off = suffixes.buffer(texts.column("t"))
    n = len(np.unique(suffixes.runs(buf, off, 50)[3] >> suffixes.U(16)))
    for hot in (0, 255):
        bits = pa.table({"part": [0], "blob": pa.array([suffixes.packed(np.full((n + 7) // 8, 255, np.uint8), np.full((n + 7) // 8, hot, np.uint8))], pa.binary())})
        made = suffixes._bodies(50, 1)([pa.scalar(1)], texts, bits)
        lid, inner, count, least, body = suffixes.unpacked(made.column("blob")[0].as_py(), np.int32, np.uint8, np.uint8, np.int64, np.uint8)
        assert count.sum() == len(np.unique([data[i : i + 50] for i in range(151)])) and (not hot or count.max() == 1)
