"""Mixing against targets that are reshared round by round, and plain systematic sampling."""

import hashlib
import random
import re

import pytest

from terrafold.llm import mixing


def reshared(sizes, weights):
    """Targets by the rule as it is told: what is above three times a source's size is shared anew by weight."""
    total, capped = sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(3 * sizes[i] for i in capped)
        target = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        above = {i for i, t in target.items() if t >= 3 * sizes[i]}
        if not above:
            return [3.0 * s if i in capped else target[i] for i, s in enumerate(sizes)]
        capped |= above
        if len(capped) == len(sizes):
            return [3.0 * s for s in sizes]


def brute(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(size(t) for _, t, s in rows if s == n) for n in names]
    targets = reshared(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    out = []
    for name, whole, target in zip(names, sizes, targets, strict=True):
        u = int(hashlib.sha256(("mix:" + ("" if name is None else "=" + name)).encode()).hexdigest()[:8], 16) % (1 << 30)
        each, passed = int(target / whole * (1 << 30)) if whole else 0, u
        for i, t in sorted(((i, t) for i, t, s in rows if s == name), key=lambda r: (size(r[1]), r[0] is None, r[0] or 0)):
            copies = (passed + each) // (1 << 30) - passed // (1 << 30)
            passed += each
            out.append((i, size(t), whole, pytest.approx(target), size(t) * copies, copies))
    return out


def documents(n=900):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * 3 for _ in range(int(rng.paretovariate(1.1)) % 4000)), rng.choice(["a"] * 30 + ["b"] * 9 + ["c", "é", "", None])) for i in range(n)]
    return rows + [(None, "x y", "b"), (None, "x y", "b"), (3, "x y", "b"), (3, "x y", "b"), (n, None, "only nulls"), (n + 1, "\t \n", "only nulls"), (n + 2, "z " * 50_000, "long"), (n + 3, "one", "long")]


def test_mix(spark):
    rows = documents()
    df = spark.createDataFrame([(*r, 7, "s") for r in rows], "doc_id long, text string, source string, size int, target string").repartition(5)
    got = [tuple(r) for r in mixing.mix(df).collect()]
    order = lambda r: (str(r[0]), r[1], r[2], r[4])
    assert [g == w for g, w in zip(sorted(got, key=order), sorted(brute(rows), key=order), strict=True)] == [True] * len(rows)
    assert sorted(map(tuple, mixing.mix(df.repartition(2)).collect()), key=str) == sorted(got, key=str)
    for source in {r[2] for r in got}:
        own = [r for r in got if r[2] == source]
        assert abs(sum(r[4] for r in own) - own[0][3]) <= max(r[1] for r in own) + 1
        assert all(r[4] <= 3 * r[1] for r in own)


def test_mixed_rows(spark):
    rows = documents(200)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = sorted(((r.doc_id, r.copies) for r in mixing.mix(df).collect()), key=str)
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == sum(n for _, n in copies)
    assert set(map(tuple, out.collect())) <= set(rows)


def test_empty_and_equal(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none).collect() == [] and mixing.mixed(none).collect() == []
    same = spark.createDataFrame([(5, "a b c", "s")] * 7, "doc_id long, text string, source string")
    assert sum(r.taken for r in mixing.mix(same).collect()) == 21
