"""Line deduplication against a comparison of all pairs of lines."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from terrafold.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, s, n):
    for _ in range(n):
        i = rng.randrange(len(s) + 1)
        s = rng.choice([s[:i] + rng.choice("abcé漢") + s[i:], s[:i] + s[i + 1 :], s[:i] + rng.choice("abcé") + s[i + 1 :]])
    return s


@pytest.mark.parametrize("k", [1, 2, 3])
def test_within(spark, k):
    rng = random.Random(k)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(4, 30)))
        pairs.append((a, edited(rng, a, rng.randrange(6))))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, x string, y string")
    got = {r.i for r in lines.within(df, k).collect()}
    assert got == {i for i, (a, b) in enumerate(pairs) if a != b and distance(a, b) <= k}


def brute(rows, k, least):
    at = []
    for r, (d, t) in enumerate(rows):
        at += [((d is None, d or 0, no, r), s) for no, s in enumerate((t or "").split("\n")) if len(s) >= least]
    first = {}
    for p, s in sorted(at):
        first.setdefault(s, p)
    near = {s: [o for o in first if o != s and abs(len(o) - len(s)) <= k and distance(s, o) <= k] for s in first}
    out = []
    for r, (d, t) in enumerate(rows):
        kept, e, n = [], 0, 0
        for no, s in enumerate((t or "").split("\n")):
            p = (d is None, d or 0, no, r)
            if s in first and p != first[s]:
                e += 1
            elif s in first and any(first[o] < first[s] for o in near[s]):
                n += 1
            else:
                kept.append(s)
        out.append((d, len(t.split("\n")) if t else 0, e, n, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("k, hot", [(1, 16), (1, 1), (2, 1), (2, 4)])
def test_line_table(spark, k, hot, monkeypatch):
    monkeypatch.setattr(lines, "HOT", hot)
    rng = random.Random(9)
    base = ["".join(rng.choice("abcé ") for _ in range(rng.choice([5, 8, 9, 20, 33]))) for _ in range(12)]
    rows = [(i % 37, "\n".join(edited(rng, rng.choice(base), rng.randrange(3)) for _ in range(rng.randrange(5)))) for i in range(50)]
    rows += [(None, base[3]), (None, None), (90, ""), (91, "\n\n"), (92, base[3] + "\n" + base[3]), (92, base[3]), (93, "x" * 70_000)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, row int").coalesce(1)
    assert sorted(map(tuple, lines.line_table(df, k, 8).collect()), key=str) == brute(rows, k, 8)


def test_dedup_lines(spark):
    a, b = "a line of twenty chars and more", "a line of twenty chars, and more"
    df = spark.createDataFrame([(1, a + "\nshort\n" + b, "s", 9), (2, b, "s", 9), (3, None, "s", 0), (4, "short", None, 5), (5, a + "\nshort", "t", 9)], "doc_id long, text string, source string, n_chars long")
    got = sorted(map(tuple, lines.dedup_lines(df).collect()))
    assert got == [(1, a + "\nshort", "s", len(a) + 6), (3, None, "s", 0), (4, "short", None, 5), (5, "short", "t", 5)]
    assert lines.dedup_lines(df.where(F.lit(False))).collect() == []


def test_short_repeats(spark, tmp_path):
    """Registered query and stage: equal lines go at any length if they have a word."""
    from terrafold.llm import registry

    import corpus_pipeline

    texts = ["ab\n\nHome\n \n漢", "Home\n\nhome\n \n漢", "ab\nHome\nab"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.n_exact, r.n_near, r.kept_sha256) for r in registry.op2_line_dedup(spark, str(tmp_path)).collect())
    kept = [texts[0], "\nhome\n ", ""]
    assert got == [(i, n, 0, hashlib.sha256(t.encode()).hexdigest()) for (i, n), t in zip([(0, 0), (1, 2), (2, 3)], kept, strict=True)]
    assert sorted(map(tuple, corpus_pipeline.line_dedup(spark, df, "").collect())) == [(0, kept[0]), (1, kept[1])]


@pytest.mark.parametrize("hot", [1, 64])
def test_graded(spark, tmp_path, hot, monkeypatch):
    """The registered query removes lines with a changed word: k by length of the shorter line, against all pairs."""
    from terrafold.llm import registry

    monkeypatch.setattr(lines, "HOT", hot)
    rng = random.Random(4)
    base = ["".join(rng.choice("abcé ") for _ in range(n)) for n in (8, 9, 10, 11, 18, 19, 20, 21, 27, 28, 29, 30, 31, 33, 45, 60)]
    base += ["the sum of thnt to of all", "the sum of thnt in of all"]
    texts = [edited(rng, rng.choice(base), rng.randrange(5)) for _ in range(150)] + base
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_exact, r.n_near) for r in registry.op2_line_dedup(spark, str(tmp_path)).collect()}
    first = {}
    for i, t in enumerate(texts):
        if t.strip():
            first.setdefault(t, i)
    edits = lambda n: 0 if n < 10 else min(n // 10, 3)
    near = {s: [o for o in first if o != s and distance(s, o) <= edits(min(len(s), len(o)))] for s in first}
    want = {}
    for i, t in enumerate(texts):
        exact = t in first and first[t] != i
        want[i] = (int(exact), int(t in first and not exact and any(first[o] < i for o in near[t])))
    assert got == want
    assert want[len(texts) - 1][1] == 1


@pytest.mark.parametrize("hot", [64, 1024])
def test_numbered_lines(spark, hot, monkeypatch):
    """Thousands of lines that differ by their number: no pair of all is made, and each is near to an earlier one or not."""
    monkeypatch.setattr(lines, "HOT", hot)
    rng = random.Random(6)
    numbers = rng.sample(range(1_000_000), 3000)
    df = spark.createDataFrame([(i, f"reader comment number {n:06d} of the page") for i, n in enumerate(numbers)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.n_near for r in lines.line_table(df, lines.GRADED, short=True).collect()}
    seen: set[tuple] = set()
    for i, n in enumerate(numbers):
        d = f"{n:06d}"
        # Three figures or fewer changed in place; a shift that three edits make is found by comparing with what is open.
        place = {(c, *(d[p] for p in c)) for c in itertools.combinations(range(6), 3)}
        if place & seen:
            assert got[i] == 1
        elif got[i]:
            assert any(distance(d, f"{o:06d}") <= 3 for o in numbers[:i])
        else:
            assert all(distance(d, f"{o:06d}") > 3 for o in numbers[:i])
        seen |= place
    assert 0 < sum(got.values()) < 3000
