"""Near duplicates against a comparison of all pairs of full sets."""

import random
import re

from terrafold.llm import neardup


def brute(rows, k, num, den):
    sets = {}
    for i, (doc, text) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and None not in (rows[i][0], rows[j][0]) and den * len(a & b) >= num * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    out = []
    for i, (doc, _) in enumerate(rows):
        c = None if doc is None else least[root(i)]
        out.append((doc, len(sets[i]), c, doc is None or c == doc))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    vocab = [f"Wort{i}é" for i in range(300)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([4, 30, 120]))]
        for _ in range(rng.choice([1, 2, 9, 30])):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((rng.randrange(10**6), " \t".join(w)))
    rows += [(7, None), (8, ""), (9, " \n"), (10, "One"), (11, "one"), (12, "one two"), (None, "one"), (None, None), (13, "one two"), (13, "one two")]
    rows += [(14, "x " * 30_000), (15, "X\n" * 29_000)]
    return rows


def test_all_links(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 5)
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_shingles int, key string")
    for k, num, den in ((3, 85, 100), (5, 80, 100)):
        got = sorted(map(tuple, neardup.near_duplicates(df, k, num, den).collect()), key=str)
        assert got == brute(rows, k, num, den)


def test_drop(spark):
    df = spark.createDataFrame([(1, "a b c", "s"), (0, "a b c", "t"), (2, "q", None), (None, "q", None)], "doc_id long, text string, source string")
    assert sorted(neardup.drop_near_duplicates(df).collect(), key=str) == sorted([(0, "a b c", "t"), (2, "q", None), (None, "q", None)], key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(df).collect() == []


def test_a_joined_group_leaves(spark, monkeypatch):
    """Edges inside a group are joined once: a dense group and a chain take few rounds, and a round is left few of their edges."""
    from terrafold.operators import graph

    rounds, real = [], graph.kept
    monkeypatch.setattr(graph, "kept", lambda df, name: (t := real(df, name), rounds.append(t.count()) if name == "edges" else None)[0])
    dense = [(a, b) for a in range(100, 140) for b in range(a + 1, 140)]
    chain = [(k, k + 1) for k in range(500, 600)]
    zigzag = [(900 + (k * 37) % 101, 900 + ((k + 1) * 37) % 101) for k in range(100)]
    edges = spark.createDataFrame([*dense, *chain, *zigzag, (3, 3), (8, 7), (7, 8)], "a long, b long")
    got = {r.v: r.c for r in graph.connected(edges).collect()}
    assert got == {**{v: 100 for v in range(100, 140)}, **{v: 500 for v in range(500, 601)}, **{v: 900 for v in range(900, 1001)}, 7: 7, 8: 7}
    assert len(rounds) <= 8 and rounds[0] == len(dense) + 201 and rounds[1] <= 50 and rounds[-1] == 0
    assert graph.connected(edges.where("a < 0")).collect() == []
