"""Null ids, repeated rows, clashing columns and empty tables, and the ways beyond a broadcast's bound."""

import random

import corpus_pipeline
from terrafold.llm import decontam, lines, neardup, packing, quality, suffixes
from terrafold.shared import staged

BENCH = [(1, " ".join(f"b{i}" for i in range(14))), (2, "tiny item"), (3, None), (4, "the the the the the the the the the the the"), (None, "nameless item here")]


def texts():
    rng = random.Random(7)
    out = [None, "", "tiny item", "a tiny item b", "the " * 40, "Nameless ITEM here", BENCH[0][1].upper() + " tail", " ".join(f"b{i}" for i in range(3, 13))]
    return out + [" ".join(rng.choice("a b c tiny item the".split()) for _ in range(rng.randrange(30))) for _ in range(20)]


def test_shuffled_windows(spark, monkeypatch):
    """Beyond the broadcast's bound, decontamination gives the same rows."""
    rows = [(k % 9 or None, t, 5, "h", "w") for k, t in enumerate(texts())]
    df = spark.createDataFrame([*rows, rows[3], rows[3]], "doc_id long, text string, pos int, items string, words string")
    bench = spark.createDataFrame([(*b, "s") for b in BENCH], "item_id long, text string, size string")
    want = sorted(map(tuple, decontam.digest_table(df, bench).collect()), key=str)
    kept = sorted(map(tuple, decontam.decontaminate(df, bench).collect()), key=str)
    monkeypatch.setattr(decontam, "MAX_BROADCAST_WINDOWS", 0)
    assert sorted(map(tuple, decontam.digest_table(df, bench).collect()), key=str) == want
    assert sorted(map(tuple, decontam.decontaminate(df, bench).collect()), key=str) == kept
    assert any(r[-1] for r in want) and len(want) == len(rows) + 2


def test_decontamination_by_hand(spark):
    """Repeated rows and null ids each keep their row; overlapping hits count a word once."""
    df = spark.createDataFrame([(None, "x tiny item y"), (1, "x tiny item y"), (1, "x tiny item y"), (2, "the " * 30), (3, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontam.per_document(df, spark.createDataFrame(BENCH, "item_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 4, 2, 1), (1, 4, 2, 1), (1, 4, 2, 1), (2, 30, 30, 1), (3, 0, 0, 0)], key=str)


def test_quality_rows(spark):
    """A row's measures are its text's, whatever its id; repeated rows and null ids stay, and clashing columns are left alone."""
    body = " ".join(f"w{i}" for i in range(70))
    rows = [(1, body, "s"), (1, body, "s"), (None, body, "s"), (None, None, None), (2, body + "\n" + body, "t"), (3, "é" * 9000, "t")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, n_words int, rate string")
    got = quality.quality_table(df).collect()
    assert len(got) == len(rows) and len({r[1:] for r in got if r.n_words == 70}) == 1
    assert {(r.doc_id, r.n_words, r.kept) for r in got} >= {(None, 0, False), (3, 1, False), (1, 70, True)}
    assert quality.quality_filter(df).columns == df.columns


def test_pipeline_edges(spark, tmp_path):
    """An empty table gives no row; repeated rows, nulls and clashing columns pass through every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, h long, rep long, comp long, length int"
    body = " ".join(f"v{i}" for i in range(80))
    rows = [(5, body, "en", "s", 1), (5, body, "en", "s", 1), (None, "null " + body[::-1], None, None, None), (6, None, "en", None, None), (7, "", "en", "s", 0)]
    for name, some in (("none", []), ("some", [(*r, "k", 1, 2, 3, 4, 5) for r in rows])):
        path = tmp_path / name
        spark.createDataFrame(some, schema).write.parquet(str(path / "documents.parquet"))
        spark.createDataFrame([(1, "q " * 12)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
        docs = spark.read.parquet(str(path / "documents.parquet"))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = staged(stage(spark, docs, str(path)), "edge")
            if k + 1 < len(corpus_pipeline.STAGES):
                assert [c for c in docs.columns] == [x.split()[0] for x in schema.split(", ")]
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert ids == [] if name == "none" else sorted(ids, key=str) == [5, None] or sorted(ids, key=str) == [5, 5, None]


def test_exchange_grows_with_the_text():
    """Suffixes: what goes between groups and parts is at most a row for SENT anchors, at every size."""
    for total in (0, 1, 1 << 22, 1 << 30, 1 << 35, 1 << 36, 1 << 40, 1 << 44, 1 << 47):
        groups, parts = suffixes.exchange(total)
        assert groups >= 1 and parts >= 1 and (groups - 1) * parts <= total / (suffixes.GRAM * suffixes.SENT)


def test_large_families(spark, monkeypatch):
    """Near copies beyond a block's bounds: hubs, then what is outside of the largest component against all of it."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(14)):
            w[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, neardup.near_duplicates(df, 3, 85, 100).collect()))
    monkeypatch.setattr(neardup, "BLOCK", 7)
    assert sorted(map(tuple, neardup.near_duplicates(df, 3, 85, 100).collect())) == want
    assert 1 < len({r[2] for r in want}) < 60


def test_lines_on_registered_parameters(spark):
    """Near lines of the production thresholds and bound, against all pairs of lines."""
    rng = random.Random(11)
    seeds = ["".join(rng.choice("abcde ") for _ in range(n)) for n in (9, 12, 18, 25, 34, 50)]
    all_lines = []
    for s in seeds:
        for _ in range(12):
            t = list(s)
            for _ in range(rng.randrange(5)):
                t[rng.randrange(len(t))] = rng.choice("abcde ")
            all_lines.append("".join(t))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    limit = lambda a, b: max([k for n, k in lines.GRADED if min(len(a), len(b)) >= n], default=-1)
    distinct = sorted(set(all_lines))
    first = {t: i for i, t in reversed(list(enumerate(all_lines)))}
    near = {a: any(first[b] < first[a] and len(a) >= 10 <= len(b) and edits(a, b) <= limit(a, b) for b in distinct if a != b) for a in distinct}
    df = spark.createDataFrame(list(enumerate(all_lines)), "doc_id long, text string")
    got = {r.doc_id: r.n_near for r in lines.line_table(df, lines.GRADED, short=True).collect()}
    assert got == {i: int(near[t] and first[t] == i) for i, t in enumerate(all_lines)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert lines.line_table(none, lines.GRADED, short=True).collect() == [] and suffixes.remove_repeats(none).collect() == []
    assert packing.pieces(none, __import__("public_tokenizers").path("word_bpe_49k.json")).collect() == []
