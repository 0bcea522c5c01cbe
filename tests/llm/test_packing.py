"""Packing: token ids against the tokenizer, and what a packing must keep."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from terrafold.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Don't we'll x'S ''s", None, "", " ", "naïve Ünïcode ½3² — “q”", "ſ Σας İ Ⱥ", "a\x1cb\x85c", "<|endoftext|> x", "word " * 5000, "tie", "tie", "漢字 かな"]


def test_encoder():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    texts = [x or "" for x in TEXTS]
    encode = packing.WordEncoder(PATH)
    for _ in range(2):
        assert [list(x) for x in encode(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_plan_holds_the_histogram():
    rng = np.random.default_rng(1)
    for n in (1, 10, 3000):
        counts = Counter(map(int, np.minimum(2048, rng.lognormal(6, 1, n).astype(int) + 1)))
        made = packing.plan(dict(counts))
        got = Counter()
        for p, k in made:
            assert sum(p) <= 2048 and k > 0
            for a in p:
                got[a] += k
        assert got == counts
        least = -(-sum(a * c for a, c in counts.items()) // 2048)
        assert sum(k for _, k in made) <= least * 1.03 + 1


def test_fit_finds_known_counts():
    """Where patterns hold a histogram exactly, the fit's residue vanishes, against a dense solution by projected gradients."""
    pool, truth = [(1500, 548), (1024, 1024), (1000, 548, 500)], np.array([40.0, 25.0, 60.0])
    lengths = sorted({a for p in pool for a in p})
    a = np.array([[p.count(n) for p in pool] for n in lengths], float)
    counts = dict(zip(lengths, (a @ truth).astype(int).tolist(), strict=True))
    assert np.allclose(packing.fitted(counts, pool), truth, atol=0.05)
    rng = np.random.default_rng(2)
    for _ in range(5):
        h = rng.integers(0, 50, len(lengths)).astype(float)
        x = np.zeros(len(pool))
        for _ in range(20_000):
            x = np.maximum(0, x - 0.05 * a.T @ (a @ x - h))
        got = np.array(packing.fitted(dict(zip(lengths, h, strict=True)), pool))
        assert (got >= 0).all() and np.allclose(((a @ got - h) ** 2).sum(), ((a @ x - h) ** 2).sum(), rtol=0.01, atol=0.01)


def test_parts_of_text(monkeypatch):
    """Bulk parting against the tokenizer on random text, in slices of every size."""
    import random

    rng, t = random.Random(4), Tokenizer.from_file(PATH)
    alpha = [*"aeszßrtmdlv'' \n\t.,;!1²½9ÿŸÀé×÷Łłŉ_-\"", "'s", "'re", "'ll", "'ve", "''", "'d ", "漢"]
    texts = ["".join(rng.choice(alpha) for _ in range(rng.randrange(60))) for _ in range(3000)]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    for size in (7, 500, 1 << 20):
        monkeypatch.setattr(packing, "SLICE", size)
        assert [list(x) for x in packing.WordEncoder(PATH, added=True)(texts)] == want


def test_hot_length(spark, monkeypatch):
    """A length that most pieces have is ranked in parts, and still packed whole."""
    monkeypatch.setattr(packing, "RANKED", 10)
    df = spark.createDataFrame([(k, "tie " * 300) for k in range(100)], "doc_id long, text string")
    rows = packing.pack(df, PATH).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 100 and len({r.sequence_id for r in rows}) == 17


def test_pack(spark):
    df = spark.createDataFrame([(i if i % 5 else None, t, 3) for i, t in enumerate(TEXTS)], "doc_id long, text string, rank int")
    rows = packing.pack(df, PATH).collect()
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    want = []
    for i, x in enumerate(TEXTS):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i if i % 5 else None, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 2048


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_added_tokens(spark, tmp_path):
    """The registered query gives the ids of the tokenizer's plain call."""
    from terrafold.llm import registry

    t = Tokenizer.from_file(PATH)
    texts = [*(x or "" for x in TEXTS), "hello <|endoftext|> world", "a<|startoftext|>b", "x <|ENDOFTEXT|> y"]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [list(x) for x in packing.WordEncoder(PATH, added=True)(texts)] == want
    assert want[-3] == [3306, 49407, 1002]
    spark.createDataFrame([(1, texts[-3])], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [r.length for r in registry.op1_pattern_packing(spark, str(tmp_path)).collect()] == [4]
