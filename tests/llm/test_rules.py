"""Quality rules and decontamination against their SQL; license places and URL rules against brute force; edge cases."""

import re

import duckdb
import pytest

from terrafold.llm import decontam, licenses, quality, sql, urls

LONG = " ".join(f"word{i}" for i in range(60))
TEXTS = [LONG, None, "", "short text", "a b c " * 40, LONG + "\n# $ % &", "The MIT License and the Apache  license.", "x\n" * 5, LONG, "Café général public license MIT-license"]


def docs(spark):
    rows = [(i if i != 8 else 0, t, "s" if i % 2 else None, 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, host int")


BENCH = [(1, " ".join(f"word{i}" for i in range(20, 35))), (2, "short text"), (3, None), (4, "")]


@pytest.mark.parametrize("name", ["op5_quality_rules", "op9_decontaminate"])
def test_against_sql(spark, name):
    df = docs(spark).where("doc_id > 0")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    con = duckdb.connect()
    documents, benchmark = df.toPandas(), bench.toPandas()  # noqa: F841  read by DuckDB
    con.register("documents", documents)
    con.register("benchmark", benchmark)
    got = quality.quality_table(df) if name.startswith("op5") else decontam.digest_table(df, bench)
    rel = con.sql(f"SELECT {', '.join(got.columns)} FROM ({sql.ALL[name]})")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rel.fetchall(), key=str)


def test_removal_keeps_clean_documents(spark):
    bench = spark.createDataFrame(BENCH[:1], "item_id long, text string")
    left = decontam.decontaminate(docs(spark), bench).collect()
    assert sorted((r.text or "") for r in left) == sorted((t or "") for t in TEXTS if not t or "word20" not in t)
    cut = [r.text for r in decontam.decontaminate(docs(spark), bench, remove="spans").collect()]
    assert sum("word19" in (t or "") for t in cut) == 3 and not any("word25" in (t or "") for t in cut)


def test_license_places(spark):
    phrases = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
    want = []
    for i, t in enumerate(TEXTS):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, a) for a, p in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want.append((i if i != 8 else 0, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({a for _, a in at}))))
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs(spark)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    for r in licenses.scan(docs(spark)).collect():
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_url_rules(spark):
    rows = [(1, "http://a.EXAMPLE.org/en/1?q"), (2, "x://example.org/es/y"), (3, "https://notexample.org/z"), (4, "http://b.com/fr/#t"), (5, "http://b.com/de/"), (6, None), (7, "no scheme"), (8, "http://example.com")]
    got = {r.page_id: (r.host, r.path, r.rule, r.by_rule) for r in urls.ruled(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {
        1: ("a.example.org", "/en/1", "example.org/en/1", "block"), 2: ("example.org", "/es/y", "example.org/es/", "block"), 3: ("notexample.org", "/z", "org/", "allow"), 4: ("b.com", "/fr/", "com/fr/", "allow"),
        5: ("b.com", "/de/", "com/de/", "block"), 6: ("", "", None, None), 7: ("", "", None, None), 8: ("example.com", "", None, None),
    }


def test_url_model_tells_the_classes_apart(spark):
    rows = [(i, f"http://h{i}.org/page/{i}") for i in range(60)] + [(100 + i, f"http://h{i}.com/de/casino-{i}") for i in range(60)] + [(900, "http://q.net/casino-7"), (901, "http://h5.net/page/5"), (902, None)]
    got = {r.page_id: r.verdict for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(got) == 123 and got[900] == "block" and got[901] == "allow"


def test_empty(spark):
    none = docs(spark).where("false")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert quality.quality_table(none).collect() == quality.quality_filter(none).collect() == licenses.scan(none).collect() == decontam.digest_table(none, bench).collect() == []


def test_freebsd(spark):
    """FreeBSD's keyword lets its rule through where no other word begins with bsd."""
    df = spark.createDataFrame([(1, "Under the FreeBSD license."), (2, "under the simplified BSD license")], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(df).collect()}
    assert all("bsd-2-clause" in str(got[i]) for i in (1, 2)), got
