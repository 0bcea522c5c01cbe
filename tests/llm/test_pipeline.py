"""The pipeline on planted documents: what must go goes, clean documents stay and are packed."""

import corpus_pipeline
from terrafold.llm.common import staged


def words(seed, n=80):
    return " ".join(f"w{seed}x{(i * 37 + seed) % 1009}" for i in range(n))


def test_stages(spark, tmp_path):
    clean = {i: words(i) for i in range(1, 8)}
    near = clean[1].split()
    near[40] = "changed"
    rows = [(i, t, "en", "s", len(t)) for i, t in clean.items()]
    rows += [(20, clean[2], "en", "s", 0), (21, " ".join(near), "en", "s", 0), (22, "too short", "en", "s", 9), (23, words(50) + " " + words(99, 12), "en", "s", 0), (24, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, words(99, 12))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, str(tmp_path)), "stage")
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert ids == [{*clean, 20, 21, 23}, {*clean, 21, 23}, {*clean, 23}, set(clean), set(clean)]
