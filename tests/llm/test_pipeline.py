import re

from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import common, near


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({"n_kept": F.lit(1), "class_id": F.lit("x"), "id": F.lit(0.5), "text_hash": F.lit("h")})
    n = docs.count()
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, common.written(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == before.columns
        assert 0.5 * n < docs.count() <= before.count(), name
        assert docs.join(before, "doc_id", "left_anti").count() == 0
    items = [plain(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(x in plain(r.text) for r in docs.collect() for x in items)
    name, last = corpus_pipeline.STAGES[-1]
    made = last(spark, docs, sf_dir).collect()
    assert len(made) == docs.count() and all(r.same_text and len(r.ids) == r.n_tokens for r in made)


def test_pipeline_of_hard_rows(spark, tmp_path):
    t = "one two three four five six seven eight nine ten"
    rows = [(1, t, "en", "a", 1), (1, t, "en", "a", 1), (None, t + "\n" + t.upper(), None, None, None), (2, None, None, None, None), (3, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for to in (tmp_path, tmp_path / "none"):
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # the earliest line is the null id's; null and empty texts are equal texts, of which the least id stays
    assert sorted((r.doc_id or 0, r.n_tokens > 0) for r in got) == [(0, True), (2, False)]
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_line_dedup_of_more_than_is_broadcast(spark, sf_dir, monkeypatch):
    """The same documents where nothing is broadcast and every class meets by band."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = lambda: sorted(((r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, docs, sf_dir).collect()), key=str)
    want = rows()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(near, "FEW", 1)
    got = rows()
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sum(a != b for a, b in zip(got, want, strict=True)) <= len(want) // 100  # by band a pair at the threshold is found with probability 0.998
