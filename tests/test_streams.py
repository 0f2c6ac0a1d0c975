"""Jobs and typography as streams, beside the same in batch."""

import math

import pytest
from pyspark.sql import functions as F

from quillspark.streaming import jobs

LINES = "job_id string, seq int, at timestamp, line string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold(*lines, **start):
    job = jobs.Job(**start)
    for line in lines:
        job.apply(line)
    return job


def test_labelled_lines_and_events():
    job = fold("job root: /tmp/job", " source pdf:  /tmp/source.pdf ", "summary:", '{"event_type":"artifact_published","payload":{"artifact_key":"pipeline_summary_json","path":"/tmp/s.json"}}', '{"event_type":"artifact_published","payload":{"artifact_key":"other","path":"x"}}', '{"event_type":', "", None)
    assert job.artifacts == {"job_root": "/tmp/job", "source_pdf": "/tmp/source.pdf", "summary": "/tmp/s.json"} and job.n_lines == 6
    assert fold("batch_id: batch-123", "batch batch-123: state=running").artifacts == {"batch_id": "batch-123"}


def test_stages():
    report = "normalization report json: /tmp/r.json"
    assert fold(report, stage="ocr_processing").stage == "normalizing"
    assert fold(report, stage="translating", stage_detail="x").stage_detail == "x"
    assert fold(report, stage="mineru_new").stage == "normalizing"
    assert (fold("upload done: /tmp/a.pdf").stage, fold("upload done: /tmp/a.pdf").stage_detail) == ("mineru_processing", "文件上传完成，等待 MinerU 处理")
    assert fold("book: completed batch 2/10").stage == "queued"
    assert [fold(f"task t: state={s}").stage for s in ("waiting-file", "pending", "done", "failed", "odd")] == ["mineru_upload", "mineru_processing", "ocr_result_ready", "failed", "mineru_processing"]
    assert fold("task t: state= odd ").stage_detail == "MinerU 状态: odd" and fold("task : state=done").stage == "queued"


def test_metrics_and_tail():
    job = fold("pages processed: 12", "translation time: 3.5s", "render+save time: 1s", "save time: 2s", "total time: 1.2.3s", *[f"line {i}" for i in range(60)])
    assert job.metrics == {"pages_processed": 12, "translate_render_time_seconds": 3.5, "save_time_seconds": 2} and len(job.log_tail) == jobs.TAIL and job.log_tail[-1] == "line 59"


def rows(n, jobs_=4):
    words = ["upload done: /a", "batch b{i}: state=running", "pages processed: {i}", "task t{i}: state=done", "normalization report json: /r{i}", "output pdf: /o{i}", "note {i}", " "]
    return [(f"j{i % jobs_}", i, f"2024-01-01 00:{i // 60 % 60:02d}:{i % 60:02d}", words[i * 7 % len(words)].format(i=i)) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "job_id string, seq int, at string, line string").withColumn("at", F.to_timestamp("at"))


def test_batch_fold_as_one_at_a_time(spark):
    data = rows(300)
    got = {r.job_id: r for r in jobs.folded(frame(spark, data).repartition(5)).collect()}
    for j in got:
        want = fold(*[line for k, _, _, line in data if k == j])
        assert (got[j].stage, got[j].artifacts, got[j].metrics, got[j].log_tail, got[j].n_lines) == (want.stage, want.artifacts, want.metrics, want.log_tail, want.n_lines)
    assert len(got) == 4


@pytest.fixture
def rocks(spark):
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def run(stream, checkpoint):
    """The rows of all that is there by now, in order of the batches."""
    seen = []
    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: seen.extend(df.collect())).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return seen


def test_stream_as_batch_over_restarts_and_expiry(spark, rocks, tmp_path):
    data = rows(90)
    source, last = str(tmp_path / "in"), {}
    for k in range(3):  # each restart finds the state of the run before
        frame(spark, data[k * 30 : k * 30 + 30]).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.follow(spark.readStream.schema(LINES).parquet(source))
        last |= {r.job_id: r for r in run(stream, str(tmp_path / "state"))}
    want = {r.job_id: r for r in jobs.folded(frame(spark, data)).collect()}
    assert {j: r.asDict() for j, r in last.items()} == {j: r.asDict() for j, r in want.items()}
    # a day later the states have gone: the next line begins anew
    frame(spark, [("other", 0, "2024-01-03 00:00:00", "note")]).coalesce(1).write.mode("append").parquet(source)
    run(jobs.follow(spark.readStream.schema(LINES).parquet(source)), str(tmp_path / "state"))
    frame(spark, [("j0", 99, "2024-01-03 00:05:00", "late note"), ("j1", 1, "2024-01-03 00:05:00", "batch b: state=failed")]).coalesce(1).write.mode("append").parquet(source)
    again = {r.job_id: r for r in run(jobs.follow(spark.readStream.schema(LINES).parquet(source)), str(tmp_path / "state"))}
    assert again["j0"].n_lines == 1 and again["j1"].stage == "failed"


def test_typography_in_stream_and_batch(spark, tmp_path):
    data = [("a", 10.0, 0.3), ("a", 10.2, 0.4), ("a", 10.4, 0.35), ("b", 9.0, 0.3), ("b", 12.0, 0.3), ("b", 15.0, 0.3), ("c", 8.0, 0.2), ("a", -1.0, 0.3), ("", 9.0, 0.3), (None, 9.0, 0.3)]
    kind = "feature_key string, font_size double, leading double"
    source = str(tmp_path / "in")
    for part in (data[:2], data[2:]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(source)
        stats = run(jobs.typography(spark.readStream.schema(kind).parquet(source)), str(tmp_path / "state"))
    last = {r.feature_key: r for r in stats}
    mean, m2 = 0.0, 0.0
    for i, x in enumerate((10.0, 10.2, 10.4), 1):  # one at a time
        was, mean = mean, mean + (x - mean) / i
        m2 += (x - was) * (x - mean)
    assert last["a"].observations == 3 and math.isclose(last["a"].font_mean, mean) and math.isclose(last["a"].font_size_std, math.sqrt(m2 / 2))
    got = jobs.relied_on(jobs.typography(spark.createDataFrame(data, kind))).collect()
    assert [tuple(r) for r in got] == [("a", 10.2, 0.35, 3, 0.625)]
