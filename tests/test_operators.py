import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.functions import rules, text
from quillspark.operators import arrow_ops, geometry, ordered, records, terms
from quillspark.sources import documents, logs
from quillspark.streaming import events as stream


def one(spark, *columns, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return tuple(df.select(*columns).first())


@pytest.mark.parametrize(
    "value, reason",
    [
        ("  ", "empty_source_text"), (None, "empty_source_text"), ("<f1-abc/> <t2-0f0/>", "placeholder_only"), ("https://a.example/x", "hard_metadata_fragment"), ("(www.a.example)", "hard_metadata_fragment"),
        ("me@a.example", "hard_metadata_fragment"), ("Copyright 2020 A. All rights reserved.", "hard_metadata_fragment"), ("copyright note; written permission is needed", None),
        (" ".join(["0A"] * 40), "protocol_hex_dump"), ("Plain prose is translated.", None),
    ],
)
def test_verdict(spark, value, reason):
    assert one(spark, rules.policy_verdict(F.col("x"))[1], x=value)[0] == reason


def test_text_predicates(spark):
    got = lambda f, x: one(spark, f(F.col("x")), x=x)[0]
    assert got(text.is_reference_entry, "[12] Smith, J. A. Nature 2001, 12, 33-40.")
    assert not got(text.is_reference_entry, "This is a plain sentence, no more.")
    assert got(text.is_code_literal, "x = f(a, b); y[i] += 2; call_me(z)")
    assert not got(text.is_code_literal, "This is the method that was used, because it works well.")
    assert got(text.is_garbled, "�� abc") and got(text.is_garbled, "") and not got(text.is_garbled, "fine text")
    assert got(text.text_flow, "a\n\nb\nc") == "preserve_lines" and got(text.text_flow, "a\nb") == "flow"
    assert got(text.cjk_chars, "中文 x") == 2 and got(text.english_words, "well-known it's") == 2
    assert got(text.plain_text, "<p>a <b>b</b></p>\n c") == "a b c"
    assert one(spark, text.pair_decision(F.col("a"), F.col("b")), a="it was shown that the", b="result holds")[0] == "join"
    assert one(spark, text.pair_decision(F.col("a"), F.col("b")), a="It ended.", b="A NEW HEADING")[0] == "break"


def test_error_taxonomy(spark):
    df = spark.createDataFrame([("429 and 503", None), ("x", 503), ("Timed out", None), ("", 401), ("connection lost", None), (None, None)], "m string, s int")
    assert [r.x for r in df.select(rules.error_taxonomy(F.col("m"), F.col("s")).alias("x")).collect()] == ["rate_limit", "transport", "protocol", "protocol", "transport", "protocol"]


def test_flat_ocr(spark, tmp_path):
    kinds = ["title", "body", "abstract", "heading", "body", "page_number", "reference_entry"]
    doc = {"provider": "generic_flat_ocr", "pages": [{"width": 1, "height": 1, "unit": "pt", "blocks": [{"type": "text", "sub_type": k, "bbox": [0, 0, 1, 1], "text": k} for k in kinds] + [{"type": "Image", "bbox": []}]}]}
    (tmp_path / "one.json").write_text(json.dumps(doc))
    got = documents.read_flat_ocr(spark, f"{tmp_path}/*.json").orderBy("ord").collect()
    assert [r.block_id for r in got][:2] == ["p001-b0000", "p001-b0001"] and got[0].document_id == "one"
    assert [r.semantic_role for r in got] == ["unknown", "metadata", "abstract", "unknown", "body", "metadata", "reference", "unknown"]
    assert [r.policy_reason for r in got][1:4] == ["provider_front_matter:title_abstract_gap", "provider_body_whitelist:abstract", "provider_body_whitelist:heading"]
    assert got[-1].policy_reason == "provider_non_text:image" and [r.policy_translate for r in got] == [False, False, True, True, True, False, False, False]
    assert documents.violations(documents.read_flat_ocr(spark, f"{tmp_path}/*.json")).count() == 0


def test_adapters(spark, tmp_path):
    seg = lambda x: [{"type": "text", "content": x}]
    files = {
        "flat": {"provider": "generic_flat_ocr", "pages": [{"blocks": [{"text": "a"}]}]},
        "labels": {"layoutParsingResults": [{"prunedResult": {"parsing_res_list": [{"block_label": "doc_title", "block_content": "T"}, {"block_label": "abstract", "block_content": "A", "block_bbox": [0, 0, 1, 2]}, {"block_label": "number", "block_content": "3"}]}}]},
        "tree": {"pdf_info": [{"para_blocks": [{"type": "text", "lines": [{"spans": [{"content": " x  y "}, {"content": "z"}]}]}, {"type": "image", "blocks": [{"type": "image_body"}, {"type": "image_caption", "lines": [{"spans": [{"content": "cap"}]}]}]}]}]},
        "list": [[{"type": "title", "content": {"title_content": seg("T")}}, {"type": "list", "content": {"list_items": [{"item_content": seg("i")}, {"item_content": seg("j ")}]}}], [{"type": "image", "content": {}}]],
        "none": {"x": 1},
    }
    for name, doc in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    got = documents.read_any(spark, f"{tmp_path}/*.json").orderBy("document_id", "page_index", "ord").collect()
    rows = [(r.document_id, r.provider, r.block_id, r.kind, r.sub_type, r.text, r.policy_reason) for r in got]
    assert rows == [
        ("flat", "generic_flat_ocr", "p001-b0000", "text", "body", "a", "provider_body_whitelist:body"),
        ("labels", "layout_labels", "p001-b0000", "text", "title", "T", "semantic_role=unknown"), ("labels", "layout_labels", "p001-b0001", "text", "body", "A", "semantic_role=abstract"),
        ("labels", "layout_labels", "p001-b0002", "text", "page_number", "3", "layout_role=page_number"),
        ("list", "content_list", "p001-b0000", "text", "title", "T", "semantic_role=unknown"), ("list", "content_list", "p001-b0001", "text", "body", "i j", "main_text"), ("list", "content_list", "p002-b0000", "image", "figure", "", "non_text"),
        ("tree", "layout_tree", "p001-b0000", "text", "body", "x y z", "main_text"), ("tree", "layout_tree", "p001-b0001", "image", "figure", "", "non_text"), ("tree", "layout_tree", "p001-b0002", "image", "figure", "", "non_text"),
        ("tree", "layout_tree", "p001-b0003", "text", "metadata", "cap", "semantic_role=metadata"),
    ]
    raw = spark.createDataFrame([("d", json.dumps(files["list"])), ("e", "{}")], "document_id string, json string")
    assert [r.detected for r in documents.detect(raw).orderBy("document_id").collect()] == ["content_list", None]


def test_derived_roles(spark):
    rows = [("text", "", "", "", "", None), ("text", "footnote", "", "", "", None), ("image", "", "", "", "", None), ("text", "body", "", "", "", False), ("text", "reference_entry", "", "", "", None)]
    df = spark.createDataFrame(rows, "kind string, sub_type string, layout_role string, semantic_role string, structure_role string, explicit_translate boolean")
    got = [(r.layout_role, r.semantic_role, r.policy_translate, r.policy_reason) for r in documents.derived_roles(df).collect()]
    assert got == [("paragraph", "body", True, "main_text"), ("footnote", "metadata", False, "layout_role=footnote"), ("unknown", "unknown", False, "non_text"), ("paragraph", "body", False, "explicit_policy"), ("paragraph", "reference", False, "semantic_role=reference")]


EVENTS = [{"job_id": "a", "seq": i, "ts": f"2024-01-01T00:00:{i:02d}Z", "stage": s, "level": "info", "event": "e", "progress_current": p} for i, (s, p) in enumerate([("ocr", 1), ("ocr", 3), ("ocr", 2), ("render", 5)])]


def test_event_log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text("\n".join([*map(json.dumps, EVENTS), "", "{broken", json.dumps(EVENTS[0] | {"job_id": "b"})]))
    got = logs.read_events(spark, str(tmp_path / "log.jsonl"), "a")
    assert got.count() == 4
    child = spark.createDataFrame([("a-ocr", 1, "2024-01-01T00:00:01Z", "x", None)], "job_id string, seq long, ts string, event string, payload string")
    both = logs.combined(got, got.limit(0), child).orderBy("seq").collect()
    assert [r.seq for r in both] == [1, 2, 3, 4, 5] and {r.job_id for r in both} == {"a"} and both[2].origin in ("child", "db")
    new = logs.append_events(got, got.where("seq < 2"), "ts").orderBy("seq").collect()
    assert [r.seq for r in new] == [4, 5]


def test_stream_as_batch(spark, tmp_path):
    for i, e in enumerate(EVENTS):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.jsonl").write_text(json.dumps(e))
    got = stream.read(spark, str(tmp_path / "in"))
    for name, df in (("stream_progress", stream.progress(got)), ("stream_state", stream.latest_state(got))):
        run = df.writeStream.outputMode("complete").format("memory").queryName(name).start()
        run.processAllAvailable()
        run.stop()
    assert {(r.stage, r.progress_current, r.n_events) for r in spark.table("stream_progress").collect()} == {("ocr", 3, 3), ("render", 5, 1)}
    assert [tuple(r) for r in spark.table("stream_state").collect()] == [("a", "render", "e", 5)]
    run = got.writeStream.option("maxFilesPerTrigger", 1).option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(stream.upsert_into(spark, f"{tmp_path}/table", ["job_id", "stage"], "seq")).start()
    run.processAllAvailable()
    run.stop()
    last = max((tmp_path / "table").glob("v=*"), key=lambda p: int(p.name[2:]))
    assert {(r.stage, r.seq) for r in spark.read.parquet(str(last)).collect()} == {("ocr", 2), ("render", 3)}


def test_glossary(spark, tmp_path):
    (tmp_path / "h.csv").write_text('﻿Target,Source\n"b, c",a\n,x\nz,\n')
    (tmp_path / "n.csv").write_text("a,1\nA ,2\nb,3\n")
    assert {(r.source, r.target) for r in logs.read_glossary(spark, str(tmp_path / "h.csv")).collect()} == {("a", "b, c"), ("x", "")}
    plain = logs.read_glossary(spark, str(tmp_path / "n.csv"))
    merged = {r.term_key: (r.source, r.target) for r in terms.merge(plain, plain.limit(0)).collect()}
    assert merged == {"a": ("A", "2"), "b": ("b", "3")}
    assert '"b, c"' in logs.glossary_csv(logs.read_glossary(spark, str(tmp_path / "h.csv"))).orderBy("pos").first().line
    many = spark.range(terms.MOST_ENTRIES + 1).select(F.col("id").cast("string").alias("term"))
    with pytest.raises(ValueError):
        terms.matches(spark.createDataFrame([("x",)], "t string"), many, "t", "term")
    hits = terms.matches(spark.createDataFrame([("a C++ text",), ("ac++x",)], "t string"), spark.createDataFrame([("c++",), ("text",)], "term string"), "t", "term")
    assert Counter(r.term for r in hits.collect()) == {"c++": 1, "text": 1}


def test_replace_all_and_upsert(spark):
    old, new = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "c", 5)], "k int, v string, n int"), spark.createDataFrame([(1, "x", 2), (2, "old", 4)], "k int, v string, n int")
    assert {tuple(r) for r in records.replace_all(old, new, ["k"]).collect()} == {(1, "x", 2), (2, "old", 4)}
    assert {tuple(r) for r in records.upsert(old.where("v != 'b'"), new, ["k"], "n").collect()} == {(1, "x", 2), (2, "c", 5)}


def test_arrow_operators(spark):
    assert one(spark, arrow_ops.copy_ratio(F.col("a"), F.col("b")), a="abcd", b="bcde")[0] == 0.75
    df = spark.createDataFrame([(r"x $a+b$ y \(c\) z",)], "t string").withColumn("p", arrow_ops.protect(F.col("t")))
    r = df.select("t", "p.text", arrow_ops.restore(F.col("p.text"), F.col("p.tokens")).alias("back")).first()
    assert "$" not in r.text and r.back == r.t


def test_adaptive_limits(spark):
    """Cases of each rule, from 16 workers: (success, status, error, ms) and the limit after it."""
    cases = {
        "overload": [((False, 429, None, 1), 8), ((False, 503, None, 1), 8)], "other failures": [((False, 404, None, 1), 16), ((False, None, "ValueError", 1), 16), ((False, None, "ReadTimeout", 1), 8)],
        "slow": [((True, 200, None, 45_000), 16), ((True, 200, None, 50_000), 13), ((True, 200, None, 60_000), 9), ((True, 200, None, 90_000), 8)],
        "growth": [((False, 500, None, 1), 8), *[((True, 200, None, 16_000 if i == 3 else 10), 8) for i in range(11)], ((True, 200, None, 15_000), 9), ((True, 200, None, 10), 9)],
        "full": [((True, 200, None, 10), 16)] * 14,
    }
    rows = [(run, i, *request) for run, steps in cases.items() for i, (request, _) in enumerate(steps)]
    df = spark.createDataFrame(rows, "run string, i int, success boolean, status_code int, error_class string, elapsed_ms int")
    got = {(r.run, r.i): r.limit for r in arrow_ops.adaptive_limits(df, "run", "i", workers=16).collect()}
    assert got == {(run, i): limit for run, steps in cases.items() for i, (_, limit) in enumerate(steps)}
    assert {r.limit for r in arrow_ops.adaptive_limits(df.where("run = 'overload' and i = 0"), "run", "i", workers=16, roomy=True).collect()} == {12}


def test_page_numbers_and_dollars(spark):
    x = lambda c: [r.x for r in c]
    df = spark.createDataFrame([("1-3,7",), (" 7, 2 - 3 ,2",), ("3-1",), ("x,5",), ("",), (None,), ("0-1",), ("2-9",), (" , ",)], "p string")
    assert x(df.select(text.page_numbers(F.col("p"), F.lit(8)).alias("x")).collect()) == [[1, 2, 3, 7], [2, 3, 7], None, None, [*range(1, 9)], [*range(1, 9)], None, None, None]
    df = spark.createDataFrame([(r"$a$ \$5",), (r"\$",), (None,)], "p string")
    assert x(df.select(text.unescaped_dollars(F.col("p")).alias("x")).collect()) == [2, 0, 0]


def test_failure_category(spark):
    df = spark.createDataFrame([("socket.gaierror; timed out",), ("403",), ("source pdf not found 429",), (None,), ("downloading @preview/x",)], "m string")
    got = df.select(rules.failure_category(F.col("m")).alias("c"), rules.failure_retryable(F.col("m")).alias("r")).collect()
    assert [tuple(r) for r in got] == [("dns_resolution_failed", True), ("auth_failed", False), ("source_pdf_missing", False), ("unknown", True), ("typst_dependency_download_failed", True)]


def test_islands_with_gaps(spark):
    df = spark.createDataFrame([("g", i, x) for i, x in enumerate([0, 1, 1, 0, 1])], "g string, i int, x int")
    assert [r.island for r in ordered.islands(df, ["g"], ["i"], F.col("x") == 1).orderBy("i").collect()] == [1, 1, 1, 2, 2]


def test_subtract_keeps_area(spark):
    a = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0)], "x0 double, y0 double, x1 double, y1 double").alias("a")
    b = spark.createDataFrame([(2.0, 3.0, 5.0, 20.0)], "x0 double, y0 double, x1 double, y1 double").alias("b")
    pieces = geometry.subtract(a.crossJoin(b), "a", "b").select("__piece.*").collect()
    assert sum((p.x1 - p.x0) * (p.y1 - p.y0) for p in pieces) == 100 - 21
