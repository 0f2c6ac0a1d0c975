"""Why jobs failed: cases by hand."""

import json

from quillspark.operators import failures

KIND = "id int, error string, log_tail array<string>, stage string, stage_detail string, provider string, provider_auth boolean, provider_code string, success boolean, return_code int, stderr string, stdout string"


def classify(spark, *jobs):
    names = [part.split()[0] for part in KIND.split(", ")]
    rows = [tuple({"id": i, **job}.get(n) for n in names) for i, job in enumerate(jobs)]
    return [r.failure for r in failures.classified(spark.createDataFrame(rows, KIND)).orderBy("id").collect()]


def test_categories_in_order(spark):
    got = classify(
        spark, {"error": "401 NameResolutionError host='api.a.com'", "provider_auth": True, "provider_code": "A0202", "provider": "Mineru"}, {"error": "429 NameResolutionError at https://api.b.com/x"}, {"error": "ReadTimeout", "success": False, "return_code": -1},
        {"error": "boom", "success": False, "return_code": -1, "stderr": "Traceback (most recent call last):\n  x\nValueError: bad: thing"}, {"log_tail": ["degraded to keep_origin after repeated placeholder instability"]}, {"error": "source pdf not found: /a 401"},
        {"error": "HTTP 403"}, {"error": "Too Many Requests"}, {"error": "downloading @preview/x failed to compile"}, {"error": "No such file or directory: font.ttf"}, {"success": False, "return_code": 3}, {"error": "odd", "provider_code": "P1"}, {},
    )
    assert [(f.category, f.retryable) for f in got] == [
        ("auth_failed", False), ("dns_resolution_failed", True), ("upstream_timeout", True), ("process_timeout", True), ("placeholder_unstable", True), ("source_pdf_missing", False), ("auth_failed", False), ("rate_limited", True),
        ("typst_dependency_download_failed", True), ("render_failed", False), ("process_exit_failed", True), ("unknown", True), ("unknown", True),
    ]
    assert [f.code for f in got] == ["A0202", None, None, "timeout", None, None, None, None, None, None, "exit_code_3", "P1", None]
    assert (got[0].upstream_host, got[0].provider, got[1].upstream_host) == ("api.a.com", "mineru", "api.b.com")
    assert (got[3].exception_type, got[3].exception_message, got[3].traceback) == ("ValueError", "ValueError: bad: thing", "Traceback (most recent call last):\n  x\nValueError: bad: thing")
    assert got[10].exception_message == "process exited with code 3" and got[12].exception_message is None and got[12].last_log_line is None
    assert [got[i].stage for i in (5, 8, 9, 11)] == ["normalization", "render", "render", "failed"] and got[6].summary == "鉴权失败"


def test_stages(spark):
    got = classify(spark, {"stage": "rendering"}, {"stage_detail": "正在翻译"}, {"error": "Normalization broke"}, {"error": "paddle died"}, {"stage": "translation", "error": "typst error"}, {"stage": "queued"})
    assert [f.stage for f in got] == ["render", "translation", "normalization", "ocr", "render", "failed"]


def test_the_line_that_is_shown(spark):
    tail = ["Rendered page 3", "got 429 from api", " rate LIMIT again ", "saved out.pdf", "cover page image x", ""]
    got = classify(spark, {"log_tail": tail}, {"error": "first 429\nsecond\n", "log_tail": tail}, {"error": "none here: Too Many Requests", "log_tail": ["a"]}, {"log_tail": ["last words", "saved x"]}, {"error": "HTTP 401", "log_tail": ["x"]}, {"error": "a\nb\n \n"})
    assert [f.last_log_line for f in got] == ["rate LIMIT again", "first 429", "none here: Too Many Requests", "last words", "HTTP 401", "b"]
    assert [f.excerpt for f in got] == ["Rendered page 3", "first 429", "none here: Too Many Requests", "last words", "HTTP 401", "a"]


def test_the_workers_own_report_comes_first(spark):
    report = {"stage": "translation", "error_type": "llm_refused", "summary": " ", "retryable": False, "raw_exception_type": "E", "raw_exception_message": "m", "provider": "deepseek", "more": 1}
    label = failures.LABEL
    got = classify(
        spark, {"error": f"429\n{label}: {json.dumps(report)}\n{label}: {{broken", "provider_code": "P"}, {"log_tail": [f"{label}: {{}}", f'{label}: {{"summary": 3}}']}, {"error": f"{label}:", "log_tail": ["429"]},
    )
    f = got[0]
    assert (f.stage, f.category, f.retryable, f.code, f.provider, f.exception_type, f.exception_message, f.excerpt) == ("translation", "llm_refused", False, "P", "deepseek", "E", "m", "429")
    assert f.summary == failures.SUMMARIES["unknown"] and f.last_log_line == f"{label}: {{broken"
    assert (got[1].category, got[1].retryable, got[1].stage) == (failures.UNHANDLED, True, "failed")
    assert got[2].category == "rate_limited" and got[2].excerpt is None
