"""Why a job failed: from the worker's own report, the provider, the error and log, or how the process ended; the first that says anything holds.

A failed job has error, log_tail (array), stage, stage_detail, provider, provider_auth (whether the provider's last error was about credentials), provider_code,
success and return_code (of the process, null if it has no result), stderr and stdout. Nulls count as empty. All of it is one expression over the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import rules, text
from quillspark.operators import json_rows

# Categories in the order in which they are tried, whether a job may be retried, the stage if it isn't the job's, what the error or log says, and
# what the line of the log that is shown says.
LABEL = "structured failure json"
DNS = ("Failed to resolve", "NameResolutionError", "Temporary failure in name resolution", "socket.gaierror")
PLACEHOLDERS = ("PlaceholderInventoryError", "UnexpectedPlaceholderError", "placeholder inventory mismatch", "unexpected placeholders in translation", "placeholder instability")
AUTH, LIMIT, TYPST = ("401", "403", "missing or invalid X-API-Key", "Unauthorized"), ("429", "rate limit", "Too Many Requests"), ("packages.typst.org", "failed to download package", "downloading @preview/")
TIMEOUT = ("ReadTimeout", "ConnectTimeout", "timed out")
RENDER = ("typst compile", "typst compilation", "typst error", "failed to compile", "compile error", "render failed", "rendering failed", "failed to render", "missing bundled font", "font not found")
RENDER_LINE = ("typst compile", "failed to compile", "compile error", "render failed", "rendering failed", "failed to render", "typst error", "font not found", "missing bundled font")
SUMMARIES = {
    "auth_failed": "鉴权失败", "dns_resolution_failed": "外部模型服务域名解析失败", "upstream_timeout": "外部服务请求超时", "process_timeout": "Python worker 执行超时", "placeholder_unstable": "公式占位符校验失败", "source_pdf_missing": "源 PDF 缺失",
    "rate_limited": "上游服务触发限流", "typst_dependency_download_failed": "Typst 渲染依赖下载失败", "render_failed": "排版或编译阶段失败", "process_exit_failed": "Python worker 非零退出", "unknown": "任务失败，但暂未识别出明确根因",
}
LINES = {
    "auth_failed": AUTH, "dns_resolution_failed": DNS, "upstream_timeout": (*TIMEOUT, "api.deepseek.com"), "process_timeout": ("timeout", "timed out", "stderr before timeout"), "placeholder_unstable": PLACEHOLDERS, "source_pdf_missing": ("source pdf not found",),
    "rate_limited": LIMIT, "typst_dependency_download_failed": TYPST, "render_failed": RENDER_LINE,
}
FINAL, OWN_STAGE = ("auth_failed", "source_pdf_missing", "render_failed"), {"source_pdf_missing": "normalization", "typst_dependency_download_failed": "render"}
LOW_SIGNAL = ("image-only compress:", "cover page image", "saved ", "rendered page ", "auto render mode selected:")
UNHANDLED, TRACEBACK = "python_unhandled_exception", "Traceback (most recent call last):"
REPORT = "failed_stage string, stage string, failure_code string, error_type string, summary string, retryable boolean, upstream_host string, provider string, provider_code string, raw_excerpt string, raw_exception_type string, raw_exception_message string, traceback string"
BLANKS = " \t\r\n\f\x0b"


def render_signal(x: Column) -> Column:
    """Of a text in lower case."""
    gone = text.has_any(x, ("no such file or directory", "the system cannot find the file specified"))
    return text.has_any(x, RENDER) | (gone & text.has_any(x, ("typst", "font")))


def lines(x: Column) -> Column:
    return F.split(x, "\r?\n")


def trimmed(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def told(x: Column) -> Column:
    """Lines that say something and aren't the worker's report."""
    return F.filter(F.transform(lines(x), trimmed), lambda v: (v != "") & ~v.startswith(LABEL))




def filled(x: Column) -> Column:
    return F.when(trimmed(x) != "", x)


def infer_stage(stage: Column, detail: Column, hay: Column) -> Column:
    both = F.lower(F.concat_ws("\n", stage, detail, hay))
    return (
        F.when(stage.isin("rendering", "render") | text.has_any(detail, ("排版", "渲染")) | render_signal(both), "render")
        .when((stage == "translation") | F.contains(both, F.lit("translation")) | F.contains(detail, F.lit("翻译")), "translation")
        .when(F.contains(both, F.lit("normaliz")) | F.contains(detail, F.lit("标准化")), "normalization")
        .when(text.has_any(both, ("ocr", "mineru", "paddle")) | F.contains(detail, F.lit("解析")), "ocr")
        .otherwise("failed")
    )


def host(hay: Column) -> Column:
    """The first host named, looked for in the order of how it may be written."""
    found = [F.regexp_extract(hay, f"^[\\s\\S]*?{mark}([A-Za-z0-9.-]*)", 1) for mark in ("host='", 'host="', "https://", "http://")]
    return F.coalesce(*[F.when(x != "", x) for x in found])


def relevant_line(error: Column, tail: Column, keywords: Column) -> Column:
    """The last line of the error, else of the log, with one of the keywords (any line if there are none), else the log's last line that isn't mere progress."""
    fits = lambda x: (F.size(keywords) == 0) | F.exists(keywords, lambda k: F.contains(F.lower(x), F.lower(k)))
    low = lambda x: F.exists(F.array(*map(F.lit, LOW_SIGNAL)), lambda p: F.startswith(F.lower(x), p))
    back = lambda a: F.reverse(a)
    of_error = F.get(F.filter(F.transform(back(lines(error)), trimmed), lambda x: (x != "") & fits(x)), F.lit(0))
    signal = F.filter(back(tail), lambda x: (trimmed(x) != "") & ~low(trimmed(x)))
    return F.coalesce(of_error, trimmed(F.get(F.filter(signal, lambda x: fits(trimmed(x))), F.lit(0))), F.get(signal, F.lit(0)))


def reported(hay: Column) -> Column:
    """The worker's last report that can be read, as REPORT; null without one."""
    raw = lambda x: trimmed(F.substring(x, F.lit(len(LABEL) + 2), F.length(x)))
    own = F.filter(F.transform(lines(hay), trimmed), lambda x: F.startswith(x, F.lit(LABEL + ":")) & (raw(x) != ""))
    read = F.filter(F.transform(F.reverse(own), lambda x: json_rows.strict(raw(x), REPORT, "report")), lambda r: r["error"].isNull())
    return F.when(F.contains(hay, F.lit(LABEL)), F.get(read, F.lit(0))["value"])


def classified(jobs: DataFrame) -> DataFrame:
    """The jobs with failure: struct<stage, category, code, summary, retryable, upstream_host, provider, last_log_line, excerpt, exception_type, exception_message, traceback>."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    tail = F.filter(F.coalesce("log_tail", F.array().cast("array<string>")), lambda x: x.isNotNull())
    j = jobs.withColumn("__error", trimmed(empty("error"))).withColumn("__tail", tail)
    j = j.withColumn("__hay", F.when(F.col("__error") == "", F.array_join("__tail", "\n")).otherwise(F.concat_ws("\n", "__error", F.array_join("__tail", "\n"))))
    hay, error = F.col("__hay"), F.col("__error")
    source = F.when(error == "", hay).otherwise(error)
    has, ended = (lambda parts: text.has_any(hay, parts)), F.coalesce(~F.col("success"), F.lit(False))
    category = rules.first_match(
        [
            ("auth_failed", F.coalesce("provider_auth", F.lit(False))), ("dns_resolution_failed", has(DNS)), ("upstream_timeout", has(TIMEOUT)), ("process_timeout", ended & (F.col("return_code") == -1)), ("placeholder_unstable", has(PLACEHOLDERS)),
            ("source_pdf_missing", has(("source pdf not found",))), ("auth_failed", has(AUTH)), ("rate_limited", has(LIMIT)), ("typst_dependency_download_failed", has(TYPST)), ("render_failed", render_signal(F.lower(hay))), ("process_exit_failed", ended),
        ],
        "unknown",
    )
    j = j.withColumn("__report", reported(hay)).withColumn("__category", category)
    r, c = F.col("__report"), F.col("__category")
    by_report = r.isNotNull()
    pick = lambda values, other: rules.first_match([(v, c == k) for k, v in values.items()], other)
    # where the process ended badly, its own output is looked at before the error
    process = F.when(trimmed(empty("stderr")) != "", F.col("stderr")).when(trimmed(empty("stdout")) != "", F.col("stdout")).otherwise(empty("error"))
    origin = F.when(c.isin("process_timeout", "process_exit_failed") & ~by_report, process).otherwise(source)
    message = F.coalesce(F.get(F.reverse(told(origin)), F.lit(0)), F.when(c.isin("process_timeout", "process_exit_failed"), F.concat(F.lit("process exited with code "), F.col("return_code").cast("string"))))
    name = trimmed(F.split_part(message, F.lit(":"), F.lit(1)))
    trace = F.when(F.contains(origin, F.lit(TRACEBACK)), trimmed(F.substring(origin, F.position(F.lit(TRACEBACK), origin), F.length(origin))))
    inferred = infer_stage(empty("stage"), empty("stage_detail"), hay)
    keywords = F.coalesce(*[F.when((c == k) & ~by_report, F.array(*map(F.lit, v))) for k, v in LINES.items()], F.array().cast("array<string>"))
    told_first = F.get(told(source), F.lit(0))
    code = F.when(c == "process_timeout", "timeout").when(c == "process_exit_failed", F.concat(F.lit("exit_code_"), F.col("return_code").cast("string"))).when((c == "unknown") | F.coalesce("provider_auth", F.lit(False)) & (c == "auth_failed"), F.col("provider_code"))
    fields = {
        "stage": F.when(by_report, F.coalesce(filled(r["failed_stage"]), filled(r["stage"]), inferred)).otherwise(F.coalesce(*[F.when(c == k, v) for k, v in OWN_STAGE.items()], inferred)),
        "category": F.when(by_report, F.coalesce(filled(r["failure_code"]), filled(r["error_type"]), F.lit(UNHANDLED))).otherwise(c),
        "code": F.when(by_report, F.coalesce(filled(r["provider_code"]), F.col("provider_code"))).otherwise(code),
        "summary": F.when(by_report, F.coalesce(filled(r["summary"]), F.lit(SUMMARIES["unknown"]))).otherwise(pick(SUMMARIES, None)),
        "retryable": F.when(by_report, F.coalesce(r["retryable"], F.lit(True))).otherwise(~c.isin(*FINAL)),
        "upstream_host": F.when(by_report, F.coalesce(filled(r["upstream_host"]), host(hay))).when(~c.isin("source_pdf_missing", "render_failed"), host(hay)),
        "provider": F.when(by_report, F.coalesce(filled(r["provider"]), F.lower("provider"))).otherwise(F.lower("provider")),
        "last_log_line": relevant_line(error, F.col("__tail"), keywords),
        "excerpt": F.when(by_report, F.coalesce(filled(r["raw_excerpt"]), told_first, r["raw_exception_message"], r["raw_exception_type"])).otherwise(told_first),
        "exception_type": F.when(by_report, r["raw_exception_type"]).when((name != "") & ~F.contains(name, F.lit(" ")), name),
        "exception_message": F.when(by_report, r["raw_exception_message"]).otherwise(message),
        "traceback": F.when(by_report, r["traceback"]).otherwise(trace),
    }
    return j.withColumn("failure", F.struct(*[v.alias(k) for k, v in fields.items()])).select(*jobs.columns, "failure")
