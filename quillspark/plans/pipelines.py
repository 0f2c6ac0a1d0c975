"""Sources, sinks and folds over the given tables: pages written and read by manifest, workers' output folded."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import rounds
from quillspark.operators import failures, ranked
from quillspark.plans.catalog import query, t
from quillspark.plans.jobs import SQL_LOGGED, logged
from quillspark.sources import pages
from quillspark.streaming import jobs


@query("""SELECT 'd' || (conv_id % 50) AS document_id, conv_id AS page_index, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS pos, turn, CASE WHEN conv_id % 3 = 0 THEN 'edited' ELSE sha256(text) END AS text_sha256 FROM conversations""")
def pages_by_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as pages of fifty documents, a third of the pages written again, and everything read by the manifests."""
    root = f"{rounds.shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    c = t(spark, sf_dir, "conversations")
    doc = F.concat(F.lit("d"), (F.col("conv_id") % 50).cast("string")).alias("document_id")
    item = lambda text: F.to_json(F.struct("turn", text.alias("text"))).alias("item")
    at = [doc, F.col("conv_id").alias("page_index"), F.col("turn").cast("int").alias("pos")]
    pages.write(c.select(*at, item(F.sha2("text", 256))), root)
    pages.write(c.where("conv_id % 3 = 0").select(*at, item(F.lit("edited"))), root)
    return pages.read(spark, root).select("document_id", "page_index", "pos", F.from_json("item", "turn bigint, text string").alias("i")).select("document_id", "page_index", "pos", "i.turn", F.col("i.text").alias("text_sha256"))


_LINES = """SELECT user_id AS job, event_id, CASE event_type WHEN 'click' THEN 'pages processed: ' || k WHEN 'view' THEN 'output pdf: /out/' || event_id || '.pdf' WHEN 'purchase' THEN 'task t' || event_id || ': state=' || CASE WHEN k % 2 = 0 THEN 'running' ELSE 'done' END
 WHEN 'signup' THEN 'upload done: /f' || event_id ELSE 'normalization report json: /r' || event_id END AS line, event_type, k FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""


@query(f"""WITH l AS ({_LINES}), r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY event_id DESC) AS back FROM l)
 SELECT CAST(job AS VARCHAR) AS job_id, coalesce(arg_max(CASE event_type WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'mineru_processing' ELSE 'ocr_result_ready' END WHEN 'signup' THEN 'mineru_processing' ELSE 'normalizing' END, event_id) FILTER (event_type IN ('purchase', 'signup', 'error')), 'queued') AS stage,
 arg_max('/out/' || event_id || '.pdf', event_id) FILTER (event_type = 'view') AS output_pdf, arg_max('t' || event_id, event_id) FILTER (event_type = 'purchase') AS task_id, CAST(arg_max(k, event_id) FILTER (event_type = 'click') AS DOUBLE) AS pages_processed,
 count(*) AS n_lines, sha256(string_agg(line, chr(10) ORDER BY event_id) FILTER (back <= {jobs.TAIL})) AS tail_sha256 FROM r GROUP BY job""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a worker's output, folded into a job's state."""
    k, i, kind = F.get_json_object("props", "$.k").cast("long"), F.col("event_id").cast("string"), F.col("event_type")
    text = lambda *x: F.concat(*[F.lit(c) if isinstance(c, str) else c for c in x])
    line = (
        F.when(kind == "click", text("pages processed: ", k.cast("string"))).when(kind == "view", text("output pdf: /out/", i, ".pdf")).when(kind == "purchase", text("task t", i, ": state=", F.when(k % 2 == 0, "running").otherwise("done")))
        .when(kind == "signup", text("upload done: /f", i)).otherwise(text("normalization report json: /r", i))
    )
    got = jobs.folded(t(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), line.alias("line")))
    part = lambda m, name: F.try_element_at(m, F.lit(name)).alias(name)
    return got.select("job_id", "stage", part("artifacts", "output_pdf"), part("artifacts", "task_id"), part("metrics", "pages_processed"), "n_lines", F.sha2(F.array_join("log_tail", "\n"), 256).alias("tail_sha256"))


_KEYWORDS = " ".join(f"WHEN '{c}' THEN '{'|'.join(k.lower().replace('.', '[.]') for k in words)}'" for c, words in failures.LINES.items())
_FAILED = f"""SELECT user_id AS job, CASE WHEN arg_max(event_type, event_id) = 'error' THEN arg_max(message, event_id) ELSE '' END AS error, list_reverse(list_slice(list(message ORDER BY event_id DESC), 1, 2)) AS tail, max(event_id) % 3 <> 0 AS ok, CASE WHEN max(event_id) % 2 = 0 THEN -1 ELSE 2 END AS code FROM {SQL_LOGGED} GROUP BY user_id"""


@query(f"""WITH j AS ({_FAILED}), h AS (SELECT *, CASE WHEN error = '' THEN '' ELSE error || chr(10) END || array_to_string(tail, chr(10)) AS hay FROM j),
 c AS (SELECT *, CASE WHEN regexp_matches(hay, 'Failed to resolve|NameResolutionError|Temporary failure in name resolution|socket[.]gaierror') THEN 'dns_resolution_failed' WHEN regexp_matches(hay, 'ReadTimeout|ConnectTimeout|timed out') THEN 'upstream_timeout' WHEN NOT ok AND code = -1 THEN 'process_timeout'
  WHEN regexp_matches(hay, 'PlaceholderInventoryError|UnexpectedPlaceholderError|placeholder inventory mismatch|unexpected placeholders in translation|placeholder instability') THEN 'placeholder_unstable' WHEN contains(hay, 'source pdf not found') THEN 'source_pdf_missing'
  WHEN regexp_matches(hay, '401|403|missing or invalid X-API-Key|Unauthorized') THEN 'auth_failed' WHEN regexp_matches(hay, '429|rate limit|Too Many Requests') THEN 'rate_limited' WHEN regexp_matches(hay, 'packages[.]typst[.]org|failed to download package|downloading @preview/') THEN 'typst_dependency_download_failed'
  WHEN NOT ok THEN 'process_exit_failed' ELSE 'unknown' END AS category FROM h),
 k AS (SELECT *, CASE category {_KEYWORDS} ELSE '' END AS words FROM c)
 SELECT job, category, category NOT IN ('auth_failed', 'source_pdf_missing', 'render_failed') AS retryable, CASE WHEN error <> '' AND regexp_matches(lower(error), words) THEN error ELSE coalesce(list_filter(list_reverse(tail), lambda x: regexp_matches(lower(x), words))[1], tail[-1]) END AS last_log_line FROM k""")
def job_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each user's job would have failed, by its last two messages and how it ended."""
    e = logged(spark, sf_dir).select(F.col("user_id").alias("job"), "event_id", "event_type", "message")
    last = ranked.last_few(e, ["job"], ["event_id"], "message", 2).withColumnRenamed("last", "log_tail")
    ends = e.groupBy("job").agg(F.max_by(F.when(F.col("event_type") == "error", F.col("message")).otherwise(""), "event_id").alias("error"), F.max("event_id").alias("__i"))
    none = [F.lit(None).cast("string").alias(c) for c in ("stage", "stage_detail", "provider", "provider_code", "stderr", "stdout")]
    ran = [(F.col("__i") % 3 != 0).alias("success"), F.when(F.col("__i") % 2 == 0, -1).otherwise(2).alias("return_code"), F.lit(False).alias("provider_auth")]
    return failures.classified(ends.join(last, "job").select("job", "error", "log_tail", *none, *ran)).select("job", "failure.category", "failure.retryable", "failure.last_log_line")
