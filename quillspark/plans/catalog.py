"""The queries over the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import rules, text
from quillspark.operators import geometry, ordered, ranked, records, terms

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """For work that is heavy by row: rows of fewer partitions than there are cores, as of one small file, are dealt to all. Large tables stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ord from 0, line."""
    return spread(t(spark, sf_dir, "documents").select("doc_id", "lang", "text")).select("doc_id", "lang", F.posexplode(F.split(text.empty_for_null(F.col("text")), "\n")).alias("ord", "line"))


# The same in SQL.
SQL_LINES = "(SELECT doc_id, lang, CAST(i - 1 AS INT) AS ord, ls[i] AS line FROM (SELECT doc_id, lang, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i))"
SP = r"[ \t\r\n\f\x0B]+"


def sql_norm(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SP}', ' ', 'g'))"


def q(pattern: str) -> str:
    """A pattern as an SQL string."""
    return "'" + pattern.replace("'", "''") + "'"


def sql_match(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def sql_count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def sql_strip(x: str) -> str:
    ws = "' ' || chr(9) || chr(13) || chr(10) || chr(12) || chr(11)"
    return f"trim(trim(coalesce({x}, ''), {ws}), {q(text.AROUND)})"


def sql_any(x: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(p)})" for p in parts) + ")"


def sql_list(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


def sql_url(x: str) -> str:
    return sql_match(sql_strip(x), text.URL)


def sql_email(x: str) -> str:
    return sql_match(sql_strip(x), text.EMAIL)


def sql_copyright(x: str) -> str:
    n = sql_norm(x)
    return f"(length({n}) <= 220 AND {sql_count(n, text.WORD)} <= 32 AND {sql_match(n, text.COPYRIGHT)} AND {sql_any(f'lower({n})', text.COPYRIGHT_SIGNALS)} AND NOT {sql_any(f'lower({n})', text.DISCLAIMERS)})"


def sql_hex(x: str) -> str:
    tok = f"string_split({sql_norm(x)}, ' ')"
    b = f"len(list_filter({tok}, lambda w: {sql_match('w', text.HEX_BYTE)}))"
    return f"(len({tok}) >= 24 AND (({b} >= 32 AND {b} >= 0.55 * len({tok})) OR ({b} >= 128 AND {b} >= 0.35 * len({tok}))))"


@query(f"SELECT doc_id, ord, line, length(line) AS n_chars FROM {SQL_LINES}")
def doc_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "ord", "line", F.length("line").cast("long").alias("n_chars"))


SQL_REASON = f"""CASE WHEN {sql_norm("line")} = '' THEN 'empty_source_text'
  WHEN {sql_norm(f"regexp_replace(line, {q(text.PLACEHOLDER)}, '', 'g')")} = '' THEN 'placeholder_only'
  WHEN {sql_url("line")} OR {sql_email("line")} OR {sql_copyright("line")} THEN 'hard_metadata_fragment'
  WHEN {sql_hex("line")} THEN 'protocol_hex_dump' END"""


@query(f"SELECT doc_id, ord, CASE WHEN reason IS NULL THEN 'translate' ELSE 'keep_origin' END AS action, reason FROM (SELECT doc_id, ord, {SQL_REASON} AS reason FROM {SQL_LINES})")
def policy_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.with_verdict(lines(spark, sf_dir).select("doc_id", "ord", "line"), "line").select("doc_id", "ord", "action", "reason")


@query(f"""WITH b AS (SELECT doc_id, lang, ord, line, {SQL_REASON} AS reason FROM {SQL_LINES}),
 d AS (SELECT *, row_number() OVER (PARTITION BY lang, trim(line) ORDER BY doc_id, ord) AS rn FROM b)
 SELECT lang, count(*) AS n_blocks, count(*) FILTER (reason IS NOT NULL) AS kept_origin, count(*) FILTER (reason = 'empty_source_text') AS empty_blocks,
 count(*) FILTER (reason = 'hard_metadata_fragment') AS metadata_blocks, count(*) FILTER (rn > 1) AS duplicate_blocks,
 CAST(sum({sql_count("line", text.WORD)}) AS BIGINT) AS english_words FROM d GROUP BY lang""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents by language: verdicts, duplicates, words. Duplicates are counted by an aggregate on the signature, not by sorting its rows."""
    marked = rules.with_verdict(lines(spark, sf_dir).select("lang", "line"), "line")
    one = marked.groupBy("lang", F.trim("line").alias("sig")).agg(
        F.count(F.lit(1)).alias("n"), F.count("reason").alias("kept"), F.count_if(F.col("reason") == "empty_source_text").alias("empty"),
        F.count_if(F.col("reason") == "hard_metadata_fragment").alias("meta"), F.sum(text.english_words(F.col("line"))).alias("words"),
    )
    return one.groupBy("lang").agg(
        F.sum("n").alias("n_blocks"), F.sum("kept").alias("kept_origin"), F.sum("empty").alias("empty_blocks"), F.sum("meta").alias("metadata_blocks"),
        F.sum(F.col("n") - 1).alias("duplicate_blocks"), F.sum("words").alias("english_words"),
    )


@query(f"SELECT doc_id, {sql_count('text', text.WORD)} AS english_words, len(list_filter(regexp_extract_all(text, {q(text.WORD)}), lambda w: length(w) >= 3)) AS natural_words, {sql_count('text', text.CJK)} AS cjk_chars FROM documents")
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    return t(spark, sf_dir, "documents").select("doc_id", text.english_words(x).alias("english_words"), text.natural_words(x).alias("natural_words"), text.cjk_chars(x).alias("cjk_chars"))


@query(f"SELECT doc_id, ord, {sql_url('line')} AS is_url, {sql_email('line')} AS is_email, {sql_copyright('line')} AS is_copyright FROM {SQL_LINES}")
def hard_nontranslatable(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("line")
    return lines(spark, sf_dir).select("doc_id", "ord", text.is_url(x).alias("is_url"), text.is_email(x).alias("is_email"), text.is_copyright_tail(x).alias("is_copyright"))


def _sql_code() -> str:
    n, tok = "nt", "toks"
    ops = q(text.OPERATORS)
    codeish = f"len(list_filter({tok}, lambda w: regexp_matches(w, {ops}) OR {sql_match('w', '(?i)(^|[^\\p{L}\\p{N}_])[0-9]+(?:\\.[0-9]+)?D[+-]?[0-9]+([^\\p{L}\\p{N}_]|$)')} OR {sql_match('w', '^[A-Z][A-Z0-9_.-]{3,}$')} OR contains(w, '_') OR (regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '[0-9]'))))"
    cues = sql_match(n, rf"(?i)(^|[^\p{{L}}\p{{N}}_])(?:{text.PROSE_CUES})([^\p{{L}}\p{{N}}_]|$)")
    natural = f"len(list_filter(regexp_extract_all({n}, {q(text.WORD)}), lambda w: length(w) >= 3))"
    letters, upper, operators = sql_count(n, r"\p{L}"), sql_count(n, r"\p{Lu}"), sql_count(n, text.OPERATORS)
    loop = sql_match(n, r"(?i)(^|[^\p{L}\p{N}_])DO[0-9]+[A-Z] *=")
    return f"""SELECT doc_id, ord, (length(nt) >= 24 AND NOT {sql_match(n, text.CJK)} AND len(toks) BETWEEN 2 AND 64 AND (({loop} AND codeish >= 2) OR (codeish >= greatest(3, len(toks) // 2) AND (
      {natural} <= 4 OR ({upper} >= 0.55 * greatest(1, {letters}) AND NOT {cues}) OR {operators} >= greatest(6, length(nt) // 18))))) AS is_code
      FROM (SELECT *, {codeish} AS codeish FROM (SELECT *, string_split(nt, ' ') AS toks FROM (SELECT doc_id, ord, {sql_norm("line")} AS nt FROM {SQL_LINES})))"""


@query(_sql_code())
def code_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "ord", text.is_code_literal(F.col("line")).alias("is_code"))


def _sql_reference() -> str:
    m = lambda p: sql_match("nt", p)
    return f"""SELECT doc_id, ord, ((doi AND (yr OR commas >= 1)) OR ((ix OR author) AND (yr OR doi OR journal OR pages OR commas >= 2)) OR (yr AND (journal OR pages) AND commas >= 1)) AS is_reference
    FROM (SELECT doc_id, ord, {sql_count("nt", "[,;]")} AS commas, {m(text.YEAR)} AS yr, {m(text.DOI)} AS doi, {m(text.JOURNAL)} AS journal, {m(text.PAGES)} AS pages, {m(text.INDEXED)} AS ix, {m(text.AUTHOR)} AS author
    FROM (SELECT doc_id, ord, {sql_norm("line")} AS nt FROM {SQL_LINES}))"""


@query(_sql_reference())
def reference_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "ord", text.is_reference_entry(F.col("line")).alias("is_reference"))


_T = f"trim(regexp_replace(coalesce(text, ''), {q(text.PLACEHOLDER)}, '', 'g'), ' ' || chr(9) || chr(13) || chr(10))"
_V = f"regexp_replace({_T}, '[ \\t\\r\\n]', '', 'g')"


@query(f"""SELECT doc_id, (length({_V}) = 0 OR contains({_T}, chr(65533)) OR {sql_count(_V, text.ODD)} > 0.35 * length({_V})) AS is_garbled,
 (NOT contains({_T}, '@') AND NOT regexp_matches({_T}, 'https?://') AND NOT {sql_url(_T)} AND {sql_count(_T, text.WORD)} >= 8 AND {sql_count(_T, '\\p{L}')} >= 30) AS is_prose FROM documents""")
def garbled_and_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", text.is_garbled(F.col("text")).alias("is_garbled"), text.is_english_prose(F.col("text")).alias("is_prose"))


@query("SELECT doc_id, CASE WHEN len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) <> '')) >= 3 THEN 'preserve_lines' ELSE 'flow' END AS flow FROM documents")
def text_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", text.text_flow(F.col("text")).alias("flow"))


@query(f"SELECT page_id, x AS plain, length(x) AS n_chars FROM (SELECT page_id, {sql_norm("regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g')")} AS x FROM pages)")
def html_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("page_id", text.plain_text(F.col("html")).alias("plain")).withColumn("n_chars", F.length("plain").cast("long"))


@query(f"SELECT page_id, {sql_url('url')} AS is_url, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query_part, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages")
def url_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda p: F.regexp_extract("url", p, 1)
    return t(spark, sf_dir, "pages").select("page_id", text.is_url(F.col("url")).alias("is_url"), part("://([^/?#]*)").alias("host"), part("://[^/?#]*([^?#]*)").alias("path"), part("[?]([^#]*)").alias("query_part"), part("#(.*)$").alias("fragment"))


@query("SELECT doc_id, min(doc_id) OVER w AS rep_id, doc_id = min(doc_id) OVER w AS is_rep FROM documents WINDOW w AS (PARTITION BY lang, trim(text))")
def dedupe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(F.trim("text"), 256).alias("sig"))
    return records.representatives(d, ["lang", "sig"], ["doc_id"], "doc_id").select("doc_id", F.col("rep").alias("rep_id"), (F.col("doc_id") == F.col("rep")).alias("is_rep"))


@query("""WITH m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, trim(text)) AS rep_id FROM documents)
 SELECT m.doc_id, m.rep_id, l.quality, CASE WHEN l.quality IS NULL THEN 'kept_origin' ELSE 'translated' END AS final_status FROM m LEFT JOIN labels l ON m.rep_id = l.doc_id""")
def duplicate_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = dedupe_documents(spark, sf_dir).select("doc_id", F.col("rep_id").alias("rep"))
    got = records.fan_out(members, t(spark, sf_dir, "labels"), "doc_id", "quality")
    return got.select("doc_id", F.col("rep").alias("rep_id"), "quality", "final_status")


@query("""WITH b AS (SELECT lang, doc_id, n_chars, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 8 AS batch_no FROM documents)
 SELECT lang, batch_no, count(*) AS n_items, CAST(sum(n_chars) AS BIGINT) AS n_chars, CASE WHEN count(*) > 1 THEN 'batched_fast' WHEN sum(n_chars) > 4000 THEN 'single_slow' ELSE 'single_fast' END AS queue FROM b GROUP BY lang, batch_no""")
def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = ordered.batches(t(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars"), ["lang"], ["doc_id"], 8)
    sums = b.groupBy("lang", "batch_no").agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_chars").alias("n_chars"))
    return sums.withColumn("queue", F.when(F.col("n_items") > 1, "batched_fast").when(F.col("n_chars") > 4000, "single_slow").otherwise("single_fast"))


@query("""SELECT conv_id, turn, coalesce(left(string_agg(text, ' / ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 360), '') AS before_text,
 coalesce(left(string_agg(text, ' / ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 360), '') AS after_text FROM conversations""")
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = lambda a, b: ordered.context(F.col("text"), ["conv_id"], ["turn"], a, b)
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", near(-2, -1).alias("before_text"), near(1, 2).alias("after_text"))


def _sql_pair(a: str, b: str) -> tuple[str, str]:
    lw = lambda x: f"lower(coalesce(regexp_extract_all({x}, {q(text.WORD)})[-1], ''))"
    starts = f"({sql_match(b, '^[a-z]')} OR {lw(f'left({b}, 32)')} IN {sql_list(text.CONTINUES)})"
    ends = sql_match(a, text.TERMINAL)
    join = f"""CASE WHEN {a} = '' OR {b} = '' THEN -999 ELSE
      (CASE WHEN {starts} THEN 3 ELSE 0 END) + (CASE WHEN {ends} AND {starts} THEN 3 ELSE 0 END) + (CASE WHEN {a} LIKE '%-' OR (NOT {ends} AND {lw(a)} IN {sql_list(text.ENDS_OPEN)}) THEN 3 ELSE 0 END)
      + (CASE WHEN {a} LIKE '%-' THEN 4 ELSE 0 END) + (CASE WHEN {a} LIKE '%,' THEN 1 ELSE 0 END) + (CASE WHEN {lw(a)} IN {sql_list(text.SUSPICIOUS)} THEN 1 ELSE 0 END) + (CASE WHEN NOT {ends} THEN 2 ELSE 0 END) END"""
    brk = f"""greatest(0, (CASE WHEN {sql_match(a, "[.!?]$")} THEN 4 WHEN {ends} THEN 2 ELSE 0 END) - (CASE WHEN {starts} THEN 3 ELSE 0 END) + (CASE WHEN {sql_match(b, text.HEADING)} THEN 3 ELSE 0 END)
      + (CASE WHEN {sql_match(b, "^[A-Z]")} AND NOT {starts} THEN 1 ELSE 0 END))"""
    return join, brk


_J, _B = _sql_pair("a", "b")


@query(f"""WITH p AS (SELECT conv_id, turn, {sql_norm("text")} AS b, lag({sql_norm("text")}) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations),
 s AS (SELECT conv_id, turn, a, {_J} AS j, {_B} AS k FROM p),
 d AS (SELECT conv_id, turn, CASE WHEN a IS NULL THEN 'start' WHEN j < 0 THEN 'break' WHEN j >= 4 AND j >= k + 2 THEN 'join' WHEN k >= 4 AND k >= j + 1 THEN 'break' ELSE 'candidate' END AS decision FROM s)
 SELECT conv_id, turn, decision, CAST(sum(CASE WHEN decision = 'join' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS island FROM d""")
def continuation_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    was = F.lag("text").over(ordered.over(["conv_id"], ["turn"]))
    c = t(spark, sf_dir, "conversations").withColumn("was", was).withColumn("decision", F.when(F.col("was").isNull(), "start").otherwise(text.pair_decision(F.col("was"), F.col("text"))))
    return ordered.islands(c, ["conv_id"], ["turn"], F.col("decision") == "join").select("conv_id", "turn", "decision", "island")


@query("""SELECT conv_id, turn, CASE WHEN count(*) OVER (PARTITION BY conv_id) = 1 THEN 'single' WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN 'head'
 WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) = count(*) OVER (PARTITION BY conv_id) THEN 'tail' ELSE 'middle' END AS boundary_role FROM conversations""")
def boundary_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", ordered.boundary_role(["conv_id"], ["turn"]).alias("boundary_role"))


@query("SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM conversations")
def carry_forward_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor = F.when(F.col("role") == "user", F.col("text"))
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", ordered.carry_forward(anchor, ["conv_id"], ["turn"]).alias("anchor"))


@query("""WITH u AS (SELECT user_id, ts, event_id, event_type, 'db' AS origin FROM events WHERE event_type IN ('click', 'view') UNION ALL SELECT user_id, ts, event_id + 1000000000, event_type, 'pipeline' FROM events WHERE event_type NOT IN ('click', 'view'))
 SELECT user_id, event_id, origin, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM u""")
def event_resequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, first = t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), F.col("event_type").isin("click", "view")
    both = e.where(first).withColumn("origin", F.lit("db")).unionByName(e.where(~first).withColumn("event_id", F.col("event_id") + 1_000_000_000).withColumn("origin", F.lit("pipeline")))
    return ordered.resequence(both, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "origin", "seq")


# What an event type stands for.
LANES = {"view": ("main", "ocr", 1), "click": ("main", "translation", 2), "signup": ("main", "render", 3), "purchase": ("main", "done", 4), "error": ("error", "done", 5)}
SQL_LANES = "(VALUES " + ", ".join(f"('{k}', '{a}', '{b}', {c})" for k, (a, b, c) in LANES.items()) + ") AS m(event_type, lane, stage, stage_rank)"


def canonical(df: DataFrame) -> DataFrame:
    pick = lambda i, kind: F.create_map(*[F.lit(x) for k, v in LANES.items() for x in (k, v[i])])[F.col("event_type")].cast(kind)
    return df.withColumns({"lane": F.coalesce(pick(0, "string"), F.lit("main")), "stage": pick(1, "string"), "stage_rank": F.coalesce(pick(2, "int"), F.lit(0))})


@query(f"SELECT e.event_id, coalesce(m.lane, 'main') AS lane, m.stage, coalesce(m.stage_rank, 0) AS stage_rank, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events e LEFT JOIN {SQL_LANES} USING (event_type)")
def event_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(t(spark, sf_dir, "events")).select("event_id", "lane", "stage", "stage_rank", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"""SELECT user_id, event_id, stage FROM (SELECT e.user_id, e.event_id, m.stage, row_number() OVER (PARTITION BY user_id ORDER BY stage_rank DESC, ts DESC, event_id DESC) AS rn FROM events e JOIN {SQL_LANES} USING (event_type) WHERE lane = 'main') WHERE rn = 1""")
def live_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    main = canonical(t(spark, sf_dir, "events")).where("lane = 'main' and stage is not null")
    return ordered.latest(main, ["user_id"], ["stage_rank", "ts", "event_id"], ["event_id", "stage"])


@query("""WITH f AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS s FROM events),
 g AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS stage_no FROM f),
 r AS (SELECT user_id, stage_no, event_type, min(ts) AS enter_at, count(*) AS n_events FROM g GROUP BY ALL),
 d AS (SELECT *, epoch_us(lead(enter_at) OVER (PARTITION BY user_id ORDER BY stage_no)) - epoch_us(enter_at) AS us FROM r)
 SELECT user_id, stage_no, event_type, n_events, CASE WHEN us > 0 THEN us // 1000 ELSE 0 END AS duration_ms FROM d""")
def stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.sessionize(t(spark, sf_dir, "events"), ["user_id"], "ts", "event_type", "event_id").select("user_id", "stage_no", "event_type", "n_events", F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"))


@query("""WITH v AS (SELECT *, lag(event_type) OVER w AS pt, lag(value) OVER w AS pv, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
 SELECT user_id, event_id, 'created' AS change FROM v WHERE rn = 1 UNION ALL SELECT user_id, event_id, 'status_changed' FROM v WHERE rn > 1 AND pt IS DISTINCT FROM event_type
 UNION ALL SELECT user_id, event_id, 'value_changed' FROM v WHERE rn > 1 AND pv IS DISTINCT FROM value""")
def cdc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.changes(t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", "value").select("user_id", "event_id", "change")


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS progress FROM events")
def monotone_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").select("event_id", ordered.running_max("value", ["user_id", "event_type"], ["ts", "event_id"]).alias("progress"))


@query("""WITH e AS (SELECT event_type, epoch_us(ts) AS moment, 1 AS step FROM events UNION ALL SELECT event_type, epoch_us(ts) + CAST(floor(value * 1000000) AS BIGINT) + 1, -1 FROM events),
 s AS (SELECT event_type, moment, step, sum(step) AS d FROM e GROUP BY ALL), r AS (SELECT event_type, sum(d) OVER (PARTITION BY event_type ORDER BY moment, step) AS o FROM s)
 SELECT event_type, CAST(max(o) AS BIGINT) AS peak FROM r GROUP BY event_type""")
def peak_inflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is open from its time for `value` seconds and a microsecond."""
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return ordered.peak_open(t(spark, sf_dir, "events"), ["event_type"], start, start + F.floor(F.col("value") * 1_000_000).cast("long") + 1)


@query("""SELECT event_type, count(value) AS n, CAST(round_even(min(value), 0) AS BIGINT) AS min_ms, CAST(round_even(quantile_cont(value, 0.5), 0) AS BIGINT) AS p50_ms, CAST(round_even(quantile_cont(value, 0.9), 0) AS BIGINT) AS p90_ms,
 CAST(round_even(quantile_cont(value, 0.95), 0) AS BIGINT) AS p95_ms, CAST(round_even(max(value), 0) AS BIGINT) AS max_ms, round(avg(value), 2) AS mean_ms FROM events GROUP BY event_type""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.latency_summary(t(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value")


@query("SELECT event_id, round(value, 6) AS value FROM events, (SELECT greatest(30.0, avg(value) + 2 * stddev_pop(value)) AS bound FROM events) WHERE value > bound ORDER BY events.value DESC, event_id LIMIT 20")
def slow_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.slow_items(t(spark, sf_dir, "events").select("event_id", "value"), "value", "event_id", 30.0).select("event_id", F.round("value", 6).alias("value"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value < 50) AS n_ok, round(count(*) FILTER (value < 50) / count(*), 4) AS success_rate FROM events GROUP BY event_type")
def route_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = t(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < 50).alias("n_ok"))
    return g.withColumn("success_rate", F.round(F.col("n_ok") / F.col("n"), 4))


@query("SELECT p_brand, n, round(mean, 4) AS mean, round(std, 4) AS std FROM (SELECT p_brand, count(p_retailprice) AS n, avg(p_retailprice) AS mean, stddev_samp(p_retailprice) AS std FROM part GROUP BY p_brand) WHERE n >= 3 AND std <= 1000")
def welford_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.gated_stats(t(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", 3, 1000.0).select("p_brand", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY value DESC, event_id LIMIT 12")
def top_k_slow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").orderBy(F.desc("value"), "event_id").limit(12).select("event_id", "user_id", "event_type")


@query("""WITH b AS (SELECT p_name AS source, p_brand AS target, p_partkey AS pos, 0 AS side FROM part UNION ALL SELECT upper(p_name), p_type, p_partkey, 1 FROM part WHERE p_size <= 5),
 k AS (SELECT *, translate(trim(source), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term_key FROM b)
 SELECT term_key, source, target, side FROM (SELECT *, row_number() OVER (PARTITION BY term_key ORDER BY side DESC, pos DESC) AS rn FROM k WHERE term_key <> '') WHERE rn = 1""")
def glossary_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part")
    base = p.select(F.col("p_name").alias("source"), F.col("p_brand").alias("target"), F.col("p_partkey").alias("pos"))
    overlay = p.where("p_size <= 5").select(F.upper("p_name").alias("source"), F.col("p_type").alias("target"), F.col("p_partkey").alias("pos"))
    return terms.merge(base, overlay).select("term_key", "source", "target", "side")


# A small glossary.
GLOSSARY = ("tion", "the", "and", "der", "que", "les", "in", "elle", "was", "copyright", "idiot", "ed")
SQL_GLOSSARY = "(VALUES " + ", ".join(f"('{g}')" for g in GLOSSARY) + ") AS g(term)"
_HIT = "regexp_matches(lower(text), '(^|[^A-Za-z0-9_])' || term || '([^A-Za-z0-9_]|$)')"


def glossary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(g,) for g in GLOSSARY], "term string")


@query(f"SELECT doc_id, term FROM documents, {SQL_GLOSSARY} WHERE {_HIT}")
def glossary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.matches(spread(t(spark, sf_dir, "documents").select("doc_id", "text")), glossary(spark), "text", "term").select("doc_id", "term")


@query(f"""SELECT term, (SELECT count(*) FROM documents WHERE {_HIT}) AS source_hits, (SELECT count(*) FROM conversations WHERE {_HIT}) AS target_hits,
 (SELECT count(*) FROM documents WHERE {_HIT}) > 0 AND (SELECT count(*) FROM conversations WHERE {_HIT}) = 0 AS unapplied FROM {SQL_GLOSSARY}""")
def glossary_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, hits = glossary(spark), lambda name, to: terms.matches(spread(t(spark, sf_dir, name).select("text")), glossary(spark), "text", "term").groupBy("term").agg(F.count(F.lit(1)).alias(to))
    met = g.join(hits("documents", "source_hits"), "term", "left").join(hits("conversations", "target_hits"), "term", "left").na.fill(0)
    return met.withColumn("unapplied", (F.col("source_hits") > 0) & (F.col("target_hits") == 0))


# That pattern language knows ASCII words only, so other letters are made two underscores, which no term has.
SQL_TERMS = "regexp_extract_all(text, '\\b(" + terms.TERM + ")\\b', 1)"


@query(f"""WITH d AS (SELECT doc_id, regexp_replace(text, '[À-ÖØ-öø-ÿ]', '__', 'g') AS text FROM documents), f AS (SELECT doc_id, i, {SQL_TERMS}[i] AS term FROM (SELECT doc_id, text, unnest(range(1, len({SQL_TERMS}) + 1)) AS i FROM d))
 SELECT lower(term) AS term_key, arg_min(term, (doc_id, i)) AS term, count(*) AS hits FROM f GROUP BY lower(term) HAVING count(*) >= 2 ORDER BY hits DESC, term_key LIMIT 240""")
def auto_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.technical_terms(spread(t(spark, sf_dir, "documents").select("doc_id", "text")), "text", "doc_id", 2, 240)


@query("""WITH k AS (SELECT p_type AS key, count(*) AS hits, array_to_string(list_reverse(list_slice(list(p_brand ORDER BY p_partkey DESC), 1, 8)), '|') AS sources FROM part GROUP BY p_type)
 SELECT key, hits, sources FROM k ORDER BY hits DESC, key DESC LIMIT 160""")
def term_memory_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part").withColumnRenamed("p_type", "key")
    top = p.groupBy("key").agg(F.count(F.lit(1)).alias("hits")).orderBy(F.desc("hits"), F.desc("key")).limit(160)
    last = ranked.last_few(p, ["key"], ["p_partkey", "p_brand"], "p_brand", 8)
    return top.join(last, "key").select("key", "hits", F.array_join("last", "|").alias("sources"))


@query("SELECT doc_id, 'missing_result' AS issue FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unexpected_result' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def missing_unexpected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.difference(t(spark, sf_dir, "documents"), t(spark, sf_dir, "labels"), "doc_id")


@query("SELECT d.doc_id, sha256(d.text) AS cache_key, sha256(d.text) IN (SELECT sha256(text) FROM benchmark) AS cached FROM documents d")
def cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = t(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("cache_key"))
    return records.split_by_cache(t(spark, sf_dir, "documents").select("doc_id", "text"), cache, F.sha2("text", 256)).select("doc_id", "cache_key", "cached")


@query(f"""WITH i AS (SELECT 'empty' AS kind, 'warning' AS severity FROM {SQL_LINES} WHERE {sql_norm("line")} = '' UNION ALL SELECT 'long', 'warning' FROM {SQL_LINES} WHERE length(line) > 2000
 UNION ALL SELECT 'shouting', 'error' FROM {SQL_LINES} WHERE {sql_count("line", "\\p{Lu}")} > 0.6 * length(line) AND length(line) >= 20) SELECT kind, severity, count(*) AS n FROM i GROUP BY ALL""")
def review_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    issue = lambda c, kind, how: F.when(c, F.struct(F.lit(kind).alias("kind"), F.lit(how).alias("severity")))
    found = F.array(issue(text.normalized(line) == "", "empty", "warning"), issue(F.length(line) > 2000, "long", "warning"), issue((text.count(line, r"\p{Lu}") > 0.6 * F.length(line)) & (F.length(line) >= 20), "shouting", "error"))
    return lines(spark, sf_dir).select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).groupBy("i.kind", "i.severity").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def job_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.page(t(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), [F.desc("o_orderdate"), "o_orderkey"], 20, 40).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_orderkey, o_orderpriority FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100) WHERE o_orderpriority LIKE '1%'")
def page_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.page(t(spark, sf_dir, "orders"), [F.desc("o_orderdate"), "o_orderkey"], 100).where("o_orderpriority like '1%'").select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(lower(concat_ws(' ', c_name, c_mktsegment, o_orderstatus, o_orderpriority)), 'building') ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def library_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    hit = F.contains(F.lower(F.concat_ws(" ", "c_name", "c_mktsegment", "o_orderstatus", "o_orderpriority")), F.lit("building"))
    return records.page(met.where(hit), [F.desc("o_orderdate"), "o_orderkey"], 50).select("o_orderkey", "c_name")


@query("SELECT o_orderkey, coalesce(n, 0) AS n_artifacts, round(coalesce(s, 0), 2) AS size_sum FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def left_join_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("s"))
    met = t(spark, sf_dir, "orders").join(a, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return met.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_artifacts"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("size_sum"))


@query("""WITH r AS (SELECT 'p' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS item, c_name AS who FROM customer), l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'p' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') ELSE 'p' || o_custkey END AS item FROM orders)
 SELECT o_orderkey, coalesce(a.who, b.who) AS who, CASE WHEN a.who IS NOT NULL THEN 'exact' WHEN b.who IS NOT NULL THEN 'fallback' END AS matched_by FROM l LEFT JOIN r a ON l.item = a.item LEFT JOIN r b ON 'p' || lpad(substr(l.item, 2), 6, '0') = b.item""")
def key_fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = lambda c: F.concat(F.lit("p"), F.lpad(c, 6, "0"))
    right = t(spark, sf_dir, "customer").select(padded(F.col("c_custkey").cast("string")).alias("item"), F.col("c_name").alias("who"))
    left = t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, padded(F.col("o_custkey").cast("string"))).otherwise(F.concat(F.lit("p"), F.col("o_custkey").cast("string"))).alias("item"))
    return records.key_fallback(left, right, "item", padded(F.expr("substr(item, 2)")), "who").select("o_orderkey", "who", "matched_by")


@query("""WITH u AS (SELECT o_orderkey, 'X' AS o_orderstatus, o_totalprice * 2 AS o_totalprice, o_orderdate + INTERVAL 1 DAY AS o_orderdate FROM orders WHERE o_orderkey % 10 = 0)
 SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM u UNION ALL SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) FROM orders WHERE o_orderkey % 10 <> 0""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    new = o.where("o_orderkey % 10 = 0").withColumns({"o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") * 2, "o_orderdate": F.col("o_orderdate") + F.expr("interval 1 day")})
    return records.upsert(o, new, ["o_orderkey"], "o_orderdate").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def assets_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = t(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return records.first_write_wins(li, ["l_partkey"], ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER ({c} IS NULL OR CAST({c} AS VARCHAR) = '') AS n_defaults, count(*) AS n_rows FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars")))
def defaults_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.null_report(t(spark, sf_dir, "documents"), ["doc_id", "text", "lang", "source", "n_chars"])


_RECT = "l_orderkey, l_linenumber, CAST(l_linenumber * 10 AS DOUBLE) AS x0, floor(l_discount * 1000) AS y0, CAST(l_linenumber * 10 AS DOUBLE) + l_quantity AS x1, floor(l_discount * 1000) + 1 + floor(l_tax * 500) AS y1"


def rects(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    x0, y0 = (F.col("l_linenumber") * 10).cast("double"), F.floor(F.col("l_discount") * 1000).cast("double")
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *more, x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity")).alias("x1"), (y0 + 1 + F.floor(F.col("l_tax") * 500)).cast("double").alias("y1"))


_PAIRS = f"""WITH r AS (SELECT {_RECT} FROM lineitem), p AS (SELECT a.l_orderkey, a.l_linenumber AS left_no, b.l_linenumber AS right_no, a.x0, a.y0, a.x1, a.y1, b.x0 AS u0, b.y0 AS v0, b.x1 AS u1, b.y1 AS v1,
 greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS area FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)"""


@query(f"{_PAIRS} SELECT l_orderkey, left_no, right_no, round(area, 3) AS area FROM p WHERE area > 0")
def band_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rects(spark, sf_dir)
    met = geometry.overlap_join(r, r, ["l_orderkey"], 25.0).where("l.l_linenumber < r.l_linenumber")
    return met.select(F.col("l.l_orderkey").alias("l_orderkey"), F.col("l.l_linenumber").alias("left_no"), F.col("r.l_linenumber").alias("right_no"), F.round("area", 3).alias("area"))


@query(f"""{_PAIRS}, m AS (SELECT *, greatest(y0, v0) AS t, least(y1, v1) AS b, greatest(x0, u0) AS l, least(x1, u1) AS r FROM p WHERE area > 0),
 s AS (SELECT l_orderkey, left_no, right_no, 1 AS piece_no, x0, y0, x1, t AS y1 FROM m UNION ALL SELECT l_orderkey, left_no, right_no, 2, x0, b, x1, y1 FROM m
 UNION ALL SELECT l_orderkey, left_no, right_no, 3, x0, t, l, b FROM m UNION ALL SELECT l_orderkey, left_no, right_no, 4, r, t, x1, b FROM m) SELECT * FROM s WHERE x1 > x0 AND y1 > y0""")
def rect_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rects(spark, sf_dir)
    met = geometry.overlap_join(r, r, ["l_orderkey"], 25.0).where("l.l_linenumber < r.l_linenumber")
    cut = geometry.subtract(met, "l", "r")
    return cut.select(F.col("l.l_orderkey").alias("l_orderkey"), F.col("l.l_linenumber").alias("left_no"), F.col("r.l_linenumber").alias("right_no"), *[F.col(f"__piece.{c}").alias(c) for c in ("piece_no", "x0", "y0", "x1", "y1")])


@query("""WITH v AS (SELECT p_brand, p_retailprice AS x, lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS w FROM part),
 b AS (SELECT p_brand, arg_max((x + w) / 2, (coalesce(x - w, 0), x)) AS split_x, arg_max(x - w, (coalesce(x - w, 0), x)) AS gap, max(x) - min(x) AS width FROM v GROUP BY p_brand),
 s AS (SELECT b.p_brand, any_value(split_x) AS split_x, any_value(gap) AS gap, any_value(width) AS width, count(*) FILTER (p_retailprice < split_x) AS n_left, count(*) FILTER (p_retailprice >= split_x) AS n_right FROM part p JOIN b ON p.p_brand = b.p_brand GROUP BY b.p_brand)
 SELECT p_brand, round(split_x, 3) AS split_x, round(gap, 3) AS gap, n_left, n_right, CASE WHEN gap >= 0.18 * width AND n_left >= 3 AND n_right >= 3 THEN 'double' ELSE 'single' END AS layout FROM s""")
def column_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = records.largest_gap(t(spark, sf_dir, "part").select("p_brand", "p_retailprice"), ["p_brand"], "p_retailprice", 0.18, 3)
    return got.select("p_brand", F.round("split_x", 3).alias("split_x"), F.round("gap", 3).alias("gap"), "n_left", "n_right", "layout")


@query("SELECT p_brand, list_sort(list(p_retailprice))[1 + CAST(floor((count(*) - 1) * 0.3) AS INT)] AS low_q FROM part GROUP BY p_brand")
def floor_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.floor_quantile(t(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", 0.3, "low_q")


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS n_finished, count(*) FILTER (o_orderstatus <> 'F') AS n_open, coalesce(max(o_orderkey), 0) + 1 AS next_key FROM orders")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n_finished"), F.count_if(F.col("o_orderstatus") != "F").alias("n_open"), (F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).alias("next_key"))


@query("SELECT l_orderkey, l_returnflag, count(*) AS n, grouping(l_returnflag) AS is_total FROM lineitem GROUP BY GROUPING SETS ((l_orderkey, l_returnflag), (l_orderkey))")
def page_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = t(spark, sf_dir, "lineitem")
    li.createOrReplaceTempView("__lineitem")
    return spark.sql("SELECT l_orderkey, l_returnflag, count(*) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS is_total FROM __lineitem GROUP BY GROUPING SETS ((l_orderkey, l_returnflag), (l_orderkey))")


@query("SELECT s.status, count(o.o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) AS s(status) LEFT JOIN orders o ON o.o_orderstatus = s.status GROUP BY s.status")
def zero_filled_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = t(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([("F",), ("O",), ("P",), ("X",)], "status string").join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
