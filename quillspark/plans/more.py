"""More queries over the given tables: lists and filters, edits of tables, runs and pairs, layout, redaction, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text
from quillspark.operators import arrow_ops, ordered, records, terms
from quillspark.plans.catalog import SQL_LINES, lines, q, query, sql_count, sql_match, sql_norm, t

SECRET = r"(?i)(sk-|api[_-]?key=|token=|ref=)[A-Za-z0-9_-]+"
TOC = r"^ *([0-9]+(?:\.[0-9]+)*)[.)]? +(.*?)[ .]+([0-9]+) *$"


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE lower(c_mktsegment) = lower('Building') AND (contains(lower(c_name), '00') OR contains(lower(CAST(c_custkey AS VARCHAR)), '00')) ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def glossary_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered list: an equal field in any case and a part of one of two fields. A blank part would match nothing."""
    part = "00"
    hit = F.contains(F.lower("c_name"), F.lit(part)) | F.contains(F.lower(F.col("c_custkey").cast("string")), F.lit(part)) if part.strip() else F.lit(False)
    return records.page(t(spark, sf_dir, "customer").where((F.lower("c_mktsegment") == "building") & hit), [F.desc("c_acctbal"), "c_custkey"], 100).select("c_custkey", "c_name", "c_mktsegment")


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_returnflag || '/' || l_linestatus AS route, count(*) OVER () AS total FROM lineitem WHERE l_returnflag = 'R' AND contains(l_returnflag || '/' || l_linestatus, '/F'))
 SELECT * FROM f ORDER BY l_orderkey, l_linenumber LIMIT 50 OFFSET 10""")
def item_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of items by status and a part of the route, with the total before paging. The total is an aggregate of its own, joined as one row."""
    routed = t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", F.array_join(F.array("l_returnflag", "l_linestatus"), "/").alias("route")).where(F.contains("route", F.lit("/F")))
    total = routed.agg(F.count(F.lit(1)).alias("total"))
    return records.page(routed, ["l_orderkey", "l_linenumber"], 50, 10).crossJoin(F.broadcast(total))


@query("SELECT count(*) AS n_overridden FROM (SELECT DISTINCT lower(trim(p_name)) AS k FROM part WHERE p_size <= 5) WHERE k IN (SELECT lower(trim(p_name)) FROM part WHERE p_size > 5)")
def overridden_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = terms.key(F.col("p_name")).alias("k")
    p = t(spark, sf_dir, "part")
    return p.where("p_size <= 5").select(k).distinct().join(p.where("p_size > 5").select(k), "k", "left_semi").agg(F.count(F.lit(1)).alias("n_overridden"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that stay after those with a large line go."""
    gone = t(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return t(spark, sf_dir, "orders").where("o_orderstatus != 'P'").join(gone, "o_orderkey", "left_anti").select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 400000 THEN 'failed' ELSE o_orderstatus END AS status, replace(o_orderpriority, 'NOT SPECIFIED', 'NONE') AS priority FROM orders")
def conditional_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    stale = (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 400_000)
    return t(spark, sf_dir, "orders").select("o_orderkey", F.when(stale, "failed").otherwise(F.col("o_orderstatus")).alias("status"), F.replace("o_orderpriority", F.lit("NOT SPECIFIED"), F.lit("NONE")).alias("priority"))


@query("SELECT a.conv_id, a.turn AS prev_turn, b.turn AS next_turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role <> b.role")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring turns of two roles, by a window, so that nothing is joined."""
    w = ordered.over(["conv_id"], ["turn"])
    c = t(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("prev_turn"), "role", F.lead("turn").over(w).alias("next_turn"), F.lead("role").over(w).alias("__r"))
    return c.where("next_turn = prev_turn + 1 and role != __r").select("conv_id", "prev_turn", "next_turn")


@query("SELECT l_orderkey, count(*) AS n, CASE WHEN bool_or(l_returnflag = 'R') THEN NULL ELSE string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_linenumber, l_partkey) END AS unit_text FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2")
def group_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a group in order as one text; a flagged member dissolves it; groups have two members at least."""
    inside = F.array_join(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).getField("l_partkey").cast("array<string>"), " ")
    g = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("__flag"), inside.alias("__t"))
    return g.where("n >= 2").select("l_orderkey", "n", F.when(~F.col("__flag"), F.col("__t")).alias("unit_text"))


@query(f"SELECT doc_id, ord, regexp_extract(line, {q(TOC)}, 1) AS number, regexp_extract(line, {q(TOC)}, 2) AS title, regexp_extract(line, {q(TOC)}, 3) AS page_label, least(6, 1 + length(regexp_extract(line, {q(TOC)}, 1)) - length(replace(regexp_extract(line, {q(TOC)}, 1), '.', ''))) AS level FROM {SQL_LINES} WHERE {sql_match('line', TOC)}")
def toc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda i: F.regexp_extract("line", TOC, i)
    level = F.least(F.lit(6), 1 + F.length(part(1)) - F.length(F.replace(part(1), F.lit("."), F.lit("")))).cast("long")
    return lines(spark, sf_dir).where(F.col("line").rlike(TOC)).select("doc_id", "ord", part(1).alias("number"), part(2).alias("title"), part(3).alias("page_label"), level.alias("level"))


@query(f"SELECT page_id, regexp_replace(url, {q(SECRET)}, '\\1***', 'g') AS url FROM pages")
def redacted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", SECRET, "$1***").alias("url"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five of each user. The limit on the row number is pushed before the shuffle."""
    w = ordered.over(["user_id"], [F.desc("ts"), F.desc("event_id")])
    return t(spark, sf_dir, "events").select("user_id", "event_id", "ts").withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("user_id", "event_id")


@query("SELECT lang, source, count(*) AS n_docs, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS fingerprint FROM documents GROUP BY lang, source")
def structure_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint of a group's texts in order, from their hashes."""
    inside = F.array_join(F.array_sort(F.collect_list(F.struct("doc_id", F.sha2("text", 256).alias("h")))).getField("h"), "")
    return t(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sha2(inside, 256).alias("fingerprint"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 31 THEN 'full' WHEN l_discount < 0.05 THEN 'left' ELSE 'right' END AS column_guess, round(l_quantity * 10, 0) AS quantised FROM lineitem")
def column_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("l_quantity") >= 0.62 * 50, "full").when(F.col("l_discount") < 0.05, "left").otherwise("right")
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", side.alias("column_guess"), F.round(F.col("l_quantity") * 10, 0).alias("quantised"))


@query("SELECT l_orderkey, min(l_extendedprice) AS x0, max(l_extendedprice) AS x1, round(quantile_cont(l_extendedprice, 0.5), 4) AS median_width, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1] AS upper_median FROM lineitem GROUP BY l_orderkey")
def page_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated and upper medians, which differ for an even number."""
    upper = F.element_at(F.array_sort(F.collect_list("l_quantity")), (F.floor(F.count("l_quantity") / 2) + 1).cast("int"))
    return t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_extendedprice").alias("x0"), F.max("l_extendedprice").alias("x1"), F.round(F.percentile("l_extendedprice", 0.5), 4).alias("median_width"), upper.alias("upper_median"))


@query("""WITH s AS (SELECT doc_id, ord, line, CASE WHEN length(line) < 120 THEN 1 ELSE 0 END AS short FROM """ + SQL_LINES + """), m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - row_number() OVER (PARTITION BY doc_id, short ORDER BY ord) AS g FROM s)
 SELECT doc_id, CAST(min(ord) AS INT) AS first_ord, count(*) AS n_lines FROM m WHERE short = 1 GROUP BY doc_id, g HAVING count(*) >= 6""")
def index_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of six short lines or more."""
    short = F.length("line") < 120
    s = lines(spark, sf_dir).withColumn("short", short)
    same = F.col("short") == F.lag("short").over(ordered.over(["doc_id"], ["ord"]))
    return ordered.islands(s, ["doc_id"], ["ord"], same).where("short").groupBy("doc_id", "island").agg(F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("n_lines")).where("n_lines >= 6").select("doc_id", "first_ord", "n_lines")


@query(f"SELECT doc_id, CASE WHEN length(nt) > 220 THEN rtrim(left(nt, 219)) || '…' ELSE nt END AS preview FROM (SELECT doc_id, {sql_norm('text')} AS nt FROM documents)")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = text.normalized(F.col("text"))
    return t(spark, sf_dir, "documents").select("doc_id", F.when(F.length(n) > 220, F.concat(F.rtrim(F.substring(n, 1, 219)), F.lit("…"))).otherwise(n).alias("preview"))


@query("""SELECT d.lang, count(*) AS n_docs, count(l.doc_id) AS n_labelled, count(*) FILTER (l.quality = 1) AS n_good, count(*) FILTER (l.toxic = 1) AS n_toxic, round(count(*) FILTER (l.quality = 1) / nullif(count(l.doc_id), 0), 4) AS good_rate FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang""")
def page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = t(spark, sf_dir, "documents").select("doc_id", "lang").join(t(spark, sf_dir, "labels").withColumnRenamed("doc_id", "__l"), F.col("doc_id") == F.col("__l"), "left")
    g = met.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.count("__l").alias("n_labelled"), F.count_if(F.col("quality") == 1).alias("n_good"), F.count_if(F.col("toxic") == 1).alias("n_toxic"))
    return g.withColumn("good_rate", F.round(F.try_divide("n_good", "n_labelled"), 4))


@query("""WITH w AS (SELECT n, greatest(1, CAST(floor(12 * n / total) AS BIGINT)) AS workers, row_number() OVER (ORDER BY event_type) AS rn, count(*) OVER () AS k, event_type FROM (SELECT event_type, count(*) AS n, sum(count(*)) OVER () AS total FROM events GROUP BY event_type))
 SELECT event_type, n, CASE WHEN rn = k THEN greatest(1, 12 - (SELECT CAST(sum(workers) AS BIGINT) FROM w WHERE rn < k)) ELSE workers END AS workers FROM w""")
def worker_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve workers by share, one at least, what is left to the last. A row for each event type meets in the window."""
    n = t(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(0))
    shares = n.withColumn("__w", F.greatest(F.lit(1), F.floor(12 * F.col("n") / F.sum("n").over(every)))).withColumn("__rn", F.row_number().over(every.orderBy("event_type"))).withColumn("__k", F.count(F.lit(1)).over(every))
    before = F.sum(F.when(F.col("__rn") < F.col("__k"), F.col("__w"))).over(every)
    return shares.select("event_type", "n", F.when(F.col("__rn") == F.col("__k"), F.greatest(F.lit(1), 12 - before)).otherwise(F.col("__w")).cast("long").alias("workers"))


# What SQL can't say; tests/test_operators.py has their cases.
@query()
def copied_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that repeat the one before to COPY_RATIO or more."""
    was = F.lag("text").over(ordered.over(["conv_id"], ["turn"]))
    c = t(spark, sf_dir, "conversations").withColumn("was", was).where("was is not null")
    ratio = c.select("conv_id", "turn", arrow_ops.copy_ratio(F.col("was"), F.col("text")).alias("ratio"))
    return ratio.select("conv_id", "turn", F.round("ratio", 6).alias("ratio"), (F.col("ratio") >= arrow_ops.COPY_RATIO).alias("copied"))


@query()
def protected_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many formulas each text has, and whether putting them back gives the text."""
    p = t(spark, sf_dir, "documents").select("doc_id", "text", arrow_ops.protect(F.col("text")).alias("p"))
    return p.select("doc_id", F.size("p.tokens").alias("n_formulas"), (arrow_ops.restore(F.col("p.text"), F.col("p.tokens")) == F.coalesce("text", F.lit(""))).alias("same_text"))
