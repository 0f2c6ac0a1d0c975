"""Queries of jobs and their items over the given tables: failure classes, counters, joins of results, manifests, hints, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import rules, text
from quillspark.operators import arrow_ops, ordered, records
from quillspark.plans.catalog import query, t

#: Log lines as jobs leave them, dealt to the events by their ids.
MESSAGES = (
    "all pages done", "socket.gaierror: name resolution", "ReadTimeout after 60s", "PlaceholderInventoryError: unexpected placeholder", "source pdf not found: a.pdf", "HTTP 401 Unauthorized", "429 Too Many Requests, retry-after 3",
    "failed to download package foo", "connection reset by peer", "the request was refused for safety", "segment validation failed", "rate limit reached", "HTTP 503 from upstream", "bad json",
)
SQL_MESSAGE = "[" + ", ".join(f"'{m}'" for m in MESSAGES) + f"][CAST(event_id % {len(MESSAGES)} AS INT) + 1]"


def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with a message and an HTTP status."""
    message = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("event_id") % len(MESSAGES) + 1).cast("int"))
    status = F.when(F.col("event_id") % 11 == 0, 429).when(F.col("event_id") % 13 == 0, 502).when(F.col("event_id") % 17 == 0, 404)
    return t(spark, sf_dir, "events").withColumn("message", message).withColumn("status_code", status)


SQL_LOGGED = f"(SELECT *, {SQL_MESSAGE} AS message, CASE WHEN event_id % 11 = 0 THEN 429 WHEN event_id % 13 = 0 THEN 502 WHEN event_id % 17 = 0 THEN 404 END AS status_code FROM events)"


@query(f"""SELECT event_id, CASE WHEN regexp_matches(message, 'Failed to resolve|NameResolutionError|Temporary failure in name resolution|socket\\.gaierror') THEN 'dns_resolution_failed'
 WHEN regexp_matches(message, 'ReadTimeout|ConnectTimeout|timed out') THEN 'upstream_timeout' WHEN regexp_matches(message, 'PlaceholderInventoryError|UnexpectedPlaceholderError|placeholder in(ventory mismatch|stability)|unexpected placeholders in translation') THEN 'placeholder_unstable'
 WHEN contains(message, 'source pdf not found') THEN 'source_pdf_missing' WHEN regexp_matches(message, '40[13]|missing or invalid X-API-Key|Unauthorized') THEN 'auth_failed' WHEN regexp_matches(message, '429|rate limit|Too Many Requests') THEN 'rate_limited'
 WHEN regexp_matches(message, 'packages\\.typst\\.org|failed to download package|downloading @preview/') THEN 'typst_dependency_download_failed' ELSE 'unknown' END AS category,
 NOT (contains(message, 'source pdf not found') OR (regexp_matches(message, '40[13]|Unauthorized') AND NOT contains(message, 'Timeout'))) AS retryable FROM {SQL_LOGGED}""")
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logged(spark, sf_dir).select("event_id", rules.failure_category(F.col("message")).alias("category"), rules.failure_retryable(F.col("message")).alias("retryable"))


@query(f"""SELECT event_id, CASE WHEN status_code = 429 THEN 'rate_limit' WHEN status_code >= 500 THEN 'transport' WHEN regexp_matches(lower(message), '429|rate limit|retry-after') THEN 'rate_limit'
 WHEN regexp_matches(lower(message), 'timeout|connection|http|transport') THEN 'transport' WHEN regexp_matches(lower(message), 'refusal|refused|safety') THEN 'refusal'
 WHEN regexp_matches(lower(message), 'placeholder|segment|validation|inventory') THEN 'validation' ELSE 'protocol' END AS kind FROM {SQL_LOGGED}""")
def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logged(spark, sf_dir).select("event_id", rules.error_taxonomy(F.col("message"), F.col("status_code")).alias("kind"))


@query("SELECT p_partkey, len(text) - len(replace(text, '$', '')) - (len(text) - len(replace(text, chr(92) || '$', ''))) // 2 AS n_dollars, (len(text) - len(replace(text, '$', '')) - (len(text) - len(replace(text, chr(92) || '$', ''))) // 2) % 2 = 0 AS balanced FROM (SELECT p_partkey, p_name || CASE p_partkey % 5 WHEN 0 THEN ' $a$' WHEN 1 THEN ' ' || chr(92) || '$5 and $x$' WHEN 2 THEN ' $y' WHEN 3 THEN ' ' || chr(92) || '$' ELSE '' END AS text FROM part)")
def inline_math_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dollar signs that no backslash escapes come in pairs."""
    tail = F.element_at(F.array(*map(F.lit, (" $a$", " \\$5 and $x$", " $y", " \\$", ""))), (F.col("p_partkey") % 5 + 1).cast("int"))
    n = text.unescaped_dollars(F.concat("p_name", tail))
    return t(spark, sf_dir, "part").select("p_partkey", n.cast("long").alias("n_dollars"), (n % 2 == 0).alias("balanced"))


@query("""WITH s AS (SELECT s_suppkey, unnest(string_split((s_nationkey + 1) || '-' || (s_nationkey + 1 + s_suppkey % 4) || ', ' || (s_suppkey % 30 + 1) || ',' || (s_nationkey + 1), ',')) AS part FROM supplier),
 r AS (SELECT s_suppkey, CAST(trim(string_split(part, '-')[1]) AS INT) AS a, CAST(trim(string_split(part, '-')[-1]) AS INT) AS b FROM s), p AS (SELECT DISTINCT s_suppkey, unnest(range(a, b + 1)) AS page FROM r), bad AS (SELECT DISTINCT s_suppkey FROM p WHERE page > 25)
 SELECT s_suppkey, CASE WHEN s_suppkey NOT IN (SELECT s_suppkey FROM bad) THEN string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) END AS pages FROM p GROUP BY s_suppkey""")
def page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ranges as people write them, as sorted page numbers without repeats; null for those beyond 25 pages."""
    a = F.col("s_nationkey") + 1
    written = F.concat(a, F.lit("-"), a + F.col("s_suppkey") % 4, F.lit(", "), F.col("s_suppkey") % 30 + 1, F.lit(","), a)
    return t(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(text.page_numbers(written, F.lit(25)).cast("array<string>"), ",").alias("pages"))


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, l_returnflag AS final_status, list_filter([CASE WHEN l_discount > 0.05 THEN 'discount' END, CASE WHEN l_tax > 0.05 THEN 'tax' END], lambda x: x IS NOT NULL) AS errors, l_returnflag || '/' || l_linestatus AS route, lower(l_orderkey || ' ' || l_partkey) AS words FROM lineitem),
 f AS (SELECT * FROM i WHERE l_linenumber = 2 AND final_status = 'R' AND list_contains(errors, 'tax') AND contains(route, '/F') AND contains(words, '7')) SELECT l_orderkey, l_linenumber, route, (SELECT count(*) FROM f) AS total FROM f ORDER BY l_orderkey, l_linenumber LIMIT 100 OFFSET 5""")
def filtered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by page, status, any of their error types, a part of the route and a part of their words, with the number before paging."""
    flag = lambda c, name: F.when(F.col(c) > 0.05, name)
    named = t(spark, sf_dir, "lineitem").where("l_linenumber = 2 AND l_returnflag = 'R'").select(
        "l_orderkey", "l_linenumber", F.array_compact(F.array(flag("l_discount", "discount"), flag("l_tax", "tax"))).alias("errors"), F.concat_ws("/", "l_returnflag", "l_linestatus").alias("route"), F.lower(F.concat_ws(" ", "l_orderkey", "l_partkey")).alias("words")
    )
    hits = named.where(F.array_contains("errors", "tax") & F.contains("route", F.lit("/F")) & F.contains("words", F.lit("7")))
    return records.page(hits.select("l_orderkey", "l_linenumber", "route"), ["l_orderkey", "l_linenumber"], 100, 5).crossJoin(F.broadcast(hits.agg(F.count("*").alias("total"))))  # one row


SQL_REQUESTS = f"(SELECT *, event_type <> 'error' AS success, CASE WHEN event_type = 'error' THEN status_code END AS code, CASE WHEN event_type = 'error' AND status_code IS NULL THEN CASE WHEN event_id % 2 = 0 THEN 'ReadTimeout' ELSE 'ValueError' END END AS error_class FROM {SQL_LOGGED})"
SQL_COUNTERS = "count(*) AS total, count_if(success) AS succeeded, count_if(NOT success) AS failed, count_if(NOT success AND error_class = 'ReadTimeout') AS timeouts, count_if(NOT success AND code IS NOT NULL) AS http_errors, count_if(NOT success AND code IS NULL) AS exceptions"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("event_type") == "error"
    odd = F.when(F.col("event_id") % 2 == 0, "ReadTimeout").otherwise("ValueError")
    return logged(spark, sf_dir).withColumn("success", ~failed).withColumn("code", F.when(failed, F.col("status_code"))).withColumn("error_class", F.when(failed & F.col("status_code").isNull(), odd))


def counters() -> list:
    failed = ~F.col("success")
    kinds = {"total": F.lit(True), "succeeded": F.col("success"), "failed": failed, "timeouts": failed & (F.col("error_class") == "ReadTimeout"), "http_errors": failed & F.col("code").isNotNull(), "exceptions": failed & F.col("code").isNull()}
    return [F.count_if(c).alias(k) for k, c in kinds.items()]


@query(f"SELECT user_id, {SQL_COUNTERS} FROM {SQL_REQUESTS} GROUP BY user_id")
def request_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).groupBy("user_id").agg(*counters())


@query(f"SELECT {SQL_COUNTERS}, count(DISTINCT user_id) AS users, min(value) AS least, max(value) AS most, round(avg(value), 4) AS mean, count_if(success) / count(*) AS success_rate FROM {SQL_REQUESTS}")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of a run. Users are told apart in an aggregate of their own, so that the rest combines on the map side."""
    r = requests(spark, sf_dir)
    users = r.select("user_id").distinct().agg(F.count("user_id").alias("users"))
    rate = F.count_if(F.col("success")) / F.count("*")
    return r.agg(*counters(), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 4).alias("mean"), rate.alias("success_rate")).crossJoin(F.broadcast(users))  # one row each


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem), one AS (SELECT l_orderkey, l_linenumber, 'single ' || l_partkey AS r FROM lineitem WHERE l_linenumber = 1 AND l_partkey % 3 = 0), g AS (SELECT o_orderkey AS l_orderkey, 'group ' || o_custkey AS r FROM orders WHERE o_orderkey % 4 = 0)
 SELECT i.l_orderkey, i.l_linenumber, coalesce(one.r, g.r, '') AS result, one.r IS NULL AND g.r IS NULL AS pending FROM i LEFT JOIN one USING (l_orderkey, l_linenumber) LEFT JOIN g ON i.l_orderkey = g.l_orderkey""")
def applied_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results put into items, by the item or else by its group. Both joins have the group in their key."""
    items = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    one = items.where("l_linenumber = 1 AND l_partkey % 3 = 0").select("l_orderkey", "l_linenumber", F.concat(F.lit("single "), "l_partkey").alias("own"))
    group = t(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("group "), "o_custkey").alias("shared"))
    met = items.drop("l_partkey").join(one, ["l_orderkey", "l_linenumber"], "left").join(group, "l_orderkey", "left")
    return met.select("l_orderkey", "l_linenumber", F.coalesce("own", "shared", F.lit("")).alias("result"), F.coalesce("own", "shared").isNull().alias("pending"))


SQL_PAGE_OF = "(SELECT l_orderkey, arg_max(l_linenumber, l_linenumber * 100000 + l_partkey) AS page FROM lineitem GROUP BY l_orderkey)"


@query(f"SELECT l_orderkey, CAST(page AS INT) AS page FROM {SQL_PAGE_OF}")
def item_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item to page; of repeated items the last one counts. Parts beyond 100,000 reach into the next line's numbers; of equal numbers the first row of the file counts."""
    low = -(F.col("l_linenumber").cast("long") * 100_000 + F.col("l_partkey"))
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", low.alias("low"), F.col("_metadata.row_index").alias("at"))
    place = F.when(F.col("low").isNotNull(), F.struct("low", "at", "l_linenumber"))
    return lines.groupBy("l_orderkey").agg(F.min_by("l_linenumber", place).alias("page"))


@query(f"SELECT DISTINCT CAST(page AS INT) AS page FROM {SQL_PAGE_OF} WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def touched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return item_pages(spark, sf_dir).join(done, "l_orderkey", "left_semi").select("page").distinct()


@query("SELECT a.job, b.job AS child FROM (SELECT CAST(o_orderkey AS VARCHAR) AS job, o_orderstatus FROM orders) a JOIN (SELECT (o_orderkey // 2) || '-ocr' AS job FROM orders WHERE o_orderkey % 2 = 0) b ON b.job = a.job || '-ocr' WHERE a.o_orderstatus <> 'P'")
def child_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that aren't running, with the child that their id names."""
    o = t(spark, sf_dir, "orders")
    parents = o.where("o_orderstatus != 'P'").select(F.col("o_orderkey").cast("string").alias("job")).withColumn("child", F.concat("job", F.lit("-ocr")))
    children = o.where("o_orderkey % 2 = 0").select(F.concat(F.expr("o_orderkey div 2"), F.lit("-ocr")).alias("child"))
    return parents.join(children, "child").select("job", "child")


@query("""WITH h AS (SELECT l_orderkey, arg_max('hint ' || l_linenumber, l_linenumber) AS hint FROM lineitem WHERE l_discount > 0.06 GROUP BY l_orderkey)
 SELECT o_orderkey, concat_ws(chr(10), o_orderpriority, hint) AS hints FROM orders LEFT JOIN h ON l_orderkey = o_orderkey""")
def policy_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last hint of an item after the hints that it has."""
    last = t(spark, sf_dir, "lineitem").where("l_discount > 0.06").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linenumber").alias("n"))
    met = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(last, "o_orderkey", "left")
    return met.select("o_orderkey", F.concat_ws("\n", "o_orderpriority", F.concat(F.lit("hint "), "n")).alias("hints"))


@query("""WITH x AS (SELECT p_partkey, list_sort(list_distinct(list_filter(list_transform(string_split(p_type || ' ,' || p_brand || ', ', ','), lambda x: lower(trim(x))), lambda x: x <> ''))) AS tags FROM part)
 SELECT p_partkey, array_to_string(tags, '|') AS tags, list_has_any(tags, ['brand#11', 'brand#22', 'standard']) AS any_tag FROM x""")
def tag_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = text.tags(F.split(F.concat("p_type", F.lit(" ,"), "p_brand", F.lit(", ")), ","))
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(tags, "|").alias("tags"), F.arrays_overlap(tags, F.array(*map(F.lit, ("brand#11", "brand#22", "standard")))).alias("any_tag"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity / 7 AS x0, l_extendedprice / 1e5 AS y0 FROM lineitem)
 SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY CAST(floor(x0 * 10 + 0.5) AS BIGINT), CAST(floor(y0 * 10 + 0.5) AS BIGINT) ORDER BY l_orderkey, l_linenumber) AS rn FROM r) WHERE rn = 1""")
def unique_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rectangles that are equal to a tenth of a point the first, as an aggregate."""
    grid = [F.floor(F.col(c) * 10 + 0.5) for c in ("x0", "y0")]
    at = F.struct("l_orderkey", "l_linenumber")
    r = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 7).alias("x0"), (F.col("l_extendedprice") / 1e5).alias("y0"))
    return r.groupBy(*[g.alias(f"g{i}") for i, g in enumerate(grid)]).agg(F.min(at).alias("at")).select("at.*")


@query("""WITH w AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type) SELECT user_id, event_type, event_id FROM w ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, event_id LIMIT 200""")
def retry_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry for each item and reason, in order of priority, then of arrival."""
    rank = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    once = t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    return once.orderBy(rank, "event_id").limit(200)


@query("SELECT page_id, CASE WHEN trim(split_part(url, '#', 2)) <> '' THEN split_part(url, '#', 2) WHEN trim(split_part(url, '?', 2)) <> '' THEN split_part(url, '?', 2) WHEN trim(coalesce(url, '')) <> '' THEN url END AS excerpt FROM pages")
def first_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c: F.split_part("url", F.lit(c), F.lit(2))
    return t(spark, sf_dir, "pages").select("page_id", text.first_filled(part("#"), part("?"), F.col("url")).alias("excerpt"))


@query("""WITH g AS (SELECT l_suppkey, list((l_orderkey, l_linenumber) ORDER BY l_orderkey, l_linenumber) AS items FROM lineitem WHERE l_quantity > 49 GROUP BY l_suppkey) SELECT l_suppkey, CAST(len(items) AS BIGINT) AS n, array_to_string(list_transform(items, lambda x: x[1] || '-' || x[2]), ' ') AS items FROM g""")
def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group to its items, in order; groups are small by nature."""
    members = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber")))
    joined = F.array_join(F.transform(members, lambda x: F.concat_ws("-", x["l_orderkey"], x["l_linenumber"])), " ")
    return t(spark, sf_dir, "lineitem").where("l_quantity > 49").groupBy("l_suppkey").agg(F.count("*").alias("n"), joined.alias("items"))


@query("SELECT l_returnflag AS document, l_linenumber AS page, count_if(l_discount > 0.08) AS suspicious, count(*) AS blocks FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linenumber)")
def suspicious_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By page, by document and in all."""
    return t(spark, sf_dir, "lineitem").rollup(F.col("l_returnflag").alias("document"), F.col("l_linenumber").alias("page")).agg(F.count_if(F.col("l_discount") > 0.08).alias("suspicious"), F.count("*").alias("blocks"))


@query("SELECT lang, count(*) AS documents, sum(n) AS blocks, max(n) AS most_blocks, count_if(n = 1) AS single FROM (SELECT lang, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents) GROUP BY lang")
def schema_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.split(text.empty_for_null(F.col("text")), "\n")).cast("long")
    return t(spark, sf_dir, "documents").select("lang", n.alias("n")).groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n").alias("blocks"), F.max("n").alias("most_blocks"), F.count_if(F.col("n") == 1).alias("single"))


@query("""WITH g AS (SELECT l_orderkey, l_quantity, l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS gap FROM lineitem) SELECT l_orderkey, median(l_quantity) AS height, median(gap) AS pitch FROM g GROUP BY l_orderkey""")
def line_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of an item's line heights and of the gaps between lines in order."""
    w = ordered.over(["l_orderkey"], ["l_linenumber", "l_partkey", "l_quantity"])
    gaps = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", (F.col("l_quantity") - F.lag("l_quantity").over(w)).alias("gap"))
    return gaps.groupBy("l_orderkey").agg(F.median("l_quantity").alias("height"), F.median("gap").alias("pitch"))


@query("SELECT l_orderkey, l_linenumber, min(CASE WHEN l_quantity > 20 THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS body_from FROM lineitem")
def body_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block with the first order on its page at which body text stands."""
    first = F.min(F.when(F.col("l_quantity") > 20, F.col("l_linenumber"))).over(Window.partitionBy("l_orderkey"))
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", first.alias("body_from"))


@query("""WITH o AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, bool_or(l_discount > 0.09) OVER (PARTITION BY l_orderkey) AS flagged FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey))
 SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN flagged THEN '' WHEN n = 1 THEN 'single' WHEN i = 1 THEN 'head' WHEN i = n THEN 'tail' ELSE 'middle' END AS role FROM o""")
def group_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head, middle and tail of each group in order; none where a member is flagged."""
    whole, w = Window.partitionBy("l_orderkey"), ordered.over(["l_orderkey"], ["l_linenumber", "l_partkey"])
    placed = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w).alias("i"), F.count("*").over(whole).alias("n"), F.bool_or(F.col("l_discount") > 0.09).over(whole).alias("flagged"))
    role = F.when(F.col("flagged"), "").when(F.col("n") == 1, "single").when(F.col("i") == 1, "head").when(F.col("i") == F.col("n"), "tail").otherwise("middle")
    return placed.select("l_orderkey", "l_linenumber", "l_partkey", role.alias("role"))


@query("SELECT p_partkey, p_name FROM part ORDER BY length(p_name) DESC, CASE WHEN p_size <= 5 THEN 0 ELSE 1 END, lower(p_name), p_partkey LIMIT 200")
def hard_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossary entries, the longest first, those to preserve before others."""
    return t(spark, sf_dir, "part").orderBy(F.desc(F.length("p_name")), F.when(F.col("p_size") <= 5, 0).otherwise(1), F.lower("p_name"), "p_partkey").limit(200).select("p_partkey", "p_name")


@query("""WITH l AS (SELECT l_orderkey, max(l_linenumber) AS live FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey) SELECT o_orderkey, coalesce(live, o_custkey % 7) AS current, CASE WHEN coalesce(live, o_custkey % 7) <= 7 THEN round(100.0 * coalesce(live, o_custkey % 7) / 7, 3) END AS percent FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def progress_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress from the live snapshot or else the job."""
    live = t(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linenumber").alias("live"))
    met = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(live, "o_orderkey", "left").withColumn("current", F.coalesce(F.col("live").cast("long"), F.col("o_custkey") % 7))
    return met.select("o_orderkey", "current", F.when(F.col("current") <= 7, F.round(100.0 * F.col("current") / 7, 3)).alias("percent"))


@query("SELECT event_id, CAST(coalesce(json_extract_string(props, '$.k'), 'none') AS VARCHAR) AS k, event_type AS stage FROM events")
def payload_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON payload with defaults under the keys that it lacks."""
    payload = F.coalesce(F.from_json("props", "map<string, string>"), F.create_map().cast("map<string, string>"))
    defaults = F.create_map(F.lit("k"), F.lit("none"), F.lit("stage"), F.col("event_type"))
    whole = F.map_from_entries(F.concat(F.map_entries(payload), F.map_entries(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(payload, k)))))
    return t(spark, sf_dir, "events").select("event_id", whole["k"].alias("k"), whole["stage"].alias("stage"))


@query("SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN starts_with(text, 'Can') OR starts_with(text, 'can') THEN 'request' END, CASE WHEN contains(text, '?') THEN 'question' END, CASE WHEN length(text) > 200 THEN 'long' END, CASE WHEN role = 'system' THEN 'system' END], lambda x: x IS NOT NULL), ',') AS hints FROM conversations")
def turn_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    found = {"request": F.startswith(x, F.lit("Can")) | F.startswith(x, F.lit("can")), "question": F.contains(x, F.lit("?")), "long": F.length(x) > 200, "system": F.col("role") == "system"}
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_compact(F.array(*[F.when(c, k) for k, c in found.items()])), ",").alias("hints"))


@query("SELECT l_linenumber AS page, 'pages/' || lpad(CAST(l_linenumber AS VARCHAR), 4, '0') || '.json' AS path, count(*) AS items, count(DISTINCT l_orderkey) AS jobs FROM lineitem GROUP BY l_linenumber")
def page_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page to path. Jobs are counted from pairs, so that no page's jobs gather in a task."""
    pairs = t(spark, sf_dir, "lineitem").groupBy("l_linenumber", "l_orderkey").agg(F.count("*").alias("n"))
    path = F.concat(F.lit("pages/"), F.lpad(F.col("l_linenumber").cast("string"), 4, "0"), F.lit(".json"))
    return pairs.groupBy("l_linenumber").agg(F.sum("n").alias("items"), F.count("*").alias("jobs")).select(F.col("l_linenumber").alias("page"), path.alias("path"), "items", "jobs")


@query()
def adaptive_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit of requests at once after each request of a user. The fold has no SQL; tests have its cases."""
    w = ordered.over(["user_id"], ["ts", "event_id"])
    r = requests(spark, sf_dir).select("user_id", F.row_number().over(w).alias("request_no"), "success", F.col("code").alias("status_code"), "error_class", (F.abs("value") * 400).cast("long").alias("elapsed_ms"))
    return arrow_ops.adaptive_limits(r, "user_id", "request_no")
