"""Chains of orders of one customer, and texts of conversations split over boxes and members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators import chains, ordered, splits
from quillspark.plans.catalog import query, t
from quillspark.plans.layout import _BLOCKS, column_blocks

_ORDERS = "SELECT o_orderkey AS id, o_orderpriority AS text, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nx, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS la FROM orders"


def order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """place, prev_id, next_id: four of five orders lead to their customer's next; later pairs lead one in ten to the last, so that chains meet."""
    w = Window.partitionBy("o_custkey")
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lead("o_orderkey").over(w.orderBy("o_orderdate", "o_orderkey")).alias("nx"), F.first("o_orderkey").over(w.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))).alias("la"))
    one = o.where("id % 5 != 0 and nx is not null").select(F.col("id").alias("place"), F.col("id").alias("prev_id"), F.col("nx").alias("next_id"))
    return one.unionByName(o.where("id % 10 = 3 and la != id").select((F.col("id") + 1_000_000_000_000).alias("place"), F.col("id").alias("prev_id"), F.col("la").alias("next_id")))


@query(f"""WITH RECURSIVE o AS ({_ORDERS}), p AS (SELECT id AS place, id AS prev, nx AS next FROM o WHERE id % 5 <> 0 AND nx IS NOT NULL UNION ALL SELECT id + 1000000000000, id, la FROM o WHERE id % 10 = 3 AND la <> id),
 e AS (SELECT prev, arg_max(next, place) AS next FROM p GROUP BY prev), s AS (SELECT prev, row_number() OVER (ORDER BY place, prev) AS n FROM p WHERE prev NOT IN (SELECT next FROM p)),
 w AS (SELECT n, prev AS id, CAST(0 AS BIGINT) AS pos FROM s UNION ALL SELECT n, e.next, pos + 1 FROM w JOIN e ON e.prev = w.id), b AS (SELECT id, max(n) AS n FROM w GROUP BY id), m AS (SELECT DISTINCT w.n, w.id, w.pos FROM w JOIN b ON b.id = w.id AND b.n = w.n)
 SELECT m.id AS item_id, 'cg-review-' || (1000 + m.n) AS continuation_group, m.pos, coalesce(po.text, '') AS prev_text, coalesce(no.text, '') AS next_text FROM m LEFT JOIN m q ON q.n = m.n AND q.pos = m.pos - 1 LEFT JOIN o po ON po.id = q.id LEFT JOIN e ON e.prev = m.id LEFT JOIN o no ON no.id = e.next""")
def approved_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of orders that approved pairs chain."""
    return chains.approved(t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("text")), order_pairs(spark, sf_dir))


_SPLIT = f"""WITH b AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM ({_BLOCKS})), n AS (SELECT conv_id, ord, x, (x1 - x0) * (y1 - y0) AS mine, lead((x1 - x0) * (y1 - y0)) OVER (PARTITION BY conv_id ORDER BY ord) AS other FROM b),
 g AS (SELECT *, length(x) AS len, CAST(floor(length(x) * (1.0::DOUBLE - greatest(0.18::DOUBLE, least(0.55::DOUBLE, other / (mine + other))))) AS BIGINT) AS target, greatest(8, length(x) // 6) AS near FROM n WHERE other IS NOT NULL),
 p AS (SELECT conv_id, ord, i, abs(i - target) AS d FROM (SELECT *, unnest(range(greatest(4, target - near), least(len - 4, target + near) + 1)) AS i FROM g WHERE len >= 16 AND greatest(4, target - near) < least(len - 4, target + near)) WHERE substr(x, i + 1, 1) = ' '),
 c AS (SELECT conv_id, ord, arg_min(i, (d, i)) AS place FROM p GROUP BY ALL), s AS (SELECT conv_id, ord, place, trim(left(x, CAST(place AS INT))) AS a, trim(substr(x, place + 1)) AS b FROM c JOIN g USING (conv_id, ord))
 SELECT conv_id, ord, CAST(place AS INT) AS "at", sha256(a) AS a, sha256(b) AS b FROM s WHERE length(a) >= 6 AND length(b) >= 6"""


@query(_SPLIT)
def texts_at_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block's text split between its own box and the next one's, where a split is safe."""
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    b = column_blocks(spark, sf_dir).withColumn("mine", size).withColumn("other", F.lead("mine").over(ordered.over(["conv_id"], ["ord"]))).where("other is not null")
    return b.withColumn("s", splits.at_share(F.col("text"), F.col("mine"), F.col("other"))).where("s is not null").select("conv_id", "ord", "s.at", F.sha2("s.a", 256).alias("a"), F.sha2("s.b", 256).alias("b"))


@query()
def group_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation the answers' text, split over the questions by their lengths."""
    said = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    c = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(said("assistant"), " ").alias("whole"), said("user").alias("members"))
    return splits.split_over_members(c, "whole", "members")


# Each turn's text loses its end and gains a formula; its translation has that and, for two of three turns, the next turn's.
_LEAKS = """SELECT conv_id, turn, rtrim(text, '.!?;: ') || ' $a_' || turn || '$ and' AS source, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), CAST(turn % 4 * 20 AS INT)) || CASE turn % 5 WHEN 0 THEN '。' ELSE '' END || ' $a_' || turn || '$' || CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN '，等于 $a_' || (turn + 1) || '$ 的' ELSE '。对于 $a_' || (turn + 1) || '$' END AS translated FROM conversations"""


@query(f"""WITH l AS ({_LEAKS}), n AS (SELECT *, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM l), h AS (SELECT *, strpos(translated, '$a_' || nx || '$') AS hit FROM n),
 k AS (SELECT *, rtrim(left(translated, hit - 1)) AS head FROM h), f AS (SELECT *, rtrim(regexp_replace(head, '[，,、\\s]*(?:在|为|是|等于|对于)\\s*$', '')) AS first, rtrim(regexp_extract(left(translated, hit - 1), '^((?:.|\\n)*[。！？；])', 1)) AS sentence FROM k),
 c AS (SELECT *, CASE WHEN length(first) >= 8 THEN first ELSE sentence END AS kept FROM f) SELECT conv_id, turn, CASE WHEN hit > 0 AND length(kept) >= 8 THEN kept ELSE translated END AS text, coalesce(hit > 0 AND length(kept) >= 8, false) AS trimmed FROM c""")
def leaks_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations without what belongs to the next turn."""
    n = F.col("turn").cast("string")
    formula = lambda i: F.concat(F.lit("$a_"), i, F.lit("$"))
    source = F.concat(F.regexp_replace("text", r"[.!?;: ]+$", ""), F.lit(" "), formula(n), F.lit(" and"))
    leak = F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, F.concat(F.lit("，等于 "), formula((F.col("turn") + 1).cast("string")), F.lit(" 的"))).otherwise(F.concat(F.lit("。对于 "), formula((F.col("turn") + 1).cast("string"))))
    head = F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit(1), (F.col("turn") % 4 * 20).cast("int"))
    translated = F.concat(head, F.when(F.col("turn") % 5 == 0, "。").otherwise(""), F.lit(" "), formula(n), leak)
    c = t(spark, sf_dir, "conversations").select("conv_id", "turn", source.alias("source"), translated.alias("translated"))
    c = c.withColumn("its", F.lead("source").over(ordered.over(["conv_id"], ["turn"])))
    return c.withColumn("r", splits.without_leak(F.col("translated"), F.col("source"), F.col("its"))).select("conv_id", "turn", "r.text", F.col("r.trimmed").isNotNull().alias("trimmed"))


# Conversations as groups that a provider named: odd ones go over from page 0 to page 1, even ones stay on a page.
_NAMED = """SELECT conv_id || '-' || turn AS item_id, 'g' || conv_id AS g, conv_id % 2 = 1 AS crosses, CASE WHEN conv_id % 2 = 1 AND turn >= 2 THEN 1 WHEN conv_id % 10 = 4 THEN turn % 2 ELSE 0 END AS page, turn, CASE WHEN conv_id % 12 = 6 THEN 0 ELSE turn END AS ro,
 trim(regexp_replace(text, '\\s+', ' ', 'g')) AS tx, CASE WHEN turn = 1 THEN CASE WHEN conv_id % 3 = 0 THEN 'left_column' ELSE 'right_column' END ELSE 'left_column' END AS zone, CASE turn WHEN 1 THEN 'tail' WHEN 2 THEN 'head' ELSE 'middle' END AS role FROM conversations"""


@query(f"""WITH i AS ({_NAMED}), n AS (SELECT *, length(replace(tx, ' ', '')) AS chars, row_number() OVER v - 1 AS pos, lag(tx) OVER v AS pt, lead(tx) OVER v AS nt, lead(page) OVER v AS np, lead(zone) OVER v AS nz, lead(role) OVER v AS nr, lead(length(replace(tx, ' ', ''))) OVER v AS nc FROM i WINDOW v AS (PARTITION BY g ORDER BY ro, page, turn)),
 o AS (SELECT g FROM n GROUP BY g, crosses HAVING count(*) >= 2 AND count(DISTINCT ro) = count(*) AND CASE WHEN crosses THEN min(page) = 0 AND max(page) = 1 AND count(*) FILTER (np > page) = 1 AND bool_and(np IS NULL OR np = page OR np = page + 1 AND role IN ('tail', 'single') AND nr IN ('head', 'single') AND zone = 'right_column' AND nz = 'left_column' AND chars >= 8 AND nc >= 8 AND chars + nc >= 32) ELSE min(page) = max(page) END)
 SELECT item_id, g AS continuation_group, CAST(pos AS INT) AS pos, sha256(coalesce(pt, '')) AS prev_sha256, sha256(coalesce(nt, '')) AS next_sha256 FROM n WHERE g IN (SELECT g FROM o)""")
def named_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of groups that a provider named and that hold together."""
    c, conv, turn = t(spark, sf_dir, "conversations"), F.col("conv_id"), F.col("turn")
    odd = conv % 2 == 1
    page = F.when(odd & (turn >= 2), 1).when(conv % 10 == 4, turn % 2).otherwise(0)
    zone = F.when(turn == 1, F.when(conv % 3 == 0, "left_column").otherwise("right_column")).otherwise("left_column")
    items = c.select(
        F.concat_ws("-", "conv_id", "turn").alias("item_id"), page.cast("int").alias("page_idx"), turn.alias("block_idx"), "text", F.lit(True).alias("bodylike"), zone.alias("zone"), F.lit("Double").alias("mode"),
        F.when(turn == 1, "tail").when(turn == 2, "head").otherwise("middle").alias("role"), F.lit("provider").alias("source"), F.when(odd, "cross_page").otherwise("intra_page").alias("scope"),
        F.concat(F.lit(" g"), conv.cast("string")).alias("group_id"), F.when(conv % 12 == 6, 0).otherwise(turn).cast("int").alias("reading_order"),
    )
    got = chains.provider_groups(items)
    return got.select("item_id", "continuation_group", "pos", F.sha2("prev_text", 256).alias("prev_sha256"), F.sha2("next_text", 256).alias("next_sha256"))
