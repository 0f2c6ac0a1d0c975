"""Conversations as items and their translations, reviewed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import quality
from quillspark.plans.catalog import query, t

_PAIRS = """SELECT conv_id || '-' || turn AS item_id, conv_id, turn, text || ' <f1-0aa/> and <f2-0bb/>' AS source, CASE WHEN turn % 9 = 8 THEN 'keep_origin' ELSE 'translate' END AS decision,
 CASE turn % 6 WHEN 0 THEN left(text, 20) || '<f1-0aa/><f2-0bb/>' WHEN 1 THEN '<f2-0bb/> <f1-0aa/>' WHEN 2 THEN left(text, 20) || '<f1-0aa/>' WHEN 3 THEN '<f1-0aa/> @@P3@@ <f2-0bb/> <f3-0cc/>' WHEN 4 THEN '{"translated_text": "<f1-0aa/><f2-0bb/>"}' ELSE ' ' END AS translated FROM conversations"""


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, text = F.col("turn") % 6, F.substring("text", 1, 20)
    c = t(spark, sf_dir, "conversations").withColumn("item_id", F.concat_ws("-", "conv_id", "turn"))
    items = c.select("item_id", F.concat("text", F.lit(" <f1-0aa/> and <f2-0bb/>")).alias("source"), F.lit(False).alias("direct_math"), F.lit(None).cast("string").alias("after"))
    made = (
        F.when(n == 0, F.concat(text, F.lit("<f1-0aa/><f2-0bb/>"))).when(n == 1, "<f2-0bb/> <f1-0aa/>").when(n == 2, F.concat(text, F.lit("<f1-0aa/>"))).when(n == 3, "<f1-0aa/> @@P3@@ <f2-0bb/> <f3-0cc/>")
        .when(n == 4, '{"translated_text": "<f1-0aa/><f2-0bb/>"}').otherwise(" ")
    )
    found = c.where("conv_id % 7 != 0").select("item_id", F.when(F.col("turn") % 9 == 8, "keep_origin").otherwise("translate").alias("decision"), made.alias("translated"))
    more = c.where("conv_id % 11 = 0").select(F.concat(F.lit("x"), "item_id").alias("item_id"), F.lit("translate").alias("decision"), F.lit("odd").alias("translated"))
    return quality.review(items, found.unionByName(more))


_ISSUES = f"""SELECT item_id, 'missing_result' AS kind, 'error' AS severity FROM ({_PAIRS}) WHERE conv_id % 7 = 0 UNION ALL SELECT 'x' || item_id, 'unexpected_result', 'error' FROM ({_PAIRS}) WHERE conv_id % 11 = 0
 UNION ALL SELECT item_id, k.kind, k.severity FROM ({_PAIRS}) p JOIN (VALUES (1, 'placeholder_order_changed', 'warning'), (2, 'placeholder_inventory_mismatch', 'error'), (3, 'placeholder_inventory_mismatch', 'error'), (3, 'unexpected_placeholder', 'error'), (4, 'protocol_shell_output', 'error'), (5, 'empty_translation', 'error'), (5, 'placeholder_inventory_mismatch', 'error'))
  AS k(n, kind, severity) ON k.n = p.turn % 6 WHERE p.conv_id % 7 <> 0 AND p.decision = 'translate'"""


@query(f"SELECT item_id, kind, severity, severity = 'error' AS retryable FROM ({_ISSUES})")
def review_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each translation."""
    return reviewed(spark, sf_dir).select("item_id", "kind", "severity", "retryable")


@query(f"""SELECT k.kind, k.severity, count(i.item_id) AS n, (SELECT count(*) > 0 FROM ({_ISSUES}) WHERE severity = 'error') AS has_errors FROM (VALUES {", ".join(f"('{k}', '{v[0]}')" for k, v in quality.KINDS.items())}) AS k(kind, severity) LEFT JOIN ({_ISSUES}) i ON i.kind = k.kind GROUP BY k.kind, k.severity""")
def issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by kind, with zeros."""
    return quality.summary(reviewed(spark, sf_dir))


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN left(replace(text, chr(10), ' '), 9) || '| <f1-0aa/> b, <f2-0bb/>' WHEN 1 THEN left(replace(text, chr(10), ' '), 9) || '|<f1-0aa/><f2-0bb/> end.' END AS repaired FROM conversations""")
def repaired_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations that repeat placeholders, without what is repeated where that is safe."""
    n, head = F.col("turn") % 4, F.concat(F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 1, 9), F.lit("|"))
    made = (
        F.when(n == 0, F.concat(head, F.lit(" <f1-0aa/>  <f1-0aa/> b , <f2-0bb/>"))).when(n == 1, F.concat(head, F.lit("<f1-0aa/><f2-0bb/><f1-0aa/> end .")))
        .when(n == 2, F.concat(head, F.lit("<f2-0bb/><f2-0bb/><f1-0aa/>"))).otherwise(F.concat(head, F.lit("<f1-0aa/><f2-0bb/><f3-0cc/>")))
    )
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", quality.without_repeated_placeholders(F.lit("see <f1-0aa/> and <f2-0bb/>"), made).alias("repaired"))
