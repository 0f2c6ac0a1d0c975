"""Nested blocks made of conversations, and events with JSON of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import block_tree, json_rows
from quillspark.plans.catalog import query, t

_TURNS = """SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(regexp_replace(l, '\\s+', ' ', 'g'))), lambda l: l <> ''), chr(10)) AS text, length(text) % 5 = 0 AS alg,
 CASE WHEN length(text) % 9 = 0 THEN 'formula' ELSE 'text' END AS kind, CASE WHEN length(text) % 7 = 0 THEN 'abstract' WHEN length(text) % 6 = 0 THEN 'metadata' ELSE 'body' END AS semantic, CASE WHEN length(text) % 8 = 0 THEN 'footnote' ELSE 'paragraph' END AS layout,
 CASE WHEN length(text) % 10 = 0 THEN '' ELSE 'body' END AS structure, CASE WHEN length(text) % 13 = 0 THEN false WHEN length(text) % 17 = 0 THEN true END AS policy, length(text) % 11 = 0 AS skip FROM conversations"""


def page_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, page: each conversation as nested blocks. An even turn holds the next turn and the one after that, so blocks nest half as deep as turns go."""
    n = F.length("text")
    block = F.struct(
        F.struct(F.when(n % 9 == 0, "formula").otherwise("text").alias("kind"), F.col("text")).alias("content"), F.when(n % 5 == 0, "Algorithm").alias("type"), F.when(n % 8 == 0, "footnote").otherwise("paragraph").alias("layout_role"),
        F.when(n % 7 == 0, "abstract").when(n % 6 == 0, "metadata").otherwise("body").alias("semantic_role"), F.when(n % 10 == 0, "").otherwise("body").alias("structure_role"),
        F.when(n % 13 == 0, F.struct(F.lit(False).alias("translate"))).when(n % 17 == 0, F.struct(F.lit(True).alias("translate"))).alias("policy"), F.when(n % 11 == 0, F.array(F.lit("Skip_Translation"))).alias("tags"),
    )
    turns = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.to_json(block).alias("j")))).alias("of"))
    at = lambda k: F.get(F.col("of"), k)["j"]

    def around(inner: Column, i: Column) -> Column:
        kids = F.array_join(F.filter(F.array(at(2 * i + 1), F.when(inner != "", inner)), lambda x: x.isNotNull()), ",")
        return F.concat(F.substring(at(2 * i), F.lit(1), F.length(at(2 * i)) - 1), F.lit(',"blocks":['), kids, F.lit("]}"))

    evens = F.reverse(F.sequence(F.lit(0), F.floor((F.size("of") - 1) / 2).cast("int")))
    return turns.select("conv_id", F.concat(F.lit('{"blocks":['), F.aggregate(evens, F.lit(""), around), F.lit("]}")).alias("page"))


@query(f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM ({_TURNS})), e AS (SELECT conv_id, k, bool_or(alg) OVER (PARTITION BY conv_id ORDER BY k) AS inside FROM c WHERE k % 2 = 0),
 i AS (SELECT c.*, e.inside OR c.alg AS inside FROM c JOIN e ON e.conv_id = c.conv_id AND e.k = c.k - c.k % 2),
 a AS (SELECT *, NOT inside AND coalesce(policy, NOT skip AND kind = 'text' AND (semantic = 'abstract' OR semantic = 'body' AND structure = 'body' AND layout = 'paragraph')) AS admitted, NOT skip AND kind = 'formula' AS keep_origin FROM i)
 SELECT conv_id, 'p' || lpad(CAST(conv_id + 1 AS VARCHAR), CAST(greatest(3, length(CAST(conv_id + 1 AS VARCHAR))) AS INT), '0') || '-b000' || repeat('-i001', CAST(k // 2 AS INT)) || CASE WHEN k % 2 = 1 THEN '-i000' ELSE '' END AS item_id, CAST(k // 2 + k % 2 AS INT) AS depth, inside AS inside_algorithm,
 admitted, keep_origin, CASE WHEN structure <> '' THEN structure WHEN semantic = 'abstract' THEN 'abstract' ELSE 'body' END AS structure_role, sha256(text) AS text_sha256 FROM a WHERE text <> '' AND (admitted OR keep_origin)""")
def nested_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of nested pages that become items, with what they take over from the blocks around them."""
    got = block_tree.items(page_trees(spark, sf_dir), "page", "conv_id")
    return got.select("conv_id", "item_id", "depth", "inside_algorithm", "admitted", "keep_origin", "structure_role", F.sha2("text", 256).alias("text_sha256"))


_CUT = """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN left(props, length(props) - 1) WHEN event_id % 11 = 0 THEN replace(props, ': ', ': "x') || '"' WHEN event_id % 13 = 0 THEN '{"k": "text"}' WHEN event_id % 17 = 0 THEN '{"other": 1}' WHEN event_id % 19 = 0 THEN '[1]' WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 29 = 0 THEN props || ' x' ELSE props END AS props FROM events"""


@query(f"""WITH r AS ({_CUT}), w AS (SELECT *, CASE WHEN props IS NULL THEN 'null' WHEN NOT json_valid(props) THEN 'malformed JSON' WHEN json_type(props) <> 'OBJECT' THEN 'not an object' WHEN json_type(props, '$.k') IS NULL THEN 'missing field `k`' WHEN json_type(props, '$.k') NOT IN ('UBIGINT', 'BIGINT') THEN 'a field of another type' END AS why FROM r)
 SELECT event_id, CASE WHEN why IS NULL THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, 'failed to decode props: ' || why AS error, CASE WHEN why IS NULL THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE 0 END AS lenient_k FROM w""")
def decoded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' JSON read strictly, with the error of each row that can't be, and leniently."""
    e, p, i = t(spark, sf_dir, "events"), F.col("props"), F.col("event_id")
    cut = (
        F.when(i % 7 == 0, F.substring(p, F.lit(1), F.length(p) - 1)).when(i % 11 == 0, F.concat(F.replace(p, F.lit(": "), F.lit(': "x')), F.lit('"'))).when(i % 13 == 0, '{"k": "text"}').when(i % 17 == 0, '{"other": 1}').when(i % 19 == 0, "[1]")
        .when(i % 23 == 0, F.lit(None).cast("string")).when(i % 29 == 0, F.concat(p, F.lit(" x"))).otherwise(p)
    )
    rows = e.select("event_id", cut.alias("props"))
    read = json_rows.strict(F.col("props"), "k bigint", "props", ("k",))
    default = F.struct(F.lit(0).cast("bigint").alias("k"))
    return rows.withColumn("r", read).select("event_id", "r.value.k", "r.error", json_rows.lenient(F.col("props"), "k bigint", default, ("k",))["k"].alias("lenient_k"))


@query("""SELECT event_id, '{"job":{"api_key":"","user":' || user_id || ',"steps":[{"log":"call with [REDACTED] at ' || event_type || '","nested":[[{"mineru_token":""},"[REDACTED]/' || event_id || '"]]},null,true,1.50]},"props":' || replace(props, ': ', ':') || '}' AS payload, 'sent [REDACTED] to ' || event_type AS message FROM events""")
def redacted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' payloads without their secrets, at any depth."""
    key, text = F.concat(F.lit("sk-"), F.col("user_id").cast("string"), F.lit("-secret")), lambda *x: F.concat(*[F.lit(c) if isinstance(c, str) else c for c in x])
    payload = text('{"job":{"api_key":["', key, '"],"user":', F.col("user_id").cast("string"), ',"steps":[{"log":"call with ', key, " at ", F.col("event_type"), '","nested":[[{"mineru_token":{"a":1}},"', key, "/", F.col("event_id").cast("string"), '"]]},null,true,1.50]},"props":', F.col("props"), "}")
    e = t(spark, sf_dir, "events").select("event_id", payload.alias("payload"), text("sent ", key, " to ", F.col("event_type")).alias("message"), text(" ", key, " ").alias("api_key"), F.lit("").alias("token"))
    return json_rows.redact(e, "payload", ["api_key", "token"], ("message",)).select("event_id", "payload", "message")
