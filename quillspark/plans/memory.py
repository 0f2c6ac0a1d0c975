"""Glossaries with levels, modes and contexts, and a term memory, against the documents. Both are made from `benchmark`'s words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators import term_index as ti
from quillspark.plans.catalog import query, spread, t

# A glossary's and a memory's sizes are theirs, see term_index; words are ranked by how often they stand in benchmark.
_RANKED = "SELECT w, n, row_number() OVER (ORDER BY n DESC, w) AS r FROM (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM benchmark) GROUP BY w)"
_ENTRIES = f"""SELECT w AS source, CASE WHEN r % 4 = 0 AND r > 100 THEN first_value(w) OVER (ORDER BY r) END AS context, r,
 CASE r % 3 WHEN 0 THEN 'preserve' WHEN 1 THEN 'canonical' ELSE 'preferred' END AS level, r % 2 = 0 AS ci FROM ({_RANKED}) WHERE r <= {ti.MOST_ENTRIES}"""


def ranked_words(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    """w, n, r: the most frequent words of benchmark."""
    words = t(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    top = words.orderBy(F.desc("n"), "w").limit(most)
    return top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "w")))


def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ranked_words(spark, sf_dir, ti.MOST_ENTRIES)
    level = F.when(F.col("r") % 3 == 0, "preserve").when(F.col("r") % 3 == 1, "canonical").otherwise("preferred")
    context = F.when((F.col("r") % 4 == 0) & (F.col("r") > 100), F.first("w").over(Window.orderBy("r")))
    return w.select(F.col("w").alias("source"), F.col("w").alias("target"), level.alias("level"), F.when(F.col("r") % 2 == 0, "case_insensitive").otherwise("exact").alias("match_mode"), context.alias("context"))


@query(f"""WITH e AS ({_ENTRIES}), h AS (SELECT doc_id, e.*, text, CASE WHEN ci THEN lower(text) ELSE text END AS hay FROM documents, e),
 f AS (SELECT * FROM h WHERE regexp_matches(hay, '(^|[^A-Za-z0-9_])' || source || '([^A-Za-z0-9_]|$)')),
 o AS (SELECT doc_id, source, context, text, hay, parts, unnest(range(1, len(parts))) AS k FROM (SELECT *, string_split(hay, source) AS parts FROM f WHERE context IS NOT NULL)),
 p AS (SELECT *, CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) AS BIGINT) + (k - 1) * length(source) AS a FROM o),
 c AS (SELECT DISTINCT doc_id, source FROM p WHERE NOT regexp_matches(coalesce(substr(hay, CASE WHEN a = 0 THEN length(hay) + 2 ELSE a END, 1), ''), '[A-Za-z0-9_]') AND NOT regexp_matches(substr(hay, a + length(source) + 1, 1), '[A-Za-z0-9_]')
  AND contains(lower(substr(text, greatest(0, a - {ti.CONTEXT}) + 1, a + length(source) + {ti.CONTEXT} - greatest(0, a - {ti.CONTEXT}))), context))
 SELECT doc_id, source, level, context, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY length(source) DESC, source) AS INT) AS place FROM f WHERE context IS NULL OR (doc_id, source) IN (SELECT (doc_id, source) FROM c)""")
def glossary_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries that match each document: exactly or in any case, with their context near, longest first."""
    return ti.matched_entries(spread(t(spark, sf_dir, "documents").select("doc_id", "text")), glossary(spark, sf_dir), "text").select("doc_id", "source", "level", "context", "place")


_HINTS = f"SELECT text AS key, count(*) AS hits FROM benchmark WHERE text IS NOT NULL GROUP BY text ORDER BY hits DESC, key DESC LIMIT {ti.MOST_HINTS}"


@query(f"""WITH k AS (SELECT w, n FROM ({_RANKED}) WHERE r <= {ti.MOST_TERMS}), d AS (SELECT doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents),
 m AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(w) DESC, w) AS rn FROM d, k WHERE w NOT IN ('from', 'with', 'this', 'that') AND regexp_matches(lower(s), '(^|[^A-Za-z0-9])' || w || '([^A-Za-z0-9]|$)')),
 a AS (SELECT doc_id, string_agg(w, '|' ORDER BY rn) AS terms, string_agg('- ' || w || ' => ' || w, chr(10) ORDER BY rn) AS shown FROM m WHERE rn <= {ti.SHOWN_TERMS} GROUP BY doc_id),
 h AS (SELECT key, hits, lower(trim(regexp_replace(key, '\\s+', ' ', 'g'))) AS low FROM ({_HINTS})),
 hl AS (SELECT DISTINCT key, hits, lower(trim(l)) AS line FROM (SELECT key, hits, unnest(string_split(key, chr(10))) AS l FROM h) WHERE length(trim(l)) >= {ti.LINE}),
 dl AS (SELECT DISTINCT doc_id, lower(trim(l)) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE length(trim(l)) >= {ti.LINE}),
 g AS (SELECT doc_id, key, hits FROM d, h WHERE s <> '' AND low <> '' AND (contains(lower(s), low) OR contains(low, lower(s))) UNION SELECT doc_id, key, hits FROM dl JOIN hl USING (line)),
 b AS (SELECT doc_id, string_agg(key, '|' ORDER BY hits DESC, key) AS hints, string_agg('- ' || key, chr(10) ORDER BY hits DESC, key) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, key) AS rn FROM g) WHERE rn <= {ti.SHOWN_HINTS} GROUP BY doc_id)
 SELECT d.doc_id, coalesce(terms, '') AS terms, coalesce(hints, '') AS hints, sha256(trim(concat_ws(chr(10), CASE WHEN a.shown IS NOT NULL THEN '{ti.TERMS_HEAD}' END, a.shown, CASE WHEN b.shown IS NOT NULL THEN '{ti.HINTS_HEAD}' END, b.shown), chr(10) || ' ')) AS summary_sha256
 FROM d LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN b ON b.doc_id = d.doc_id""")
def memory_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the memory has for each document: up to eight terms and two hints, and the summary of them as text."""
    terms = ranked_words(spark, sf_dir, ti.MOST_TERMS).select(F.col("w").alias("key"), F.col("w").alias("value"), F.col("n").cast("int").alias("hits"))
    hints = t(spark, sf_dir, "benchmark").where("text is not null").groupBy(F.col("text").alias("key")).agg(F.count(F.lit(1)).cast("int").alias("hits")).orderBy(F.desc("hits"), F.desc("key")).limit(ti.MOST_HINTS)
    got = ti.recalled(spread(t(spark, sf_dir, "documents").select("doc_id", "text")), terms, hints, "text")
    return got.select("doc_id", F.array_join("term_keys", "|").alias("terms"), F.array_join("hint_keys", "|").alias("hints"), F.sha2("summary", 256).alias("summary_sha256"))
