"""A training corpus from `documents`: quality, line dedup, near-duplicate documents, benchmark passages, tokens.

Each stage is (spark, docs, sf_dir) -> DataFrame. run() writes each stage's rows to the shared folder and reads them again for the next.
Columns beyond those of `documents` are carried along. Names that begin with two underscores are for the stages' own use.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, common, compression_quality, fuzzy_lines, ngram_join, qgram_decontamination

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores 0.5 or more.

    Null texts count as empty; empty ones get the score of nothing to compress. Repeated rows score alike and stay or go together. Without labels all
    documents stay (score 0.5); of no documents none remain.
    """
    labels = common.table(spark, sf_dir, "labels", "doc_id", "quality")
    model = compression_quality.fit(docs, labels.where(common.fold("doc_id", 3) != 1))
    return docs.where(compression_quality.score(docs, model) >= 0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a near-equal line precedes; those that lose every line go. n_chars follows the text.

    Null and blank texts stay as they are. Of rows repeated with the same id and text one keeps its lines and the others go. Of no documents none remain.
    """
    common.ship(spark)
    kept = fuzzy_lines.dedupe(docs.withColumnsRenamed({c: f"__was_{c}" for c in docs.columns if c in ("n_lines", "n_kept")}))
    kept = kept.where("n_lines = 0 or n_kept > 0").withColumn("n_chars", F.length("text").cast("long"))
    return kept.drop("n_lines", "n_kept").withColumnsRenamed({f"__was_{c}": c for c in ("n_lines", "n_kept")}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-equal documents the one with the least id (null ids last), then the least text hash; of repeated rows one.

    Null and empty texts are equal texts. Of no documents none remain.
    """
    common.ship(spark)
    of = ngram_join.join(docs)
    place = F.struct(F.col("id").isNull().alias("x"), F.col("id").alias("i"), F.col("text_hash").alias("h"))
    stay = of.groupBy("class_hash").agg(F.min(place).alias("at")).select(F.coalesce("at.i", F.lit(-(1 << 63))).alias("__i"), F.col("at.h").alias("__h"))
    keyed = docs.withColumn("__id", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))).withColumn("__th", ngram_join.text_hash(F.col("text")))
    once = common.one_of_each(keyed, "__id", "__th").where("__first")
    return once.join(stay.hint("shuffle_hash"), (F.col("__id") == F.col("__i")) & (F.col("__th") == F.col("__h"))).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Null and empty texts hold none and stay, and so do repeated rows. Without items all documents stay; of no documents none remain.
    """
    return qgram_decontamination.flagged(docs, common.table(spark, sf_dir, "benchmark", "item_id", "text")).where(F.size("__passages") == 0).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether decoding the ids gives the text again; a row for each row.

    Null and empty texts have no ids. Of no documents there are no rows.
    """
    common.ship(spark)
    coded = docs.withColumn("__c", bpe.encode_checked(F.col("text"), public_tokenizers.path(TOKENIZER)))
    return coded.select("doc_id", "lang", "source", F.size("__c.ids").cast("long").alias("n_tokens"), F.col("__c.ids").alias("ids"), F.col("__c.same_text").alias("same_text"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Compression, MinHash classes and byte-pair merges are not for SQL.
ORACLE_SQL = None
