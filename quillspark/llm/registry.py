"""The queries of this subpackage: (spark, sf_dir) -> DataFrame, by name. Each works on whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import ball_kmeans, bpe, class_lm, common, compression_quality, divergence, fingerprints, fuzzy_lines, ngram_join, ppm_language, qgram_decontamination, stream_bpe, token_files, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows, order = fingerprints.in_order(common.table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("__next", F.lit(1), half))
    made = rows.withColumn("__next", F.lead("text").over(order)).select(
        "*", n.cast("long").alias("n_chars"), F.sha2(edited.cast("binary"), 256).alias("edited_sha256"),
        fingerprints.fingerprint(F.col("text")).alias("fp"), fingerprints.fingerprint(edited).alias("edited_fp"),
    ).drop("__next")
    met = made.withColumn("next_fp", F.lead("fp").over(order)).where("not __halo")
    return met.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", fingerprints.as_text(F.col("fp")).alias("fingerprint"), fingerprints.as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), fingerprints.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs, labels = common.table(spark, sf_dir, "documents", "doc_id", "text"), common.table(spark, sf_dir, "labels", "doc_id", "quality")
    model = compression_quality.fit(docs, labels.where(common.fold("doc_id", 3) != 1))
    scored = docs.withColumn("score", compression_quality.score(docs, model))
    return scored.select("doc_id", (common.fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    model, counts = class_lm.fit(docs.where(common.fold("doc_id", 5) != 1))
    return class_lm.score(docs, model, counts).select(F.col("id").alias("doc_id"), (common.fold("id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op4_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = common.fold("doc_id", 5) == 0
    model = ppm_language.fit(docs.where(~held_out), key="doc_id")
    return ppm_language.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, url_score."""
    return url_filter.judge(common.table(spark, sf_dir, "pages", "page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "url_score")


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_kept, text: each document with the lines that stay."""
    return fuzzy_lines.dedupe(common.table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_lines", "n_kept", "text")


def op7_token_files(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the files."""
    folder = common.scratch(spark, "token-files")
    token_files.write(common.table(spark, sf_dir, "documents", "doc_id", "text"), folder, path or public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.read(spark, folder).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids_le32").alias("ids_crc32"))


def op8_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, n_passages, passages (item_id, start, end, edits): a row for each document with the benchmark passages that it holds."""
    docs, items = common.table(spark, sf_dir, "documents", "doc_id", "text"), common.table(spark, sf_dir, "benchmark", "item_id", "text")
    n = F.size("__passages")
    return qgram_decontamination.flagged(docs, items).select("doc_id", (n > 0).alias("contaminated"), n.alias("n_passages"), F.col("__passages").alias("passages"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links."""
    return ngram_join.join(common.table(spark, sf_dir, "documents", "doc_id", "text")).select(F.col("id").alias("doc_id"), "class_id", "n_links")


def op10_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    coded = docs.select("doc_id", bpe.encode(F.col("text"), path).alias("ids")).withColumn("decoded", bpe.decode_bytes(F.col("ids"), path))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_stream_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    coded = docs.select("doc_id", stream_bpe.encode_bytes(F.col("text"), path).alias("ids")).withColumn("decoded", stream_bpe.decode(F.col("ids"), path))
    return coded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank."""
    return divergence.audit(common.table(spark, sf_dir, "documents", "text", "lang", "source"))


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    members, centroids = ball_kmeans.cluster(common.table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", 64)
    kept = members.select(F.col("id").alias("vec_id"), "cluster", "distance")
    sums = {r.cluster: r.s for r in kept.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row for each cluster
    of = lambda values, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("cluster") + 1) if len(values) else F.lit(None).cast(kind)
    return kept.select(
        "*", of([sums.get(i, 0) for i in range(len(centroids))], "long").alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"),
        of([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()], "string").alias("centroid_sha256"),
    )


QUERIES: dict[str, Query] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_compression_quality": op2_compression_quality,
    "op3_class_lm": op3_class_lm,
    "op4_ppm_language": op4_ppm_language,
    "op5_url_filter": op5_url_filter,
    "op6_fuzzy_lines": op6_fuzzy_lines,
    "op7_token_files": op7_token_files,
    "op8_qgram_decontamination": op8_qgram_decontamination,
    "op9_ngram_join": op9_ngram_join,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_stream_bpe": op11_stream_bpe,
    "op12_source_divergence": op12_source_divergence,
    "op13_ball_kmeans": op13_ball_kmeans,
}
ORACLES: dict[str, str] = {"op12_source_divergence": divergence.SQL, "op13_ball_kmeans": ball_kmeans.SQL}
