"""Jaccard join on word n-grams: MinHash bands, then full sets (see near.py).

Two documents are linked if their sets of five-word runs have a Jaccard similarity of 0.8 or more. Bands of ROWS rows are
as many as find a pair at the threshold with probability RECALL. Classes are the connected components of links.

The result has a row for each document. `class_id` is the least id in its class (null ids are passed over if there is another), `n_links` the number of
other documents that it is linked to, copies of its own text included. `text_hash` and `class_hash` name its text and
its class's first text.

A null text counts as empty. Texts without a word have no n-gram: they are linked to equal texts only. Null ids are ids like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import near

N, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.999, 5


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """id, text_hash, class_hash, class_id, n_links of every row."""
    texts = docs.select(text_hash(F.col(text_col)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = near.classes(texts, near.word_shingles(n), threshold, near.choose_bands(threshold, recall, rows), rows, "ngram-join")
    ids = docs.select(F.col(id_col).cast("long").alias("id"), text_hash(F.col(text_col)).alias("text_hash"))
    copies = ids.groupBy("text_hash").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    named = copies.join(found.withColumnRenamed("id", "text_hash"), "text_hash", "left").select(
        "text_hash", "least", F.coalesce("root", "text_hash").alias("class_hash"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links")
    )
    firsts = named.groupBy("class_hash").agg(F.min("least").alias("class_id"))
    by_text = named.join(firsts, "class_hash").select("text_hash", "class_hash", "class_id", "n_links")
    return ids.join(by_text, "text_hash").select("id", "text_hash", "class_hash", "class_id", "n_links")
