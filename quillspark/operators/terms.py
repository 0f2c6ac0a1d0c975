"""Glossaries: parsing, merging, matching in texts, usage, and terms found in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import records, term_index
from quillspark.package import ship

MOST_ENTRIES = term_index.MOST_ENTRIES
# Fixed value: what a technical term looks like (Kohn-Sham, LCAO-MO, DFTB3 and SCF are such), where no letter, digit or _ touches it.
TERM = r"[A-Z][a-z]+(?:-[A-Z][A-Za-z0-9]+)+|[A-Z]{2,}(?:[-_/][A-Za-z0-9]+)+|[A-Za-z]+[0-9][A-Za-z0-9]*(?:[-_/][A-Za-z0-9]+)*|[A-Z]{2,}[a-z]*"
TECHNICAL = rf"(?<![\p{{L}}\p{{N}}_])({TERM})(?![\p{{L}}\p{{N}}_])"


def key(source: Column) -> Column:
    """Trimmed, A-Z in lower case."""
    return F.translate(F.trim(source), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def merge(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """term_key, source, target: overlay over base, later over earlier, at the place of the first. Inputs: source, target, pos."""
    both = base.withColumn("side", F.lit(0)).unionByName(overlay.withColumn("side", F.lit(1))).withColumn("term_key", key(F.col("source"))).where("term_key != ''")
    return records.last_write_wins(both, ["term_key"], ["side", "pos"], ["source", "target", "side"])


def matches(texts: DataFrame, glossary: DataFrame, text_col: str, term_col: str) -> DataFrame:
    """Texts with each glossary term in them, in any case, where no letter, digit or _ touches it. A glossary of more than MOST_ENTRIES is an error.

    Terms that are one word are met with a text's words by built-in functions; only a glossary with others needs Python.
    """
    known = glossary.withColumn("__term", F.lower(term_col))
    terms = sorted({r[0] for r in term_index.few(known.select("__term"), MOST_ENTRIES, "glossaries") if r[0]})
    words, others = ([x for x in terms if bool(term_index.RUN.fullmatch(x)) == one] for one in (True, False))
    low, found = F.lower(text_col), []
    if words:
        found.append(F.array_intersect(F.split(low, "[^A-Za-z0-9_]+"), F.array(*map(F.lit, words))))
    if others:
        ship(texts.sparkSession)
        found.append(term_index.present_terms(low, others))
    if not found:
        return texts.limit(0).join(glossary.limit(0))
    return texts.select(*texts.columns, F.explode(F.concat(*found)).alias("__term")).join(F.broadcast(known), "__term").drop("__term")


def technical_terms(texts: DataFrame, text_col: str, order: str, least: int, most: int) -> DataFrame:
    """term_key, term (spelled as seen first), hits: technical terms of all texts, most frequent first."""
    found = texts.select(order, F.posexplode(F.regexp_extract_all(text_col, F.lit(TECHNICAL), 1)).alias("place", "term")).withColumn("term_key", F.lower("term"))
    return found.groupBy("term_key").agg(F.min_by("term", F.struct(order, "place")).alias("term"), F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= least).orderBy(F.desc("hits"), "term_key").limit(most)
