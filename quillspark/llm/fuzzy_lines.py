"""Line deduplication by MinHash over character runs (see near.py).

Lines are what stands between line feeds, compared without white space at their ends and in lower case. Two lines are linked
if their sets of eight-character runs have a Jaccard similarity of 0.8 or more, or if they are equal. Of each connected
component the first line in order of document id (null first), text and place stays; the others go. Blank lines stay.

The result has the rows and columns of the input, `text` without the lines that went, and the counts n_lines and n_kept of
its lines that aren't blank. A null text stays null with counts of 0. Of rows repeated with the same id and text one keeps its lines.
Ids needn't be unique. Other columns are carried along as they are.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import common, near

CHARS, THRESHOLD, RECALL, ROWS = 8, 0.8, 0.998, 4
SPACE = " \t\r\x0b\f"
#: For the table of lines: most are rare, so that dictionaries of them are given up late, and it is read a few times only.
QUICK = {"parquet.enable.dictionary#line": "false", "parquet.enable.dictionary#line_hash": "false", "parquet.compression.codec.zstd.level": "1"}


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """__id and __h of a row, place, line and line_hash of each of its lines that isn't blank."""
    cut = F.posexplode(F.split(F.lower(text_col), "\n")).alias("place", "raw")
    rows = docs.where(F.col(text_col).isNotNull()).select(key(id_col).alias("__id"), F.xxhash64(text_col).alias("__h"), cut)
    named = rows.where(~blank(F.col("raw"))).select("__id", "__h", "place", trimmed(F.col("raw")).alias("line"))
    return named.withColumn("line_hash", F.xxhash64("line"))


def blank(line: Column) -> Column:
    return F.ltrim(line, F.lit(SPACE)) == ""


def trimmed(line: Column) -> Column:
    """Most lines have no white space at their ends, and Spark's trim takes every line apart."""
    edge = reduce(or_, [f(line, F.lit(x)) for x in SPACE for f in (F.startswith, F.endswith)])
    return F.when(edge, F.btrim(line, F.lit(SPACE))).otherwise(line)


def key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars: int = CHARS, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """The input with the lines that stay, n_lines and n_kept; columns of these names are replaced."""
    spark = docs.sparkSession
    path = common.scratch(spark, "lines")
    lines = common.write(lines_of(docs, id_col, text_col), path, **QUICK)
    texts = lines.select(F.col("line_hash").alias("id"), F.col("line").alias("text"))
    found = near.classes(texts, near.char_shingles(chars), threshold, near.choose_bands(threshold, recall, rows), rows, "fuzzy-lines", counted=False)
    found = common.written(found.select(F.col("id").alias("line_hash"), F.col("root").alias("class")).where("line_hash != class"), "line-classes")
    # Equal lines are one before they meet their class, so that a frequent one doesn't gather in a task.
    n = found.count()
    of = F.broadcast(found) if common.fits_broadcast(n, 32) else found.hint("shuffle_hash")
    each = lines.groupBy("line_hash").agg(F.min(F.struct("__id", "__h", "place")).alias("at")).join(of, "line_hash", "left")
    first = each.groupBy(F.coalesce("class", "line_hash").alias("class")).agg(F.min("at").alias("at"))
    stay = first.groupBy("at.__id", "at.__h").agg(F.collect_list("at.place").alias("__stay")).withColumnsRenamed({"__id": "__kid", "__h": "__kh"})
    # The lines go before the texts are dealt: either is about as large as the input.
    stay = common.written(stay, "places")
    common.remove(spark, path)
    keyed = common.one_of_each(docs.drop("n_lines", "n_kept").withColumn("__id", key(id_col)).withColumn("__h", F.xxhash64(text_col)), "__id", "__h")
    met = keyed.join(stay.hint("shuffle_hash"), (F.col("__id") == F.col("__kid")) & (F.col("__h") == F.col("__kh")), "left").drop("__kid", "__kh")
    none = F.array().cast("array<int>")
    # The lines and the places of the blank ones are columns, as each is used more than once.
    cut = met.withColumn("__cut", F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
    blanks = cut.withColumn("__blanks", F.filter(F.transform("__cut", lambda x, i: F.when(blank(x), i)), lambda i: i.isNotNull()))
    kept = blanks.withColumn("__stay", F.when(F.col("__first"), F.coalesce("__stay", none)).otherwise(none)).withColumn("n_kept", F.size("__stay").cast("long"))
    text = F.array_join(F.transform(F.sort_array(F.concat("__stay", "__blanks")), lambda i: F.get("__cut", i)), "\n")
    counted = kept.withColumn("n_lines", F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size("__cut") - F.size("__blanks")).cast("long"))
    return counted.withColumn(text_col, F.when(F.col(text_col).isNotNull(), text)).drop("__stay", "__cut", "__blanks", "__id", "__h", "__first")
