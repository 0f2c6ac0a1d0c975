"""How the sources of a language differ in their words: a relational audit.

Terms are counted by (lang, source, term), with the documents that have the term: over each run of texts in Arrow and numpy, then over all by Spark. A language's vocabulary
is the terms of at least `least` of its documents. Groups are crossed with their language's vocabulary, so that a term that a group lacks counts 0 there;
smoothed shares of two groups meet on (lang, term), and triangular divergences are summed and ranked.

Shuffles go by (lang, source, term) or (lang, term), so a source or language with most of the rows is spread over all tasks, and counts are combined before
they are sent. What is joined by broadcast is a row for each group, behind a check of its size. Ranks to 10 are cut in each task before the window's shuffle.

Null text, lang and source count as ''. Texts without terms and languages without a vocabulary still give their groups, with value 0 for each other
source. Repeated rows are documents of their own. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm import bpe, common

#: Characters between terms; a term is a run of others.
BETWEEN = r"\x00-\x40\x5B-\x60\x7B-\x7F"
TERM = f"[^{BETWEEN}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of each byte: A-Z in lower case, a space for what stands between terms, else itself.
BYTES = bytes(ord(chr(b).lower()) if 65 <= b <= 90 else 32 if b < 128 and not 97 <= b <= 122 else b for b in range(256))
SCALE = 1_000_000_000
#: Bytes of a group's row when broadcast, names included.
GROUP_BYTES = 256


def counted(texts: pa.Array, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts and their groups' numbers: term, group, n (occurrences) and n_docs (texts with the term), once for each group and term."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
    # what stands between terms is ASCII, and no byte of a longer character is: bytes can be replaced one by one
    flat = pa.py_buffer((texts.buffers()[2] or pa.py_buffer(b""))[ends[0] : ends[-1]].to_pybytes().translate(BYTES))
    split = pc.split_pattern(pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(ends - ends[0]), flat]), " ")
    coded = split.values.dictionary_encode()
    size = max(len(coded.dictionary), 1)
    key = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy())) * size + coded.indices.to_numpy()
    key = key[coded.indices.to_numpy() != pc.index(coded.dictionary, "").as_py()]
    once = lambda key: np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    key.sort()
    new = once(key)
    n, key = np.diff(np.r_[new, len(key)]), key[new]
    key = group[key // size] * size + key % size
    order = np.argsort(key)
    key, n = key[order], n[order]
    new = once(key)
    return coded.dictionary.take(pa.array(key[new] % size)), key[new] // size, np.add.reduceat(n, new) if len(new) else n, np.diff(np.r_[new, len(key)])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), n_docs (documents with the term). Runs of a batch are counted in the worker, the sums in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in bpe.runs(batch.column(2)):
                names = pa.Table.from_batches([batch.slice(at, len(part)).select(["lang", "source"])])
                at += len(part)
                each = names.append_column("row", pa.array(np.arange(len(part)))).group_by(["lang", "source"]).aggregate([("row", "list")])
                rows = each.column("row_list").combine_chunks()
                group = np.empty(len(part), np.int64)
                group[rows.values.to_numpy()] = np.repeat(np.arange(len(rows)), np.diff(rows.offsets.to_numpy()))
                term, of, n, n_docs = counted(part, group)
                lang, source = (each.column(c).combine_chunks().take(pa.array(of)) for c in ("lang", "source"))
                yield pa.RecordBatch.from_arrays([lang, source, term.cast(pa.string()), pa.array(n, pa.int64()), pa.array(n_docs, pa.int64())], ["lang", "source", "term", "n", "n_docs"])

    common.ship(docs.sparkSession)
    counts = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, n_docs long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def share(n: Column, of: Column) -> Column:
    """1 + floor(SCALE (n + 2) / of), exact for any counts."""
    exact = lambda x, digits: x.cast(f"decimal({digits},0)")
    wide = F.call_function("div", exact(F.lit(SCALE), 10) * exact(n + 2, 19), exact(of, 20))
    return 1 + F.when(n < (1 << 63) // SCALE - 2, F.call_function("div", F.lit(SCALE) * (F.least(n, F.lit((1 << 63) // SCALE - 2)) + 2), of)).otherwise(wide)


def triangular(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank from documents' text, lang and source."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    groups = common.written(rows.select("lang", "source").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows")).drop("rows"), "divergence-groups")
    counts = common.written(term_counts(rows), "divergence-counts")
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("lang_n")).where(F.col("n_docs") >= least).drop("n_docs")
    n_groups = groups.count()
    few = lambda df: common.checked_broadcast(df, n_groups, GROUP_BYTES)
    cells = vocabulary.join(few(groups), "lang").join(counts.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left")
    dense = common.written(cells.select("lang", "source", "term", "lang_n", F.coalesce("n", F.lit(0)).cast("long").alias("n")), "divergence-cells")
    # each group's sums; lang_n and the number of terms are the same in all groups of a language
    sums = dense.groupBy("lang", "source").agg((F.sum("n") + 2 * F.count(F.lit(1))).alias("of"), (F.sum("lang_n") + 2 * F.count(F.lit(1))).alias("lang_of"))
    shares = dense.join(few(sums), ["lang", "source"]).select("lang", "source", "term", "n", share(F.col("n"), F.col("of")).alias("p"), share(F.col("lang_n"), F.col("lang_of")).alias("q"))

    two = shares.select("lang", "term", "source", "p").join(shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p2")), ["lang", "term"]).where(F.col("source") < F.col("item"))
    summed = two.groupBy("lang", "source", "item").agg(F.sum(triangular(F.col("p"), F.col("p2"))).alias("value"))
    both = summed.unionByName(summed.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    others = groups.join(few(groups.withColumnRenamed("source", "item")), "lang").where(F.col("source") != F.col("item"))
    pairs = others.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), triangular(F.col("p"), F.col("q")).alias("value"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(place))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))


#: The same in SQL, of the table documents.
SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
 t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM d),
 g AS (SELECT DISTINCT lang, source FROM d), c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
 v AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
 x AS (SELECT g.lang, g.source, v.term, v.lang_n, coalesce(c.n, 0) AS n FROM g JOIN v ON g.lang = v.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
 s AS (SELECT lang, source, CAST(sum(n) + 2 * count(*) AS BIGINT) AS d, CAST(sum(lang_n) + 2 * count(*) AS BIGINT) AS e FROM x GROUP BY ALL),
 p AS (SELECT x.lang, x.source, term, n, 1 + (1000000000 * (n + 2)) // d AS p, 1 + (1000000000 * (lang_n + 2)) // e AS q FROM x JOIN s ON x.lang = s.lang AND x.source = s.source),
 m AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(m.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
 UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
 k AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM u) SELECT * FROM k WHERE part = 'pair' OR rank <= 10"""
