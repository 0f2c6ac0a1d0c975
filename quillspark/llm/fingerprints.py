"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

Shingles are runs of five words (between white space; a shorter text is one shingle), each hashed once by xxHash64. The top byte of a hash
is its bin, the rest its value; a bin keeps its least value. An empty bin takes the value of another: bins are
probed in an order that a 2-universal hash of (bin, attempt) gives until one with a value is found (optimal
densification); after PROBES attempts, as short texts need them, the filled bin is taken that comes first in an order of all bins hashed for the empty one. The low 8 bits of the 256 bins' values are
packed, eight to a long. Two bins agree by chance with probability 1/256, which the likeness is corrected for.

To lay out all bins, one largest value for each is sorted in with the hashes; where it is the first of its bin,
the bin is empty. So nothing is exploded and no row leaves its partition.

A null text counts as empty; repeated rows have equal fingerprints; null ids come before all others. Of no documents there are no rows. Texts without a word have an empty fingerprint, like 1 to each other and 0 to all else.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import bind

WORDS, BINS, BITS, PROBES = 5, 256, 8, 48
VALUE = (1 << 56) - 1
PRIME = (1 << 31) - 1
SPACE = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """The words between ASCII white space."""
    cut = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(cut == "", F.array().cast("array<string>")).otherwise(F.split(cut, "[ \\t\\n\\x0B\\f\\r]+"))


def shingles(text: Column, n: int = WORDS) -> Column:
    """array<long>: a hash of each run of n words, in order."""
    at = lambda w, i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])
    return bind(words(text), lambda w: F.when(F.size(w) == 0, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: at(w, i))))


def bins(hashes: Column) -> Column:
    """array<long> of BINS values, null where a bin is empty."""
    last = F.array(*[F.lit(((j - BINS // 2) << 56) | VALUE) for j in range(BINS)])
    first = lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(F.get(s, i - 1), 56)))
    least = bind(F.sort_array(F.concat(hashes, last)), first)
    return F.transform(least, lambda x: F.when(x.bitwiseAND(VALUE) != VALUE, x.bitwiseAND(VALUE)))


def densified(values: Column) -> Column:
    """The values with empty bins filled; null where all are empty."""

    def probe(j: Column, t: int) -> Column:
        a, b = (0x9E3779B1 * (2 * t + 1)) % PRIME, (0x85EBCA6B * (t + 1)) % PRIME
        return (((j.cast("long") * a + b) % PRIME) % BINS).cast("int")

    def rest(filled: Column, j: Column) -> Column:
        """The value of the filled bin that comes first in the bin's own order of all bins."""
        return F.array_min(F.transform(filled, lambda f: F.struct(F.xxhash64(f["bin"], j).alias("at"), f["value"].alias("value"))))["value"]

    bins_of = lambda v: F.filter(F.transform(v, lambda x, j: F.struct(j.alias("bin"), x.alias("value"))), lambda f: f["value"].isNotNull())
    fill = lambda v, filled: F.transform(v, lambda x, j: F.coalesce(x, *[F.get(v, probe(j, t)) for t in range(PROBES)], rest(filled, j)))
    return bind(values, lambda v: bind(bins_of(v), lambda filled: F.when(F.size(filled) > 0, fill(v, filled))))


def packed(values: Column) -> Column:
    """array<long>: the low bits of eight bins in each; empty for null."""
    lane = lambda v, i, k: F.shiftleft(F.get(v, i * 8 + k).bitwiseAND((1 << BITS) - 1), BITS * k)

    def word(v: Column, i: Column) -> Column:
        made = lane(v, i, 0)
        for k in range(1, 8):
            made = made.bitwiseOR(lane(v, i, k))
        return made

    return bind(values, lambda v: F.when(v.isNull(), F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), lambda i: word(v, i))))


def fingerprint(text: Column) -> Column:
    """array<long>: the packed fingerprint of a text."""
    return packed(densified(bins(shingles(text))))


def as_text(fp: Column) -> Column:
    """A packed fingerprint in hex."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """double, 0 to 1: the estimated Jaccard similarity of the texts of two packed fingerprints."""

    def differing(z: Column) -> Column:
        for k in (4, 2, 1):
            z = z.bitwiseOR(F.shiftrightunsigned(z, k))
        return F.bit_count(z.bitwiseAND(0x0101010101010101))

    off = F.aggregate(F.transform(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), differing), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    near = F.greatest(F.lit(0.0), (1 - off / BINS - chance) / (1 - chance))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(near)


def in_order(docs: DataFrame, id_col: str, text_col: str, buckets: int | None = None) -> tuple[DataFrame, Window]:
    """id, text and __halo of the rows, dealt into ranges of ids, and the window in which each row's successor follows it.

    A range also gets the first rows of the next range (of the first range: after the last), marked __halo, so that
    no row has to look beyond its range. Range borders come from quantiles of the ids; first ids, from counting.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key = F.coalesce(F.col("id"), F.lit(-(1 << 63)))
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    borders = sorted({int(x) for x in rows.where("id is not null").approxQuantile("id", [i / n for i in range(1, n)], 0.25 / n)})
    # Two steps of search, so that many ranges cost a row little.
    wide = max(1, math.isqrt(len(borders)))
    outer, inner = borders[::wide], [borders[i : i + wide] for i in range(0, len(borders), wide)]
    longs = lambda x: F.array(*[F.lit(v).cast("long") for v in x]).cast("array<long>")
    above = lambda x, k: F.size(F.filter(x, lambda b: b <= k))
    if borders:
        o = above(longs(outer), key)
        bucket = bind(o, lambda o: F.when(o == 0, 0).otherwise((o - 1) * wide + above(F.get(F.array(*map(longs, inner)), o - 1), key)))
    else:
        bucket = F.lit(0)
    first = sorted((r[0], r[1]) for r in rows.select(bucket.alias("b"), key.alias("k")).groupBy("b").agg(F.min("k")).collect())  # a row for each range
    if not first:
        first = [(0, 0)]
    size = first[-1][0] + 1
    firsts, before = [None] * size, [None] * size
    for i, (b, k) in enumerate(first):
        firsts[b], before[b] = k, first[i - 1][0]
    own = F.struct(F.col("__b").alias("b"), F.lit(False).alias("halo"), F.lit(0).alias("wrap"))
    halo = F.struct(F.get(F.array(*[F.lit(x).cast("int") for x in before]), F.col("__b")).alias("b"), F.lit(True).alias("halo"), (F.col("__b") == first[0][0]).cast("int").alias("wrap"))
    is_first = F.col("__k") == F.get(F.array(*[F.lit(x).cast("long") for x in firsts]), F.col("__b"))
    spread = rows.withColumn("__k", key).withColumn("__b", bucket.cast("int")).withColumn("__to", F.explode(F.when(is_first, F.array(own, halo)).otherwise(F.array(own))))
    dealt = spread.select("id", "text", "__k", F.col("__to.b").alias("__b"), F.col("__to.halo").alias("__halo"), F.col("__to.wrap").alias("__wrap"))
    return dealt, Window.partitionBy("__b").orderBy("__wrap", "__k", "text", "__halo")
