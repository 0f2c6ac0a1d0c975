"""Connected components of links between 64-bit ids, distributed.

Links are first contracted by union-find within each partition, then large-star and small-star steps alternate
until a round changes nothing. Each round's links are a table in the shared folder; the round before goes. Only counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import common

LINK = "a long, b long"


class Forest:
    """Union-find whose roots are least ids."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, root = self.up, x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def union(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def links(self) -> tuple[list[int], list[int]]:
        below = list(self.up)
        return below, [self.find(x) for x in below]


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each id's link to the least id that this partition connects it with; in parts of a bounded number of links."""
    forest = Forest()
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest.links()], ["a", "b"])
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.union(x, y)
        if len(forest.up) > 1_000_000:
            yield flush()
            forest = Forest()
    if forest.up:
        yield flush()


#: Ids with more than one of so many links (and more than LIGHT) are heavy: there are twice that many at most.
SHARE, LIGHT = 10_000, 1000


def with_least(links: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """links with m, the least id linked to a. The few heavy ids meet their links by broadcast, so that none of these gathers in a task."""
    heavy = F.col("n") > max(LIGHT, n // SHARE)
    few = F.broadcast(least.where(heavy).select("a", F.col("m").alias("__m")))  # 2 * SHARE rows at most
    met = links.join(few, "a", "left")
    return met.where("__m is not null").select("a", "b", F.col("__m").alias("m")).unionByName(met.where("__m is null").select("a", "b").join(least.where(~heavy).select("a", "m"), "a"))


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """a, b: every linked id that isn't the least of its component, with that least id. links: a and b, in any order."""
    spark = links.sparkSession
    path, was = common.scratch(spark, name), None
    links = common.write(links.select("a", "b").where("a != b").mapInArrow(contract, LINK).where("a != b").distinct(), path)
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if now == was or not now[0]:
            return links
        was = now
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = with_least(both, least, now[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = with_least(large, least, now[0]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        before, path = path, common.scratch(spark, name)
        links = common.write(small.where("a != b").distinct(), path)
        common.remove(spark, before)
