"""Order statistics of groups of any size: no group's values meet in one task.

A number's cell keeps its order: numbers of a lower cell are less than those of a higher one. Cells are counted first, with partial sums in every task, and a window over a
group's cells (some thousands, whatever the rows) says which cell holds a rank, or what comes before a cell; only then rows of that cell are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Cells for each doubling of a number.
FINE = 1024


def cell(value: Column) -> Column:
    """A long that never falls as the number grows."""
    v = value.cast("double")
    return (F.signum(v) * F.floor(F.log2(F.abs(v) + 1.0) * FINE)).cast("long")


def same(by: list[str], a: str, b: str) -> list[Column]:
    return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]


def at_ranks(df: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """by, n, mean and, under each name, the value at a rank (from 0, an expression of n) among the group's sorted values. Nulls don't count; a rank outside gives null."""
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v")).withColumn("__cell", cell(F.col("__v")))
    w = Window.partitionBy(*by)
    counts = rows.groupBy(*by, "__cell").agg(F.count(F.lit(1)).alias("c"), F.sum("__v").alias("s"))
    placed = counts.withColumn("before", F.sum("c").over(w.orderBy("__cell")) - F.col("c")).withColumn("n", F.sum("c").over(w)).withColumn("mean", F.sum("s").over(w) / F.col("n"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), r.cast("long").alias("rank")) for name, r in ranks.items()]))
    targets = placed.select("*", wanted.alias("t")).where("t.rank >= before and t.rank < before + c").select(*by, "__cell", "n", "mean", "t.name", (F.col("t.rank") - F.col("before")).alias("at"))
    met = rows.alias("r").join(targets.alias("t"), [*same(by, "r", "t"), F.col("r.__cell") == F.col("t.__cell")])
    near = met.groupBy(*[F.col(f"t.{c}").alias(c) for c in by], "t.n", "t.mean", "t.name", "t.at", "r.__v").agg(F.count(F.lit(1)).alias("c"))
    run = F.sum("c").over(Window.partitionBy(*by, "name").orderBy("__v"))
    found = near.withColumn("run", run).where("at >= run - c and at < run")
    return found.groupBy(*by).agg(F.max("n").alias("n"), F.max("mean").alias("mean"), *[F.max(F.when(F.col("name") == name, F.col("__v"))).alias(name) for name in ranks])


def quantiles(df: DataFrame, by: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """by, n, mean, least, most and the interpolated quantile under each name."""
    at = lambda p: (F.col("n") - 1) * F.lit(p)
    ranks = {f"__{side}_{name}": f(at(p)) for name, p in probabilities.items() for side, f in (("low", F.floor), ("high", F.ceil))} | {"least": F.lit(0), "most": F.col("n") - 1}
    low, high = (lambda name: F.col(f"__low_{name}")), (lambda name: F.col(f"__high_{name}"))
    got = at_ranks(df, by, value, ranks)
    return got.select(*by, "n", "mean", "least", "most", *[(low(name) + (high(name) - low(name)) * (at(p) - F.floor(at(p)))).alias(name) for name, p in probabilities.items()])


def gaps(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, was, value: each pair of neighbours among a group's distinct values (was null for the least). Values of one cell meet in a window, and so do cells."""
    distinct = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("value")).distinct().withColumn("__cell", cell(F.col("value")))
    inside = distinct.withColumn("was", F.lag("value").over(Window.partitionBy(*by, "__cell").orderBy("value")))
    ends = distinct.groupBy(*by, "__cell").agg(F.min("value").alias("value"), F.max("value").alias("__most"))
    across = ends.withColumn("was", F.lag("__most").over(Window.partitionBy(*by).orderBy("__cell")))
    return inside.where("was is not null").select(*by, "was", "value").unionByName(across.select(*by, "was", "value"))


def last_few(df: DataFrame, by: list[str], order: list[str], value: str, few: int) -> DataFrame:
    """by, last: the values of a group's last rows in order, latest last. Each task keeps no more than a few rows of a group before they are sent."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    kept = df.select(*by, *order, value).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= few)
    return kept.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("__rn")).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]).alias("last"))
