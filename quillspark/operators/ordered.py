"""Operators over ordered rows. Order is always given by columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from quillspark import rounds

Names = list[str]


def over(by: Names, order: list) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def resequence(df: DataFrame, by: Names, order: list, name: str = "seq") -> DataFrame:
    """Rows numbered 1.. in order."""
    return df.withColumn(name, F.row_number().over(over(by, order)).cast("long"))


def boundary_role(by: Names, order: list) -> Column:
    """single, head, tail or middle, by the place among the rows of a group."""
    place, n = F.row_number().over(over(by, order)), F.count(F.lit(1)).over(Window.partitionBy(*by))
    return F.when(n == 1, "single").when(place == 1, "head").when(place == n, "tail").otherwise("middle")


def context(text: Column, by: Names, order: list, first: int, last: int, limit: int = 360, sep: str = " / ") -> Column:
    """Neighbours' texts in order, joined and cut at the limit."""
    return F.substring(F.array_join(F.collect_list(text).over(over(by, order).rowsBetween(first, last)), sep), 1, limit)


def islands(df: DataFrame, by: Names, order: list, joins_previous: Column, name: str = "island") -> DataFrame:
    """Runs of rows that each join the one before, numbered 1.. in each group."""
    w = over(by, order)
    return df.withColumn("__starts", F.when(joins_previous, 0).otherwise(1)).withColumn(name, F.sum("__starts").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__starts")


def carry_forward(value: Column, by: Names, order: list) -> Column:
    """The last value that isn't null before each row."""
    return F.last(value, ignorenulls=True).over(over(by, order).rowsBetween(Window.unboundedPreceding, -1))


def sessionize(df: DataFrame, by: Names, ts: str, state: str, tie: str) -> DataFrame:
    """Runs of one state: enter_at, exit_at (where the next begins) and duration_ms, never below 0."""
    order = [F.col(ts), F.col(tie)]
    changes = islands(df, by, order, F.col(state) == F.lag(state).over(over(by, order)), "stage_no")
    runs = changes.groupBy(*by, "stage_no", state).agg(F.min(ts).alias("enter_at"), F.count(F.lit(1)).alias("n_events"))
    out = runs.withColumn("exit_at", F.lead("enter_at").over(over(by, [F.col("stage_no")])))
    return out.withColumn("duration_ms", F.greatest(F.lit(0), F.floor((F.unix_micros(F.col("exit_at").cast("timestamp")) - F.unix_micros(F.col("enter_at").cast("timestamp"))) / 1000)))


def changes(df: DataFrame, by: Names, order: list, state: str, value: str) -> DataFrame:
    """Events of versions: created for a group's first, else status_changed and value_changed as they apply."""
    w = over(by, order)
    was = df.withColumn("__state", F.lag(state).over(w)).withColumn("__value", F.lag(value).over(w)).withColumn("__first", F.row_number().over(w) == 1)
    kinds = F.array(
        F.when(F.col("__first"), "created"),
        F.when(~F.col("__first") & ~F.col(state).eqNullSafe(F.col("__state")), "status_changed"),
        F.when(~F.col("__first") & ~F.col(value).eqNullSafe(F.col("__value")), "value_changed"),
    )
    return was.withColumn("change", F.explode(F.filter(kinds, lambda k: k.isNotNull()))).drop("__state", "__value", "__first")


def running_max(value: str, by: Names, order: list) -> Column:
    return F.max(value).over(over(by, order).rowsBetween(Window.unboundedPreceding, 0))


def latest(df: DataFrame, by: Names, rank: Names, keep: Names) -> DataFrame:
    """Of each group the row with the greatest rank. One aggregate, no sort of a group."""
    best = F.max_by(F.struct(*keep), F.struct(*rank))
    return df.groupBy(*by).agg(best.alias("__best")).select(*by, "__best.*")


def peak_open(df: DataFrame, by: Names, start: Column, end: Column, cell: int = 3_600_000_000) -> DataFrame:
    """The most intervals open at once in each group; one that ends as another begins is closed first.

    Time is cut into cells. What is open at a cell's beginning comes from the sums of the cells before it; within a cell its own edges are added in order. So a window
    sees a group's cells, or one cell's edges, but never all edges of a group.
    """
    edges = df.select(*by, F.explode(F.array(F.struct(start.alias("at"), F.lit(1).alias("step")), F.struct(end.alias("at"), F.lit(-1).alias("step")))).alias("e")).select(*by, "e.*")
    steps = edges.groupBy(*by, F.floor(F.col("at") / cell).alias("cell"), "at", "step").agg(F.sum("step").alias("d"))
    inside = steps.withColumn("open", F.sum("d").over(over([*by, "cell"], [F.col("at"), F.col("step")]).rowsBetween(Window.unboundedPreceding, 0)))
    cells = inside.groupBy(*by, "cell").agg(F.sum("d").alias("d"), F.max("open").alias("open"))
    before = F.coalesce(F.sum("d").over(over(by, [F.col("cell")]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cells.withColumn("open", F.col("open") + before).groupBy(*by).agg(F.max("open").cast("long").alias("peak"))


def batches(df: DataFrame, by: Names, order: Names, size: int) -> DataFrame:
    """Batches of a fixed size in order: batch_no from 0. Ranges number their own rows, so a large group is in many tasks."""
    return rounds.numbered(df, order, "__n", by).withColumn("batch_no", F.floor((F.col("__n") - 1) / size).cast("long")).drop("__n")
