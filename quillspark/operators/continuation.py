"""Paragraphs that go on over page borders, chained into groups.

Rows are read in order of page and place. A row's partner is the next eligible row; there is none if that is more than one
page ahead. Rows whose pair says join are chained. Reading stops for good at the first row that is met on its own and has
no partner: rows after it stay unchained. (The last row of a chain isn't met on its own.)

As pages never fall in this order, all of that is said by windows: partners by a look ahead, the stop by a minimum,
chains by a running sum of rows that don't join the eligible row before them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text


def chains(rows: DataFrame, doc: str, page: str, place: str, eligible: Column, source: str, decide: Callable[[Column, Column], Column] = text.pair_decision) -> DataFrame:
    """The rows with decision (join, candidate, break; null without a partner) and group, like cg-001-002: the page of a chain's first row and the chain's number in its document."""
    order = Window.partitionBy(doc).orderBy(page, place)
    ahead = order.rowsBetween(1, Window.unboundedFollowing)
    marked = rows.withColumn("__e", F.coalesce(eligible, F.lit(False))).withColumn("__pos", F.row_number().over(order))
    partner = F.first(F.when(F.col("__e"), F.struct(F.col(page).alias("page"), F.col(source).alias("text"))), ignorenulls=True).over(ahead)
    met = marked.withColumn("__p", partner).withColumn("__p", F.when(F.col("__p.page") - F.col(page) <= 1, F.col("__p")))
    decided = met.withColumn("decision", F.when(F.col("__p").isNotNull(), F.when(F.col("__e"), decide(F.col(source), F.col("__p.text"))).otherwise("break")))
    joins = F.col("__e") & (F.col("decision") == "join")
    edges = decided.withColumn("__join", F.coalesce(joins, F.lit(False)))
    # Of the eligible rows, whether the one before joins to this one.
    before = F.last(F.when(F.col("__e"), F.col("__join")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    linked = edges.withColumn("__joined", F.coalesce(F.col("__e") & before, F.lit(False)))
    alone = F.when(F.col("__p").isNull() & ~F.col("__joined"), F.col("__pos"))
    stopped = linked.withColumn("__stop", F.coalesce(F.min(alone).over(Window.partitionBy(doc)), F.lit((1 << 31) - 1)))
    starts = F.col("__join") & ~F.col("__joined") & (F.col("__pos") < F.col("__stop"))
    numbered = stopped.withColumn("__n", F.sum(F.when(starts, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__first", F.last(F.when(starts, F.col(page)), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    member = starts | (F.col("__joined") & (F.col("__pos") <= F.col("__stop")))
    name = F.concat(F.lit("cg-"), F.lpad((F.col("__first") + 1).cast("string"), 3, "0"), F.lit("-"), F.lpad(F.col("__n").cast("string"), 3, "0"))
    return numbered.withColumn("group", F.when(member, name)).drop("__e", "__pos", "__p", "__join", "__joined", "__stop", "__n", "__first")
