"""Pairs of items that go on in one another: which pairs stand at a border, and chains of approved ones.

Chains may be long and may run into each other, so they aren't walked: each round doubles how far a start reaches along the pointers (prev to next),
and the rounds end when no item gets a new start. Rounds are written as tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark import rounds
from quillspark.functions import text

# Points between boxes, zones and roles.
COLUMN_GAP, LEAST_GAP, SAME_COLUMN, LINE_GAP = 96, 8, 28, 40
BORDER_ROLES, ENDS, BEGINS = ("head", "tail", "single"), ("tail", "single"), ("head", "single")
FIRST_GROUP = 1000


def crosses_column(p: str, n: str) -> Column:
    """On one page, n stands to the right of p, not too far. Boxes have x0, y0, x1, y1, null where there is none."""
    gap = F.col(f"{n}.x0") - F.col(f"{p}.x1")
    return F.coalesce((F.col(f"{p}.page_idx") == F.col(f"{n}.page_idx")) & (gap > LEAST_GAP) & (gap <= COLUMN_GAP), F.lit(False))


def likely_neighbours(p: str, n: str) -> Column:
    """Boxes of one page that text may go over between: the next column, or right below in the same one."""
    boxed = F.col(f"{p}.x0").isNotNull() & F.col(f"{n}.x0").isNotNull()
    gap = F.col(f"{n}.x0") - F.col(f"{p}.x1")
    below = (F.abs(F.col(f"{n}.x0") - F.col(f"{p}.x0")) <= SAME_COLUMN) & (F.col(f"{n}.y0") - F.col(f"{p}.y1") <= LINE_GAP)
    near = F.when(gap > LEAST_GAP, gap <= COLUMN_GAP).otherwise(below)
    return ~boxed | (F.col(f"{p}.page_idx") != F.col(f"{n}.page_idx")) | near


def eligible(x: str) -> Column:
    """Body text that isn't blank and whose dollar signs come in pairs."""
    t = text.normalized(F.col(f"{x}.text"))
    return F.coalesce(F.col(f"{x}.bodylike"), F.lit(False)) & (t != "") & (text.unescaped_dollars(t) % 2 == 0)


def join_score(p: str, n: str) -> Column:
    """Points for joining item n to item p before it, by page, box and text; -999 where they can't be one."""
    a, b = text.normalized(F.col(f"{p}.text")), text.normalized(F.col(f"{n}.text"))
    ahead = F.col(f"{n}.page_idx") - F.col(f"{p}.page_idx")
    across, ends = crosses_column(p, n), a.rlike(text.TERMINAL)
    possible = ahead.between(0, 1) & eligible(p) & eligible(n) & ((ahead == 1) | (likely_neighbours(p, n) & (across | a.endswith("-"))))
    # the text's own score has two points for an open end, which count over pages only
    score = text.join_score(a, b, text.starts_like_continuation(F.col(f"{n}.text"))) - F.when(ends, 0).otherwise(2)
    more = F.when(ahead == 1, F.when(ends, 0).otherwise(2)).otherwise(F.when(across, 2).otherwise(0))
    return F.when(F.coalesce(possible, F.lit(False)), score + more).otherwise(F.lit(-999))


def break_score(p: str, n: str) -> Column:
    a, b = text.normalized(F.col(f"{p}.text")), text.normalized(F.col(f"{n}.text"))
    boxed = F.col(f"{p}.x0").isNotNull() & F.col(f"{n}.x0").isNotNull() & (F.col(f"{p}.page_idx") == F.col(f"{n}.page_idx"))
    more = text.starts_like_continuation(F.col(f"{n}.text"))
    ends = F.when(a.rlike("[.!?]$"), 4).when(a.rlike(text.TERMINAL), 2).otherwise(0)
    begins = F.when(b.rlike(text.HEADING), 3).otherwise(0) + F.when(b.rlike("^[A-Z]") & ~more, 1).otherwise(0) - F.when(more, 3).otherwise(0)
    return F.greatest(F.lit(0), ends + begins + F.when(boxed & ~likely_neighbours(p, n), 2).otherwise(0))


def decision(p: str, n: str) -> Column:
    """join, break or candidate."""
    return text.let(F.struct(join_score(p, n).alias("j"), break_score(p, n).alias("k")), lambda s: F.when(s["j"] < 0, "break").when((s["j"] >= 4) & (s["j"] >= s["k"] + 2), "join").when((s["k"] >= 4) & (s["k"] >= s["j"] + 1), "break").otherwise("candidate"))


def border_pairs(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (prev_id, next_id) that a border lies between: other pages, or other zones that text may cross, or a role at the edge of its zone.

    Items whose text was repaired take no part, nor do pairs of items that aren't there. items: item_id, page_idx, text, bodylike, zone, role, repaired and box.
    """
    met = pairs.alias("q").join(items.alias("p"), F.col("q.prev_id") == F.col("p.item_id")).join(items.alias("n"), F.col("q.next_id") == F.col("n.item_id"))
    value = lambda side, c: F.lower(F.trim(F.coalesce(F.col(f"{side}.{c}"), F.lit(""))))
    fixed = lambda side: F.coalesce(F.col(f"{side}.repaired"), F.lit(False))
    legal = crosses_column("p", "n") & (value("p", "zone") == "left_column") & value("p", "role").isin(*ENDS) & (value("n", "zone") == "right_column") & value("n", "role").isin(*BEGINS)
    edge = value("p", "role").isin(*BORDER_ROLES) | value("n", "role").isin(*BORDER_ROLES)
    border = F.when(F.col("p.page_idx") != F.col("n.page_idx"), True).when(value("p", "zone") != value("n", "zone"), legal | (join_score("p", "n") >= 0)).otherwise(edge)
    return met.where(~fixed("p") & ~fixed("n") & border).select("q.*")


def approved(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """item_id, continuation_group, pos (from 0), prev_text, next_text: the items that approved pairs (place, prev_id, next_id) chain.

    A chain begins at an item that no pair leads to and follows, of each item, its last pair by place, as long as items are there and none comes twice. Chains of
    two items or more are numbered by the place of their first pair, cg-review-1001 on; where chains run into each other, items are the later one's. A
    start with several pairs is numbered for each and keeps the last number. No pairs give no rows.
    """
    known, last = items.select(F.col("item_id").alias("id")).distinct(), pairs.groupBy("prev_id").agg(F.max_by("next_id", "place").alias("next_id"))
    edges = rounds.written(last.join(known, F.col("prev_id") == F.col("id"), "left_semi").join(known, F.col("next_id") == F.col("id"), "left_semi"), "edges")
    heads = pairs.join(pairs.select(F.col("next_id").alias("id")).distinct(), F.col("prev_id") == F.col("id"), "left_anti").join(edges.select("prev_id"), "prev_id", "left_semi")
    starts = rounds.numbered(heads.select("prev_id", "place"), ["place", "prev_id"])
    best = rounds.written(starts.groupBy(F.col("prev_id").alias("item_id")).agg(F.max(F.struct("n", F.lit(0).cast("long").alias("back"))).alias("b")).select("item_id", "b.*"), "best")
    jumps, reached = edges.select("prev_id", "next_id", F.lit(1).cast("long").alias("hop")), None
    while True:
        ahead = best.join(jumps, F.col("item_id") == F.col("prev_id")).select(F.col("next_id").alias("item_id"), "n", (F.col("back") - F.col("hop")).alias("back"))
        best = rounds.written(best.unionByName(ahead).groupBy("item_id").agg(F.max(F.struct("n", "back")).alias("b")).select("item_id", "b.*"), "best")
        now = tuple(best.agg(F.count(F.lit(1)), F.sum("n")).first())
        if now == reached:
            break
        reached = now
        on = jumps.select(F.col("prev_id").alias("__p"), F.col("next_id").alias("__n"), F.col("hop").alias("__h"))
        jumps = rounds.written(jumps.join(on, F.col("next_id") == F.col("__p")).select("prev_id", F.col("__n").alias("next_id"), (F.col("hop") + F.col("__h")).alias("hop")), "jumps")
    said = items.groupBy("item_id").agg(F.first("text").alias("text"))
    members = best.join(said, "item_id").select("item_id", "n", (-F.col("back")).alias("pos"), text.normalized(F.col("text")).alias("text"))
    prev = members.select(F.col("n").alias("__pn"), F.col("pos").alias("__pp"), F.col("text").alias("prev_text"))
    after = members.select(F.col("item_id").alias("__id"), F.col("n").alias("__nn"), F.col("pos").alias("__np"), F.col("text").alias("__nt"))
    met = members.join(prev, (F.col("n") == F.col("__pn")) & (F.col("pos") == F.col("__pp") + 1), "left").join(edges, F.col("item_id") == F.col("prev_id"), "left").join(after, F.col("next_id") == F.col("__id"), "left")
    again = (F.col("__nn") == F.col("n")) & (F.col("__np") <= F.col("pos"))  # a chain that comes back to itself ends
    name = F.format_string("cg-review-%04d", F.col("n") + FIRST_GROUP)
    return met.select("item_id", name.alias("continuation_group"), "pos", F.coalesce("prev_text", F.lit("")).alias("prev_text"), F.when(again, "").otherwise(F.coalesce("__nt", F.lit(""))).alias("next_text"))

# Zones that text flows through, and characters that either side of a page border has, and both together.
FLOW, ONE_COLUMN, SIDE_TEXT, BOTH_TEXTS = ("single_column", "left_column", "right_column", "full_width"), ("single_column", "full_width"), 8, 32


def provider_groups(items: DataFrame) -> DataFrame:
    """item_id, continuation_group, pos (from 0), prev_text, next_text: the items of groups that a provider named and that hold together.

    items: item_id, page_idx, block_idx, text, bodylike, zone, mode, role, source, scope, group_id and reading_order. A group of one scope has two items at least, with reading orders that differ and aren't
    negative. One within a page stays on it. One over pages lies on two pages, one after the other, and crosses over once, from a last block of the last column to a first one
    of the first, with enough text on both sides. An item in a group of either scope that holds keeps the one over pages.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    named = items.alias("i").where(eligible("i")).select("i.*").withColumn("__g", F.trim(F.coalesce("group_id", F.lit("")))).where("source = 'provider' and scope in ('intra_page', 'cross_page') and __g != ''")
    named = named.withColumn("__t", text.normalized(F.col("text"))).withColumn("__chars", F.length(F.replace("__t", F.lit(" "), F.lit("")))).withColumn("__zone", low("zone")).withColumn("__mode", low("mode")).withColumn("__role", low("role"))
    by = ["scope", "__g"]
    w = Window.partitionBy(*by).orderBy("reading_order", "page_idx", "block_idx")
    after = F.lead(F.struct("page_idx", "__chars", "__zone", "__mode", "__role")).over(w)
    seen = named.withColumn("__n", after).withColumn("pos", (F.row_number().over(w) - 1).cast("int")).withColumn("prev_text", F.coalesce(F.lag("__t").over(w), F.lit(""))).withColumn("next_text", F.coalesce(F.lead("__t").over(w), F.lit("")))
    n = lambda c: F.col(f"__n.{c}")
    step = n("page_idx") - F.col("page_idx")
    zones = F.col("__zone").isin(*FLOW) & n("__zone").isin(*FLOW) & F.when(F.col("__mode") == "double", F.col("__zone") == "right_column").otherwise(F.col("__zone").isin(*ONE_COLUMN))
    zones = zones & F.when(n("__mode") == "double", n("__zone") == "left_column").otherwise(n("__zone").isin(*ONE_COLUMN))
    texts = (F.col("__chars") >= SIDE_TEXT) & (n("__chars") >= SIDE_TEXT) & (F.col("__chars") + n("__chars") >= BOTH_TEXTS)
    crosses = F.col("__role").isin(*ENDS) & n("__role").isin(*BEGINS) & zones & texts
    legal = F.when(F.col("__n").isNull() | (step == 0), True).otherwise((step == 1) & crosses)
    order = F.col("reading_order")
    whole = seen.groupBy(*by).agg(
        ((F.count(F.lit(1)) >= 2) & (F.count_if(order >= 0) == F.count(F.lit(1))) & (F.count_distinct(order) == F.count(F.lit(1)))).alias("__ordered"), (F.max("page_idx") - F.min("page_idx")).alias("__span"),
        F.bool_and(F.coalesce(legal, F.lit(False))).alias("__legal"), F.count_if(step > 0).alias("__crossings"),
    )
    good = whole.where(F.col("__ordered") & F.when(F.col("scope") == "intra_page", F.col("__span") == 0).otherwise((F.col("__span") == 1) & F.col("__legal") & (F.col("__crossings") == 1))).select(*by)
    found = seen.join(good, by, "left_semi").groupBy("item_id").agg(F.min_by(F.struct(F.col("__g").alias("continuation_group"), "pos", "prev_text", "next_text"), "scope").alias("c"))
    return found.select("item_id", "c.*")
