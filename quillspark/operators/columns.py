"""Two-column pages: which column a block stands in, texts that a neighbour in the other column has swallowed, and giving them back.

Blocks have page columns, ord (from 0 on a page), label, text, page_width and x0, y0, x1, y1. Blocks with a null side are left out of the signals.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators import grouped

# Labels, shares of the page's width, sizes and lengths that decide.
TEXT_LABELS = ("abstract", "aside_text", "doc_title", "figure_title", "footnote", "header", "number", "paragraph_title", "reference_content", "text", "vision_footnote")
NOT_BODY = ("aside_text", "footnote", "footer", "footer_image", "header", "header_image", "number", "vision_footnote")
BODY, FRONT = ("text", "abstract"), ("doc_title", "abstract")
FULL, NARROW, WIDE, SHARED_HEIGHT = 0.62, 0.18, 0.48, 0.25
SLOT_AREA, SLOT_HEIGHT, PEER_TEXT, CARRIED_TEXT, CONTEXT_GAP = 8000.0, 48.0, 12, 48, 96.0
LEAST_SHARE, MOST_SHARE, SPLIT_TEXT, SPLIT_PART = 0.18, 0.55, 16, 6


def column_of(width: str = "page_width") -> Column:
    """full, left or right; unknown on a page without width."""
    wide, center = F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")), (F.col("x0") + F.col("x1")) / 2
    return F.when(~(F.col(width) > 0), "unknown").when(wide >= F.col(width) * FULL, "full").when(center <= F.col(width) / 2, "left").otherwise("right")


def beside(a: str, b: str) -> Column:
    """Whether two blocks share a quarter of the lower one's height."""
    shared = F.least(F.col(f"{a}y1"), F.col(f"{b}y1")) - F.greatest(F.col(f"{a}y0"), F.col(f"{b}y0"))
    height = lambda x: F.greatest(F.lit(1.0), F.col(f"{x}y1") - F.col(f"{x}y0"))
    return shared >= F.least(height(a), height(b)) * SHARED_HEIGHT


def signals(blocks: DataFrame, page: list[str]) -> DataFrame:
    """The blocks with column, mode (double, single, unknown), split_x, empty_text, peer, absorbed (it holds a neighbour's text) and missing (its text is elsewhere).

    A page is double if two text blocks of a column's width stand on each side, or one on each and some block of a side is empty. A text block
    and an empty one next to it in order, on different sides and beside each other, are absorber and peer. Neighbours meet by joins on the order, so
    no page is gathered; a page's medians come from counts.
    """
    by = [*page, "ord"]
    b = blocks.where("x0 is not null and y0 is not null and x1 is not null and y1 is not null")
    b = b.withColumn("label", F.lower(F.trim(F.coalesce("label", F.lit(""))))).withColumn("text", F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\r\n\f\x0b")))
    b = b.withColumn("column", column_of()).withColumn("empty_text", F.length("text") < 2)
    share = F.try_divide(F.col("x1") - F.col("x0"), F.col("page_width"))
    slot = F.col("label").isin(*TEXT_LABELS) & share.between(NARROW, WIDE)
    side = lambda s: F.col("column") == s
    center = lambda s: F.when(slot & (F.col("text") != "") & side(s), (F.col("x0") + F.col("x1")) / 2)
    of = b.groupBy(*page).agg(
        *[F.count_if(slot & side(s)).alias(f"__{s}_slots") for s in ("left", "right")], *[F.count(center(s)).alias(f"__{s}_n") for s in ("left", "right")], *[F.percentile(center(s), 0.5).alias(f"__{s}_x") for s in ("left", "right")],
        F.bool_or(F.col("empty_text") & F.col("column").isin("left", "right")).alias("__some_empty"), F.max("page_width").alias("__width"),
    )
    filled = (F.col("__left_n") >= 2) & (F.col("__right_n") >= 2)
    sparse = ((F.col("__left_slots") >= 2) & (F.col("__right_slots") >= 2)) | ((F.col("__left_slots") >= 1) & (F.col("__right_slots") >= 1) & F.col("__some_empty"))
    mode = F.when(~(F.col("__width") > 0), "unknown").when(filled | sparse, "double").otherwise("single")
    middle = F.when(F.col("__width") > 0, F.col("__width") / 2).otherwise(0.0)
    pages = of.select(*page, mode.alias("mode"), F.round(F.when(mode == "double", F.coalesce((F.col("__left_x") + F.col("__right_x")) / 2, middle)).otherwise(middle), 3).alias("split_x"))

    one = b.join(pages, page)
    fit = one.where((F.col("mode") == "double") & F.col("column").isin("left", "right") & ~F.col("label").isin(*NOT_BODY))
    names = ["ord", "column", "y0", "y1"]
    full = fit.where(~F.col("empty_text")).select(*[F.col(c).alias(f"__f_{c}") for c in (*page, *names)])
    none = fit.where("empty_text").select(*[F.col(c).alias(f"__e_{c}") for c in (*page, *names)], F.explode(F.array(F.col("ord") - 1, F.col("ord") + 1)).alias("__at"))
    same = F.col("__f_ord") == F.col("__at")
    for c in page:
        same = same & F.col(f"__f_{c}").eqNullSafe(F.col(f"__e_{c}"))
    pairs = full.join(none, same).where((F.col("__f_column") != F.col("__e_column")) & beside("__f_", "__e_"))
    # of two peers the later one counts
    role = lambda x, y: pairs.groupBy(*[F.col(f"__{x}_{c}").alias(f"__of_{c}") for c in by]).agg(F.max(f"__{y}_ord").alias("peer")).withColumn("__empty", F.lit(x == "e"))
    roles = role("f", "e").unionByName(role("e", "f"))
    met = one.join(roles, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by], "left")
    flag = lambda empty: F.coalesce(F.col("__empty") == empty, F.lit(False))
    return met.withColumn("absorbed", flag(False)).withColumn("missing", flag(True)).drop("__empty", *[f"__of_{c}" for c in by])


def split_place(text: str, target: int) -> int | None:
    """The space nearest to a place in a text, the earlier of two, within a sixth of its length (8 at least) around; not in the first or last four characters."""
    n = len(text)
    near = max(8, n // 6)
    low, high = max(4, target - near), min(n - 4, target + near)
    if n < 2 or low >= high:
        return None
    before, after = text.rfind(" ", low, min(target, high) + 1), text.find(" ", max(target, low), high + 1)
    found = [x for x in (before, after) if x >= 0]
    return min(found, key=lambda x: (abs(x - target), x)) if found else None


def size(r: np.ndarray) -> float:
    return max(1.0, r[2] - r[0]) * max(1.0, r[3] - r[1])


def shared_text(text: str, holder: np.ndarray, slot: np.ndarray) -> tuple[str, str, int] | None:
    """A text split over two boxes by their areas, at a space: what stays, what goes, and where; None if no split is safe."""
    text = re.sub(r"\s+", " ", text).strip()
    share = max(LEAST_SHARE, min(MOST_SHARE, size(slot) / (size(holder) + size(slot))))
    at = split_place(text, math.floor(len(text) * (1.0 - share))) if len(text) >= SPLIT_TEXT else None
    if at is None:
        return None
    a, b = text[:at].strip(), text[at:].strip()
    return (a, b, at) if len(a) >= SPLIT_PART and len(b) >= SPLIT_PART else None


def gap(a: np.ndarray, b: np.ndarray) -> float:
    """Vertical space between two blocks, 0 if they are beside each other or touch."""
    if near(a, b):
        return 0.0
    return max(0.0, b[1] - a[3], a[1] - b[3])


def near(a: np.ndarray, b: np.ndarray) -> bool:
    return min(a[3], b[3]) - max(a[1], b[1]) >= SHARED_HEIGHT * min(max(1.0, a[3] - a[1]), max(1.0, b[3] - b[1]))


class Page:
    """The body blocks of a two-column page. A donor gives to one slot and a slot takes once, in order."""

    def __init__(self, ords: list, columns: list, texts: list[str], boxes: np.ndarray):
        self.ords, self.columns, self.texts, self.boxes = list(ords), list(columns), list(texts), boxes
        self.n, self.done = range(len(ords)), set()
        self.empty = [len(x) < 2 for x in texts]
        self.rows: list[tuple] = []

    def slots(self) -> list[int]:
        tall = lambda i: size(self.boxes[i]) >= SLOT_AREA and self.boxes[i][3] - self.boxes[i][1] >= SLOT_HEIGHT
        return [i for i in self.n if self.empty[i] and self.columns[i] in ("left", "right") and tall(i)]

    def carries(self, slot: int) -> int | None:
        """The other column's block whose text goes on in a slot that is first in its column: the last before it in order, or else the lowest."""
        mine = [i for i in self.n if self.columns[i] == self.columns[slot]]
        real = [i for i in mine if size(self.boxes[i]) >= SLOT_AREA or len(self.texts[i]) >= CARRIED_TEXT]
        if not real or min(real, key=lambda i: (self.boxes[i][1], self.ords[i])) != slot:
            return None
        if not any(i != slot and not self.empty[i] and len(self.texts[i]) >= CARRIED_TEXT and gap(self.boxes[slot], self.boxes[i]) <= CONTEXT_GAP for i in mine):
            return None
        other = [i for i in self.n if self.columns[i] == ("right" if self.columns[slot] == "left" else "left") and not self.empty[i] and i not in self.done]
        before = [i for i in other if self.ords[i] < self.ords[slot]]
        for some, rank in ((before, lambda i: self.ords[i]), (other, lambda i: (self.boxes[i][3], self.ords[i]))):
            if some and len(self.texts[best := max(some, key=rank)]) >= CARRIED_TEXT:
                return best
        return None

    def stands_beside(self, slot: int) -> int | None:
        """The largest block of another column beside the slot."""
        fit = lambda i: i not in self.done and i != slot and not self.empty[i] and self.columns[i] != self.columns[slot] and len(self.texts[i]) >= PEER_TEXT and near(self.boxes[i], self.boxes[slot])
        return max((i for i in self.n if fit(i)), key=lambda i: size(self.boxes[i]), default=None) if self.carries(slot) is None else None

    def repair(self) -> list[tuple]:
        """(ord, role, strategy, peer, applied, text, at) for each block that took part, the last attempt of each."""
        out: dict[int, tuple] = {}
        for strategy, donor_of in (("column_carryover", self.carries), ("same_band", self.stands_beside)):
            for slot in self.slots():
                donor = donor_of(slot) if slot not in self.done else None
                if donor is None or not self.texts[donor] or self.texts[slot]:
                    continue
                parts = shared_text(self.texts[donor], self.boxes[donor], self.boxes[slot])
                a, b = self.ords[donor], self.ords[slot]
                if parts is None:
                    for i, me, peer in ((donor, a, b), (slot, b, a)):
                        out[i] = (me, *out.get(i, (0, None))[1:2], strategy, peer, False, self.texts[i], None)
                    continue
                self.texts[donor], self.texts[slot] = parts[:2]
                self.done |= {donor, slot}
                out[donor], out[slot] = (a, "absorber", strategy, b, True, parts[0], parts[2]), (b, "peer", strategy, a, True, parts[1], parts[2])
        return [out[i] for i in sorted(out, key=lambda i: self.ords[i])]


def body_start(blocks: DataFrame, page: list[str]) -> DataFrame:
    """page, __from: where the body begins after a title or abstract, -1 without these."""
    text = F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")))
    b = blocks.select(*page, "ord", "label", text.alias("__t"))
    front = F.col("label").isin(*FRONT) | ((F.col("label") == "paragraph_title") & (F.col("__t") == "abstract"))
    last = b.where(front).groupBy(*page).agg(F.max("ord").alias("__front"))
    begins = ((F.col("label") == "paragraph_title") & (F.col("__t") != "") & (F.col("__t") != "abstract")) | (F.col("label").isin(*BODY) & (F.col("__t") != "") & ~F.col("__t").startswith("keywords:"))
    after = b.join(last, page).where(F.col("ord") > F.col("__front")).groupBy(*page).agg(F.min(F.when(begins, F.col("ord"))).alias("__from"))
    return after


def repaired(blocks: DataFrame, page: list[str]) -> DataFrame:
    """page, ord, role, strategy, peer, applied, text, at: the blocks whose text is given back, of two-column pages with an empty slot.

    First a slot that heads its column takes the end of the other column's last block before it; then a slot takes part of the largest block beside it.
    Texts are split by the boxes' areas. Only pages that have a slot are gathered, a page at a time: what a donor gave decides what it can give later.
    """
    s = signals(blocks, page)
    named = blocks.withColumn("label", F.lower(F.trim(F.coalesce("label", F.lit("")))))
    body = s.where(F.col("label").isin(*BODY)).join(body_start(named, page), page, "left").where(F.coalesce("__from", F.lit(-1)) <= F.col("ord"))
    high, wide = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    room = (F.greatest(F.lit(1.0), wide) * F.greatest(F.lit(1.0), high) >= SLOT_AREA) & (high >= SLOT_HEIGHT)
    side = lambda x: F.count_if(F.col("column") == x)
    empty = F.count_if(F.col("empty_text") & F.col("column").isin("left", "right"))
    worth = body.groupBy(*page).agg(side("left").alias("__l"), side("right").alias("__r"), empty.alias("__e"), F.count_if(F.col("empty_text") & F.col("column").isin("left", "right") & room).alias("__slots"))
    worth = worth.where("__slots > 0 and __l > 0 and __r > 0 and (__l >= 2 and __r >= 2 or __e > 0)").select(*page)
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    names = ("ord", "role", "strategy", "peer", "applied", "text", "at")
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in page] + [f"ord {kinds['ord']}", "role string", "strategy string", f"peer {kinds['ord']}", "applied boolean", "text string", "at int"])

    def each(g: grouped.Group) -> dict:
        rows = Page(g["ord"], g["column"], g["text"], np.column_stack([np.asarray(g[c], float) for c in ("x0", "y0", "x1", "y1")])).repair()
        return {c: [g[c][0]] * len(rows) for c in page} | {name: [r[i] for r in rows] for i, name in enumerate(names)}

    chosen = body.join(worth, page, "left_semi").select(*page, "ord", "column", "text", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    return grouped.map_groups(chosen, page, ["ord"], schema, each)
