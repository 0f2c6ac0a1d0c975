"""Rectangles of a page that are merged until nothing more merges, and rectangles with others cut out of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark import rounds
from quillspark.operators import geometry, grouped

# Fixed values of the merge and of the cut.
GAP, MISALIGNED, GROWTH, OVERLAP, LEAST = 3.0, 6.0, 2.4, 0.8, 0.5
SIDES = ("x0", "y0", "x1", "y1")


def area(r: np.ndarray) -> np.ndarray:
    return np.maximum(0, r[..., 2] - r[..., 0]) * np.maximum(0, r[..., 3] - r[..., 1])


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([np.minimum(a[..., :2], b[..., :2]), np.maximum(a[..., 2:], b[..., 2:])], -1)


def should_merge(some: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Which of some rectangles merge with one: their union isn't much larger than both, and they share a row or most of the smaller one."""
    both = area(some) + area(one)
    with np.errstate(divide="ignore", invalid="ignore"):
        grows = ~(area(union(some, one)) / both <= GROWTH)
    row = (np.abs(some[:, 1] - one[1]) <= MISALIGNED) & (np.abs(some[:, 3] - one[3]) <= MISALIGNED)
    left, right = np.maximum(some[:, 0], one[0]), np.minimum(some[:, 2], one[2])
    top, bottom = np.maximum(some[:, 1], one[1]), np.minimum(some[:, 3], one[3])
    meets = (left < right) & (top < bottom)
    share = (right - left) * (bottom - top) / np.maximum(1.0, np.minimum(area(some), area(one)))
    return (both > 0) & ~grows & np.where(meets, row | (share >= OVERLAP), row & (np.maximum(0, left - right) <= GAP))


def merged(rects: np.ndarray) -> np.ndarray:
    """Rectangles (n x 4, in order) merged: each takes in what it merges with, and grows, until it takes in nothing more."""
    kept = np.empty((0, 4))
    for one in rects:
        at, changed = 0, False
        while len(kept):
            hits = np.flatnonzero(should_merge(kept[at:], one))
            if len(hits):
                at += int(hits[0])
                one, kept, changed = union(one, kept[at]), np.delete(kept, at, 0), True
            if not len(hits) or at >= len(kept):
                if not changed:
                    break
                at, changed = 0, False
        kept = np.vstack([kept, one])
    return kept


#: Rectangles of many pages that are merged side by side, about.
TOGETHER = 65_536
#: A page of more rectangles is dealt band by band.
MANY = 1024


def merged_side_by_side(rects: np.ndarray, start: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of groups of rectangles (n x 4; group g from start[g] to start[g + 1]) what merged gives: the groups' numbers, the rectangles, and low, of which a union has the least."""
    size = np.diff(start)
    largest, out, a = np.argsort(-size, kind="stable"), [], 0
    while a < len(largest):
        k = int(size[largest[a]])
        some = largest[a : a + max(1, TOGETHER // k)]
        out.append(_side_by_side(rects, low, some, start[some], size[some], k))
        a += len(some)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _side_by_side(rects: np.ndarray, low: np.ndarray, group: np.ndarray, start: np.ndarray, size: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row for each group, the largest first, and a place for each rectangle: each group's next rectangle takes in those of the places before it."""
    kept, lows = np.full((4, len(group), k), np.nan), np.full((low.shape[1], len(group), k), np.nan)
    areas, alive = np.full((len(group), k), np.nan), np.zeros((len(group), k), bool)
    for i in range(k):
        n = int(np.searchsorted(-size, -i))  # groups that have such a rectangle
        one, least = rects[start[:n] + i].T.copy(), low[start[:n] + i].T.copy()
        own = _areas(one)
        act, at, changed = np.arange(n if i else 0), np.zeros(n, np.int64), np.zeros(n, bool)
        while len(act):
            whole = len(act) == n
            first = _first_hit(kept[:, :n, :i] if whole else kept[:, act, :i], areas[:n, :i] if whole else areas[act, :i], one[:, act], own[act], at[act])
            hit = first < i
            h, f = act[hit], first[hit]
            one[:2, h], one[2:, h] = np.minimum(one[:2, h], kept[:2, h, f]), np.maximum(one[2:, h], kept[2:, h, f])
            least[:, h] = np.minimum(least[:, h], lows[:, h, f])
            own[h] = _areas(one[:, h])
            kept[:, h, f], areas[h, f], alive[h, f] = np.nan, np.nan, False
            at[h], changed[h] = f + 1, True
            again = act[~hit]
            again = again[changed[again]]
            at[again], changed[again] = 0, False
            act = np.sort(np.concatenate([h, again]))
        kept[:, :n, i], lows[:, :n, i], areas[:n, i], alive[:n, i] = one, least, own, True
    row, place = np.nonzero(alive)
    return group[row], kept[:, row, place].T, lows[:, row, place].T


def _areas(sides: np.ndarray) -> np.ndarray:
    return np.maximum(0, sides[2] - sides[0]) * np.maximum(0, sides[3] - sides[1])


def _first_hit(kept: np.ndarray, areas: np.ndarray, one: np.ndarray, own: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first place from at on whose rectangle should_merge with the group's own one, or the number of places."""
    x0, y0, x1, y1 = (c[:, None] for c in one)
    left, right, top, bottom = np.maximum(kept[0], x0), np.minimum(kept[2], x1), np.maximum(kept[1], y0), np.minimum(kept[3], y1)
    row = (np.abs(kept[1] - y0) <= MISALIGNED) & (np.abs(kept[3] - y1) <= MISALIGNED) & (left - right <= GAP)
    maybe = row | ((left < right) & (top < bottom))
    if at.any():
        maybe &= np.arange(areas.shape[1]) >= at[:, None]
    g, f = np.nonzero(maybe)
    k, o, a, b = kept[:, g, f], one[:, g], areas[g, f], own[g]
    share = (right[g, f] - left[g, f]) * (bottom[g, f] - top[g, f]) / np.maximum(1.0, np.minimum(a, b))
    both = a + b
    with np.errstate(divide="ignore", invalid="ignore"):
        grown = _areas(np.concatenate([np.minimum(k[:2], o[:2]), np.maximum(k[2:], o[2:])])) / both
    good = (both > 0) & (grown <= GROWTH) & (row[g, f] | (share >= OVERLAP))
    g, f = g[good], f[good]
    first = np.full(len(at), areas.shape[1])
    first[g[::-1]] = f[::-1]  # the first of each row is written last
    return first


def bands(rects: DataFrame, page: list[str]) -> DataFrame:
    """The rectangles with band: those of two bands of a page can't ever merge, as more than MISALIGNED lies between them.

    A page's height is cut into cells of that size; the cells in use, not the rectangles, meet in a window of the page.
    """
    first, last = F.floor(F.col("y0") / MISALIGNED), F.floor(F.greatest("y0", "y1") / MISALIGNED)
    used = rects.select(*page, F.explode(F.sequence(first, last)).alias("__cell")).distinct()
    w = Window.partitionBy(*page).orderBy("__cell")
    starts = F.coalesce(F.col("__cell") - F.lag("__cell").over(w) > 1, F.lit(True))
    of = used.withColumn("__start", starts).withColumn("band", F.sum(F.col("__start").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__start")
    of = of.select(*[F.col(c).alias(f"__of_{c}") for c in page], "__cell", "band")
    same = F.col("__first") == F.col("__cell")
    for c in page:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return rects.withColumn("__first", first).join(of, same).select(*rects.columns, "band")


def merge(rects: DataFrame, page: list[str], tie: list[str] = ()) -> DataFrame:
    """page, no (from 1, in order of y0, x0, y1), x0, y0, x1, y1: the merged rectangles of each page.

    Rectangles are taken in order of y0, x0, y1 to two places; tie orders equal ones. A task takes many pages at once. Pages of more than MANY rectangles are split
    at empty bands, so that such a page isn't one group unless they lie close throughout. A rectangle with a null side is left out; one without an area stays as it is.
    """
    whole = rects.where(" and ".join(f"{c} is not null" for c in SIDES)).select(*page, *tie, *[F.col(c).cast("double").alias(c) for c in SIDES])
    large = rounds.written(whole.groupBy(*page).agg(F.count("*").alias("__n")).where(F.col("__n") > MANY).select(*[F.col(c).alias(f"__of_{c}") for c in page]), "large-pages")
    if large.isEmpty():
        return _merged_pages(whole, page, tie)
    same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in page]
    return _merged_pages(whole.join(large, same, "left_anti"), page, tie).unionByName(_merged_bands(whole.join(large, same, "left_semi"), page, tie))


def _merged_pages(rects: DataFrame, page: list[str], tie: list[str]) -> DataFrame:
    # Whole numbers are rounded already. A union's rounded sides are the least (of -y1: the least, too) of its rectangles'.
    places = {f"__{c}": F.when(F.rint(c) == F.col(c), F.col(c)).otherwise(F.round(c, 2)) for c in ("y0", "x0", "y1")}

    def run(g: grouped.Group, start: np.ndarray) -> dict:
        low = np.column_stack([g["__y0"], g["__x0"], -g["__y1"]])
        of, m, low = merged_side_by_side(np.column_stack([g[c] for c in SIDES]), start, low)
        order = np.lexsort((m[:, 3], m[:, 2], m[:, 1], m[:, 0], -low[:, 2], low[:, 1], low[:, 0], of))
        of, m = of[order], m[order]
        no = np.arange(len(of)) - np.searchsorted(of, of) + 1
        first = start[of]
        named = {c: g[c][first] if isinstance(g[c], np.ndarray) else [g[c][i] for i in first.tolist()] for c in page}
        return named | {"no": no} | {c: m[:, i] for i, c in enumerate(SIDES)}

    kinds = {f.name: f.dataType.simpleString() for f in rects.schema.fields}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in page], "no int", *[f"{c} double" for c in SIDES]])
    return grouped.map_runs(rects, page, [*places, *tie, *SIDES], schema, run, places, [*page, *places, *SIDES], TOGETHER)


def _merged_bands(rects: DataFrame, page: list[str], tie: list[str]) -> DataFrame:
    order = [F.round(c, 2) for c in ("y0", "x0", "y1")]

    def each(g: grouped.Group) -> dict:
        m = merged(np.column_stack([np.asarray(g[c], float) for c in SIDES]))
        return {c: [g[c][0]] * len(m) for c in page} | {c: m[:, i] for i, c in enumerate(SIDES)}

    kinds = {f.name: f.dataType.simpleString() for f in rects.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in page] + [f"{c} double" for c in SIDES])
    got = grouped.map_groups(bands(rects, page), [*page, "band"], [*order, *tie, *SIDES], schema, each)
    return got.withColumn("no", F.row_number().over(Window.partitionBy(*page).orderBy(*order, *SIDES))).select(*page, "no", *SIDES)


def pieces(r: Column, cut: Column) -> Column:
    """array of up to four rectangles: r without cut. Strips to the left and right over the whole height, then above and below between them.

    r stays whole if no more than LEAST of it is cut, and pieces no larger than that are dropped.
    """
    x0, y0 = F.greatest(r["x0"], cut["x0"]), F.greatest(r["y0"], cut["y0"])
    x1, y1 = F.least(r["x1"], cut["x1"]), F.least(r["y1"], cut["y1"])
    struct = lambda *v: F.struct(*[x.alias(n) for n, x in zip(SIDES, v, strict=True)])
    size = lambda p: F.greatest(p["x1"] - p["x0"], F.lit(0.0)) * F.greatest(p["y1"] - p["y0"], F.lit(0.0))
    four = F.array(struct(r["x0"], r["y0"], x0, r["y1"]), struct(x1, r["y0"], r["x1"], r["y1"]), struct(x0, r["y0"], x1, y0), struct(x0, y1, x1, r["y1"]))
    hit = (x0 < x1) & (y0 < y1) & ((x1 - x0) * (y1 - y0) > LEAST)
    return F.when(hit, F.filter(four, lambda p: (p["x1"] > p["x0"]) & (p["y1"] > p["y0"]) & (size(p) > LEAST))).otherwise(F.array(struct(*[r[c] for c in SIDES])))


def cut_out(rects: DataFrame, protected: DataFrame, page: list[str], key: list[str], order: list[str], band: float = 48.0) -> DataFrame:
    """page, key, piece (from 1) and its sides: what is left of each rectangle once every protected one of its page is cut out, in their order.

    A rectangle meets only those that overlap it, in bands of y; one that is wholly covered has no row. page and key tell rectangles apart.
    """
    sides = [F.col(c).cast("double").alias(c) for c in SIDES]
    left = rects.select(*page, *key, *sides)
    right = protected.select(*page, F.struct(*order).alias("__order"), *sides)
    met = geometry.overlap_join(left, right, page, band).where(F.col("area") > LEAST)
    cuts = met.groupBy(*[F.col(f"l.{c}").alias(c) for c in page], *[F.col(f"l.{c}").alias(c) for c in key]).agg(F.array_sort(F.collect_list(F.struct("r.__order", *[F.col(f"r.{c}").alias(c) for c in SIDES]))).alias("__cuts"))
    on = left.join(cuts.select(*[F.col(c).alias(f"__of_{c}") for c in (*page, *key)], "__cuts"), [F.col(c) == F.col(f"__of_{c}") for c in (*page, *key)], "left")
    whole = F.array(F.struct(*SIDES))
    folded = F.when(F.col("__cuts").isNull(), whole).otherwise(F.aggregate("__cuts", whole, lambda parts, cut: F.flatten(F.transform(parts, lambda p: pieces(p, cut)))))
    return on.select(*page, *key, F.posexplode(folded).alias("__at", "__p")).select(*page, *key, (F.col("__at") + 1).alias("piece"), "__p.*")


def overlapping(rects: DataFrame, others: DataFrame, page: list[str], key: list[str], least: float = 0.0, keep: bool = True, band: float = 48.0) -> DataFrame:
    """The rectangles that share more than an area with some other of their page; those that don't with keep=False. page and key tell rectangles apart."""
    left, right = (d.select(*page, *more, *[F.col(c).cast("double").alias(c) for c in SIDES]) for d, more in ((rects, key), (others, [])))
    hits = geometry.overlap_join(left, right, page, band).where(F.col("area") > least).select(*[F.col(f"l.{c}").alias(f"__of_{c}") for c in (*page, *key)]).distinct()
    return rects.join(hits, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in (*page, *key)], "left_semi" if keep else "left_anti")


def flipped(height: str) -> tuple[Column, ...]:
    """A rectangle's sides with y counted from the page's other end."""
    return F.col("x0"), F.col(height) - F.col("y1"), F.col("x1"), F.col(height) - F.col("y0")


def coordinate_system(boxes: DataFrame, texts: DataFrame, page: list[str], systems: dict[str, tuple[Column, ...]], band: float = 48.0) -> DataFrame:
    """page, system, n, area: the coordinate system in which a page's boxes meet most of its text rectangles, by number, then by shared area, then by the systems' order.

    systems: of each the sides that a box has in it. Pages whose boxes meet no text get the first. Boxes without an area don't count.
    """
    real = boxes.where("x1 > x0 and y1 > y0")
    named = None
    for name, sides in systems.items():
        one = real.select(*page, F.lit(name).alias("system"), *[s.cast("double").alias(c) for s, c in zip(sides, SIDES, strict=True)])
        named = one if named is None else named.unionByName(one)
    met = geometry.overlap_join(named, texts.select(*page, *[F.col(c).cast("double").alias(c) for c in SIDES]), page, band)
    scores = met.groupBy(*[F.col(f"l.{c}").alias(c) for c in page], F.col("l.system").alias("system")).agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"))
    first = boxes.select(*page).distinct().select(*page, F.lit(next(iter(systems))).alias("system"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("area"))
    rank = F.coalesce(*[F.when(F.col("system") == s, -i) for i, s in enumerate(systems)])
    best = scores.unionByName(first).groupBy(*page).agg(F.max_by(F.struct("system", "n", "area"), F.struct("n", "area", rank)).alias("b"))
    return best.select(*page, "b.*")


# When a block's text may run into the next one's, and how much lower it is then made.
NARROW_SHARE, GAP_SEEN, GAP_TIGHT, GAP_KEPT, FILLED, USED = 0.6, 3.0, 0.5, 0.9, 0.98, 0.94
PAD, PAD_TIGHT, PAD_FORMULA, PAD_EM, PAD_MOST, LOWEST, FONT_LEAST, FONT_LESS, LEADING_LEAST, LEADING_LESS = 2.0, 3.4, 7.4, 0.6, 6.0, 8.0, 7.8, 1.1, 0.44, 0.12


def collisions(blocks: DataFrame, page: list[str], tie: list[str]) -> DataFrame:
    """The blocks whose text may run into the next block's in order of y0, x0, with max_height, min_font_size and min_leading to fit it in.

    blocks: sides, cover_x0 to cover_y1 (what is painted under a block), font_size, leading, estimated (the height that its text takes), fit_to_box and formulas (whether it has any).
    Neighbours overlap in width and lie close; a text that needs the room up to the next block, or a gap of almost nothing, is a risk. Only a page's blocks meet in a window.
    """
    w = Window.partitionBy(*page).orderBy("y0", "x0", *tie)
    names = ("x0", "y0", "x1", "cover_x0", "cover_y0", "cover_x1")
    b = blocks.withColumn("__n", F.lead(F.struct(*names)).over(w)).where("__n is not null")
    n = lambda c: F.col(f"__n.{c}")

    def share(p: str) -> Column:
        shared = F.least(F.col(f"{p}x1"), n(f"{p}x1")) - F.greatest(F.col(f"{p}x0"), n(f"{p}x0"))
        return F.greatest(F.lit(0.0), shared) / F.greatest(F.lit(1.0), F.least(F.col(f"{p}x1") - F.col(f"{p}x0"), n(f"{p}x1") - n(f"{p}x0")))

    gap, room, high = n("cover_y0") - F.col("cover_y1"), n("y0") - F.col("y0") - GAP_KEPT, F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))
    tight = gap <= GAP_TIGHT
    needs = tight | (F.col("estimated") > room * FILLED) | (F.col("fit_to_box") & (high / F.greatest(F.lit(1.0), room) >= USED))
    pad = F.greatest(F.lit(PAD), F.least(F.col("font_size") * PAD_EM, F.lit(PAD_MOST)))
    pad = F.when(tight, F.greatest(pad, F.when(F.col("formulas"), PAD_FORMULA).otherwise(PAD_TIGHT))).otherwise(pad)
    lower = F.least(room, F.greatest(F.lit(LOWEST), high - pad))
    at_risk = b.where((F.greatest(share(""), share("cover_")) >= NARROW_SHARE) & (gap <= GAP_SEEN) & (room > 0) & needs)
    sizes = {"max_height": F.least(F.greatest(F.lit(LOWEST), lower), lower), "min_font_size": F.least(F.col("font_size"), F.greatest(F.lit(FONT_LEAST), F.col("font_size") - FONT_LESS)), "min_leading": F.least(F.col("leading"), F.greatest(F.lit(LEADING_LEAST), F.col("leading") - LEADING_LESS))}
    return at_risk.withColumns(sizes).drop("__n")
