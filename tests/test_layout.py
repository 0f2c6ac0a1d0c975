"""Rectangles and columns: cases by hand and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import columns, grouped, rectangles
from quillspark.plans import catalog, layout

BLOCK = "page int, ord int, label string, text string, page_width double, x0 double, y0 double, x1 double, y1 double"


def merges(a, b):
    size = lambda r: max(0, r[2] - r[0]) * max(0, r[3] - r[1])
    u = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
    if size(a) + size(b) <= 0 or size(u) / (size(a) + size(b)) > 2.4:
        return None
    row = abs(a[1] - b[1]) <= 6 and abs(a[3] - b[3]) <= 6
    i = (max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3]))
    if i[0] < i[2] and i[1] < i[3]:
        return u if row or size(i) / max(1, min(size(a), size(b))) >= 0.8 else None
    return u if row and max(0, i[0] - i[2]) <= 3 else None


def by_hand(rects):
    done = []
    for r in sorted(rects, key=lambda r: (r[1], r[0], r[3])):
        again = True
        while again:
            again, rest = False, []
            for other in done:
                if (u := merges(other, r)) is not None:
                    r, again = u, True
                else:
                    rest.append(other)
            done = rest
        done.append(r)
    return sorted(done)


def test_merge_as_by_hand(spark):
    rng = random.Random(4)
    pages = {}
    for p in range(60):
        pages[p] = [(float(x), float(y), float(x + rng.randint(1, 30)), float(y + rng.randint(1, 12))) for x, y in ((rng.randint(0, 60), rng.choice([rng.randint(0, 40), rng.randint(0, 400)])) for _ in range(rng.randint(1, 25)))]
    rows = [(p, i, *r) for p, rs in pages.items() for i, r in enumerate(rs)] + [(99, 0, None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "page int, i int, x0 double, y0 double, x1 double, y1 double")
    got = {}
    for r in rectangles.merge(df, ["page"], ["i"]).collect():
        got.setdefault(r.page, []).append((r.no, (r.x0, r.y0, r.x1, r.y1)))
    assert {p: sorted(r for _, r in rs) for p, rs in got.items()} == {p: by_hand(rs) for p, rs in pages.items()}
    assert all(sorted(n for n, _ in rs) == list(range(1, len(rs) + 1)) for rs in got.values())
    assert rectangles.merge(df.limit(0), ["page"]).collect() == []


def test_pages_merge_side_by_side(monkeypatch):
    """Many pages go through a few steps together, each as it would alone, in order."""
    rng = np.random.default_rng(8)
    size = np.r_[rng.integers(1, 30, 1500), 200, 1]
    start = np.r_[0, np.cumsum(size)]
    at = np.column_stack([rng.integers(0, 70, start[-1]), rng.integers(0, 90, start[-1])]).astype(float)
    rects = np.column_stack([at, at + rng.integers(-1, 30, at.shape) / 2])
    rects[7], rects[40, 2] = np.nan, np.inf
    order = np.lexsort((rects[:, 3], rects[:, 0], rects[:, 1], np.repeat(np.arange(len(size)), size)))
    rects, steps = rects[order], []
    first_hit = rectangles._first_hit
    monkeypatch.setattr(rectangles, "_first_hit", lambda *x: (steps.append(1), first_hit(*x))[1])
    of, got, low = rectangles.merged_side_by_side(rects, start, rects[:, :2])
    assert len(steps) < 1000 < len(rects)
    for g in range(len(size)):
        alone = rectangles.merged(rects[start[g] : start[g + 1]])
        assert np.array_equal(got[of == g], alone, equal_nan=True)
        assert np.array_equal(low[of == g], alone[:, :2], equal_nan=True)


def test_large_pages_merge_by_band(spark, monkeypatch):
    monkeypatch.setattr(rectangles, "MANY", 20)
    rng = random.Random(6)
    pages = {p: [(float(x), float(y), float(x + rng.randint(1, 30)), float(y + rng.randint(1, 12))) for x, y in ((rng.randint(0, 60), rng.randint(0, 300)) for _ in range(n))] for p, n in ((1, 5), (2, 60), (3, 20), (None, 90), (5, 1))}
    df = spark.createDataFrame([(p, i, *r) for p, rs in pages.items() for i, r in enumerate(rs)], "page int, i int, x0 double, y0 double, x1 double, y1 double")
    got = {}
    for r in rectangles.merge(df, ["page"], ["i"]).collect():
        got.setdefault(r.page, []).append((r.no, (r.y0, r.x0, r.y1), (r.x0, r.y0, r.x1, r.y1)))
    assert {p: sorted(r for *_, r in rs) for p, rs in got.items()} == {p: by_hand(rs) for p, rs in pages.items()}
    for rs in got.values():
        assert [n for n, *_ in sorted(rs)] == list(range(1, len(rs) + 1)) and [k for _, k, _ in sorted(rs)] == sorted(k for _, k, _ in rs)


def test_bands_keep_apart_what_cannot_merge(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 9.0, 5.0), (1, 0.0, 9.0, 9.0, 12.0), (1, 0.0, 30.0, 9.0, 31.0), (None, 0.0, 0.0, 1.0, 1.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.page or 0, r.y0, r.band) for r in rectangles.bands(df, ["page"]).collect()) == [(0, 0.0, 1), (1, 0.0, 1), (1, 9.0, 1), (1, 30.0, 2)]


def test_one_cut(spark):
    got = lambda cut: [tuple(p) for p in spark.range(1).select(F.explode(rectangles.pieces(F.expr("named_struct('x0', 0D, 'y0', 0D, 'x1', 10D, 'y1', 10D)"), F.expr(f"named_struct('x0', {cut[0]}D, 'y0', {cut[1]}D, 'x1', {cut[2]}D, 'y1', {cut[3]}D)")))).collect() for p in [p[0]]]
    assert got((4, 4, 6, 6)) == [(0, 0, 4, 10), (6, 0, 10, 10), (4, 0, 6, 4), (4, 6, 6, 10)]
    assert got((-1, -1, 11, 11)) == []
    assert got((9.9, 0, 20, 4)) == [(0, 0, 10, 10)]  # no more than half a point is cut
    assert got((0.04, 0, 20, 20)) == []  # what is left is too small
    assert got((20, 0, 30, 9)) == [(0, 0, 10, 10)]


#: A page whose right column begins with an empty slot; the left column's last text ends in mid-sentence.
OPEN = "Differences were found between Thioindigo and Indigo and the donor paragraph keeps running into the next column because the sentence is still open and ends with"
CARRIED = [
    ("text", "left intro text", 106, 895, 584, 943), ("text", "left middle text", 106, 944, 585, 1087), ("text", OPEN, 105, 1255, 586, 1473), ("text", "", 603, 895, 1082, 967),
    ("text", "For Dichloroindigo the next right column paragraph starts here.", 603, 968, 1083, 1111), ("text", "Another right column paragraph remains intact.", 602, 1112, 1083, 1422),
]


def blocks(spark, pages, width=1191.0):
    rows = [(p, i, label, text, width, *(None if x is None else float(x) for x in box)) for p, bs in enumerate(pages) for i, (label, text, *box) in enumerate(bs)]
    return spark.createDataFrame(rows, BLOCK)


def test_a_slot_that_heads_its_column_takes_what_was_open(spark):
    rows = {r.ord: r for r in columns.repaired(blocks(spark, [CARRIED]), ["page"]).collect()}
    assert set(rows) == {2, 3}
    assert (rows[2].role, rows[2].peer, rows[3].role, rows[3].peer) == ("absorber", 3, "peer", 2)
    assert rows[2].strategy == rows[3].strategy == "column_carryover" and rows[2].applied and rows[3].applied
    assert f"{rows[2].text} {rows[3].text}" == OPEN and rows[2].at == rows[3].at == len(rows[2].text)
    # the slot's share of both areas, at the nearest space
    share = 479 * 72 / (479 * 72 + 481 * 218)
    assert abs(len(rows[2].text) - len(OPEN) * (1 - share)) <= 8


def test_a_slot_takes_from_the_largest_block_beside_it_once(spark):
    page = [
        ("text", "short left head text", 100, 100, 500, 140), ("text", "a text of the right side that has swallowed what its neighbour said", 600, 200, 1000, 300), ("text", "", 100, 200, 500, 300), ("text", "", 100, 310, 500, 400),
        ("text", "small one beside both slots", 600, 290, 1000, 330), ("footnote", "", 100, 500, 500, 600),
    ]
    got = sorted((r.ord, r.role, r.strategy, r.peer, r.applied) for r in columns.repaired(blocks(spark, [page]), ["page"]).collect())
    assert got == [(1, "absorber", "same_band", 2, True), (2, "peer", "same_band", 1, True), (3, "peer", "same_band", 4, True), (4, "absorber", "same_band", 3, True)]
    # a text too short to be split is an attempt that failed; front matter before an abstract takes no part
    short = [("text", "under sixteen", 600, 200, 1000, 300), ("text", "", 100, 200, 500, 300)]
    assert [(r.ord, r.role, r.applied) for r in columns.repaired(blocks(spark, [short]), ["page"]).orderBy("ord").collect()] == [(0, None, False), (1, None, False)]
    front = [("doc_title", "T", 100, 10, 900, 40), *short, ("paragraph_title", "Abstract", 100, 400, 500, 430), ("text", "body", 100, 440, 500, 470)]
    assert columns.repaired(blocks(spark, [front]), ["page"]).collect() == []


def test_signals_of_a_page(spark):
    got = {r.ord: r for r in columns.signals(blocks(spark, [CARRIED]), ["page"]).collect()}
    assert {r.mode for r in got.values()} == {"double"}
    assert [got[i].column for i in range(6)] == ["left"] * 3 + ["right"] * 3
    assert not any(r.absorbed for r in got.values())  # the open text ends below the empty slot
    side = [("text", "left text with its peer", 100, 100, 500, 200), ("text", "", 600, 150, 1000, 250), ("text", "more", 100, 210, 500, 300), ("header", "", 600, 210, 1000, 300), ("text", "no box", None, 1, 2, 3)]
    got = {r.ord: r for r in columns.signals(blocks(spark, [side]), ["page"]).collect()}
    assert (got[0].peer, got[0].absorbed, got[1].missing, got[1].peer) == (1, True, True, 2)
    assert (got[2].peer, got[2].absorbed, got[3].missing, 4 in got) == (1, True, False, False)
    assert {r.mode for r in columns.signals(blocks(spark, [side], 0.0), ["page"]).collect()} == {"unknown"}


@pytest.mark.parametrize("seed", range(3))
def test_split_place_as_by_trying_all(seed):
    rng = random.Random(seed)
    for _ in range(500):
        text = " ".join("x" * rng.randint(1, 9) for _ in range(rng.randint(1, 20)))
        target, n = rng.randint(0, len(text)), len(text)
        low, high = max(4, target - max(8, n // 6)), min(n - 4, target + max(8, n // 6))
        some = [i for i, c in enumerate(text) if c == " " and low <= i <= high] if low < high else []
        assert columns.split_place(text, target) == min(some, key=lambda i: abs(i - target), default=None)


def test_groups_over_batches_and_nulls(spark):
    """A group's rows come in order and whole, however the batches fall."""
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(500).selectExpr("nullif(id % 9, 3) as k", "id as v")
        got = grouped.map_groups(df, ["k"], ["v"], "k long, n int, total long, sorted boolean", lambda g: {"k": [g["k"][0]], "n": [len(g["v"])], "total": [int(np.sum(g["v"]))], "sorted": [bool((np.diff(g["v"]) > 0).all())]})
        want = {(r.k, r.n, r.total, True) for r in df.groupBy("k").agg(F.count("*").cast("int").alias("n"), F.sum("v").alias("total")).collect()}
        assert {tuple(r) for r in got.collect()} == want and got.count() == 9
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_merged_rects_of_the_table(spark, sf_dir):
    pages = {}
    for r in layout.page_rects(spark, sf_dir).collect():
        pages.setdefault(r.page, []).append((r.x0, r.y0, r.x1, r.y1))
    got = {}
    for r in catalog.QUERIES["merged_rects"](spark, sf_dir).collect():
        got.setdefault(r.page, []).append((r.x0, r.y0, r.x1, r.y1))
    assert {p: sorted(x) for p, x in got.items()} == {p: by_hand(x) for p, x in pages.items()}


def test_repairs_of_the_table(spark, sf_dir):
    """Each repair splits its donor's text, and no block takes part in two."""
    of = {(r.conv_id, r.ord): r for r in layout.column_blocks(spark, sf_dir).collect()}
    rows = {(r.conv_id, r.ord): r for r in catalog.QUERIES["column_repairs"](spark, sf_dir).collect()}
    assert any(r.applied for r in rows.values())
    for (page, _), r in rows.items():
        if r.applied and r.role == "absorber":
            peer = rows[page, r.peer]
            assert peer.peer == r.ord and of[page, r.peer].text == "" and f"{r.text} {peer.text}".split() == of[page, r.ord].text.split()


def test_overlaps_kept_and_left_out(spark):
    kind = "page int, k int, x0 double, y0 double, x1 double, y1 double"
    df = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 100.0), (1, 2, 20.0, 0.0, 30.0, 10.0), (2, 3, 0.0, 0.0, 10.0, 10.0), (1, 4, 0.0, 200.0, 1.0, 201.0)], kind)
    other = spark.createDataFrame([(1, 9, 9.0, 50.0, 12.0, 52.0), (1, 9, 5.0, 60.0, 6.0, 160.0), (1, 8, 0.5, 200.0, 1.0, 201.0)], kind)
    ids = lambda **kw: sorted(r.k for r in rectangles.overlapping(df, other, ["page"], ["k"], **kw).collect())
    assert ids() == [1, 4] and ids(least=0.5) == [1] and ids(keep=False) == [2, 3]


def test_coordinate_systems(spark):
    box = "page int, height double, x0 double, y0 double, x1 double, y1 double"
    texts = spark.createDataFrame([(1, 100.0, 0.0, 0.0, 10.0, 10.0), (2, 100.0, 0.0, 90.0, 10.0, 100.0), (3, 100.0, 0.0, 45.0, 10.0, 55.0)], box)
    boxes = spark.createDataFrame([(p, 100.0, 0.0, *y) for p, y in ((1, (0.0, 5.0, 9.0)), (2, (0.0, 5.0, 9.0)), (3, (46.0, 5.0, 54.0)), (4, (0.0, 1.0, 1.0)), (1, (5.0, 0.0, 5.0)))], box)
    systems = {"flipped": rectangles.flipped("height"), "as_is": tuple(F.col(c) for c in rectangles.SIDES)}
    got = {r.page: (r.system, r.n, r.area) for r in rectangles.coordinate_system(boxes, texts, ["page"], systems).collect()}
    assert got == {1: ("as_is", 1, 45.0), 2: ("flipped", 1, 45.0), 3: ("flipped", 1, 40.0), 4: ("flipped", 0, 0.0)}


def test_collisions(spark):
    kind = "page int, i int, x0 double, y0 double, x1 double, y1 double, cover_x0 double, cover_y0 double, cover_x1 double, cover_y1 double, font_size double, leading double, estimated double, fit_to_box boolean, formulas boolean"
    block = lambda p, i, y0, y1, est=1.0, fit=False, math=False, x0=0.0: (p, i, x0, y0, x0 + 100, y1, x0, y0, x0 + 100, y1, 10.0, 0.5, est, fit, math)
    rows = [
        block(1, 0, 0.0, 50.0), block(1, 1, 50.2, 90.0), block(2, 0, 0.0, 50.0), block(2, 1, 52.0, 90.0), block(3, 0, 0.0, 50.0, est=52.0), block(3, 1, 52.0, 90.0), block(4, 0, 0.0, 50.0, fit=True), block(4, 1, 52.0, 90.0),
        block(5, 0, 0.0, 50.0, math=True), block(5, 1, 50.0, 90.0), block(6, 0, 0.0, 50.0), block(6, 1, 50.0, 90.0, x0=60.0), block(7, 0, 0.0, 50.0, est=99.0), block(7, 1, 54.0, 90.0), block(8, 0, 0.0, 0.5), block(8, 1, 0.5, 90.0),
    ]
    got = {r.page: (r.i, round(r.max_height, 6), round(r.min_font_size, 6), r.min_leading) for r in rectangles.collisions(spark.createDataFrame(rows, kind), ["page"], ["i"]).collect()}
    assert got == {1: (0, 44.0, 8.9, 0.44), 3: (0, 44.0, 8.9, 0.44), 4: (0, 44.0, 8.9, 0.44), 5: (0, 42.6, 8.9, 0.44)}
