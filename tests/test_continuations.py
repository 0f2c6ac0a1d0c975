"""Chains beside walking them, border pairs and splits: cases by hand and brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark import rounds
from quillspark.operators import chains, splits
from quillspark.plans import catalog, continuations  # noqa: F401

ITEM = "item_id string, page_idx int, text string, bodylike boolean, zone string, role string, repaired boolean, x0 double, y0 double, x1 double, y1 double"


def walked(items, pairs):
    """Each start walked on its own, later ones over earlier ones."""
    nexts = {p: n for p, n in pairs}
    targets, number, out = {n for _, n in pairs}, 1000, {}
    for start in [p for p, _ in pairs if p not in targets]:
        chain, at = [], start
        while at in items and at not in chain:
            chain.append(at)
            at = nexts.get(at, "")
        if len(chain) > 1:
            number += 1
            for i, x in enumerate(chain):
                out[x] = (f"cg-review-{number:04d}", i, items[chain[i - 1]] if i else "", items[chain[i + 1]] if i + 1 < len(chain) else "")
    return out


def chained(spark, items, pairs):
    i = spark.createDataFrame(list(items.items()), "item_id string, text string")
    p = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "place long, prev_id string, next_id string")
    return {r.item_id: (r.continuation_group, r.pos, r.prev_text, r.next_text) for r in chains.approved(i, p).collect()}


def test_chains_by_hand(spark):
    items = {x: f"text {x}" for x in "abcdefghij"}
    pairs = [("a", "b"), ("b", "c"), ("d", "e"), ("f", "missing"), ("g", "h"), ("h", "g"), ("i", "j"), ("j", "i"), ("x", "a")]
    # x isn't there, so the chain from a has no start; g and h go round, and so do i and j
    got = chained(spark, items, pairs)
    assert got == walked(items, pairs) == {"d": ("cg-review-1001", 0, "", "text e"), "e": ("cg-review-1001", 1, "text d", "")}
    assert chained(spark, items, []) == {}


@pytest.mark.parametrize("seed", range(3))
def test_chains_as_walked(spark, seed):
    rng = random.Random(seed)
    items = {str(i): f"t{i}" for i in range(60)}
    ids = [*items, "gone"]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(45)] + [(str(i), str(i + 1)) for i in range(rng.randint(20, 45))]
    rng.shuffle(pairs)
    assert chained(spark, items, pairs) == walked(items, pairs)


def test_numbers_over_ranges(spark):
    df = spark.range(1000).selectExpr("id * 37 % 1000 as v", "id % 3 as w").repartition(7)
    assert [(r.v, r.n) for r in rounds.numbered(df, ["v"]).orderBy("v").collect()] == [(i, i + 1) for i in range(1000)]
    assert rounds.numbered(df.limit(0), ["v"]).collect() == []


def test_border_pairs(spark):
    left, right, below = (100, 700, 280, 740), (300, 100, 480, 140), (100, 760, 280, 800)
    items = [
        ("end", 0, "so the", True, "left_column", "tail", False, *left), ("go", 0, "and on", True, "right_column", "head", False, *right), ("next", 1, "and on", True, "left_column", "head", False, *left), ("mid", 0, "x", True, "left_column", "middle", False, *below),
        ("mid2", 0, "y", True, "left_column", "middle", False, *below), ("fixed", 1, "and", True, "left_column", "head", True, *left), ("far", 0, "and on", True, "right_column", "middle", False, 900, 1, 950, 2), ("note", 0, "and on", False, "foot", "middle", False, *right),
    ]
    df = spark.createDataFrame([(*r[:7], *map(float, r[7:])) for r in items], ITEM)
    pairs = [("end", "go"), ("end", "next"), ("mid", "mid2"), ("end", "mid"), ("end", "fixed"), ("end", "gone"), ("mid", "far"), ("mid", "note")]
    got = chains.border_pairs(df, spark.createDataFrame(pairs, "prev_id string, next_id string"))
    assert {(r.prev_id, r.next_id) for r in got.collect()} == {("end", "go"), ("end", "next"), ("end", "mid")}
    d = df.alias("p").join(df.alias("n")).select(F.col("p.item_id").alias("p"), F.col("n.item_id").alias("n"), chains.join_score("p", "n").alias("j"), chains.break_score("p", "n").alias("b"), chains.decision("p", "n").alias("d"))
    of = {(r.p, r.n): (r.j, r.b, r.d) for r in d.collect()}
    assert of["end", "go"] == (3 + 3 + 2, 0, "join") and of["end", "next"] == (3 + 3 + 2, 0, "join")
    assert of["next", "end"][0] == -999 and of["end", "note"][2] == "break" and of["mid", "far"] == (-999, 0, "break")
    assert of["end", "mid"][:2] == (-999, 0)  # on a page only a hyphen goes on in the same column


def by_trying(whole, members):
    """The same rule, every place tried with its sum."""
    tokens = splits.MATH_TOKEN.findall((whole or "").strip())
    n = len(members)
    if n <= 1 or not tokens:
        return [(whole or "").strip()] * n if n <= 1 else [""] * n
    cost = [splits.cost(x) for x in tokens]
    weights = [max(100, splits.units(m)) for m in members]
    out, cursor = [], 0
    for i in range(n - 1):
        target, last = sum(cost) * sum(weights[: i + 1]) / sum(weights), len(tokens) - (n - i - 1)
        anchor, total = cursor + 1, sum(cost[:cursor])
        while anchor < last and total < target:
            total += cost[anchor - 1]
            anchor += 1
        tried = [(abs(sum(cost[:p]) - target), p) for p in range(max(cursor + 1, anchor - 36), min(last, anchor + 36) + 1)]
        best = min(tried)[1] if tried else anchor
        out.append("".join(tokens[cursor:best]).strip())
        cursor = best
    return [*out, "".join(tokens[cursor:]).strip()]


def test_shared_out_as_by_trying():
    rng = random.Random(6)
    words = ["ab", "word", "x", "。", "中", "文", " ", "  ", "\n", "<f1-abc/>", "[[FORMULA_3]]", "$a + b$", "\\$", ",", "1.5-2"]
    for _ in range(500):
        text = "".join(rng.choice(words) for _ in range(rng.randint(0, 120)))
        members = ["".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 6))]
        got = splits.shared_out(text, members)
        assert got == by_trying(text, members)
        assert "".join("".join(got).split()) == "".join(text.split()) or not members
    assert splits.shared_out(None, ["a", None]) == ["", ""] and splits.shared_out(" a ", []) == []
    assert splits.cost("<f1-abc/>") == 300 and splits.cost("word") == 220 and splits.cost("a") == 100 and splits.cost(" ") == 20 and splits.cost("中") == 100


def test_group_splits_of_the_table(spark, sf_dir):
    said = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        said.setdefault(r.conv_id, defaultdict(list))[r.role].append(r.text)
    got = {}
    for r in catalog.QUERIES["group_splits"](spark, sf_dir).orderBy("conv_id", "member").collect():
        got.setdefault(r.conv_id, []).append(r.part)
    assert got == {k: by_trying(" ".join(v["assistant"]), v["user"]) for k, v in said.items() if v["user"]}


def test_leaks(spark):
    rows = [
        ("能量大小为 $E$，在 $x_1$ 处取得", "the energy $E$ and", "at $x_1$", "能量大小为 $E$", ["$x_1$"]),
        ("能量为零的结果。对于 $y$ 与 $z$", "no formula and", "$y$ or $z$", "能量为零的结果。", ["$y$", "$z$"]),
        ("能量大小为 $E$，在 $x_1$", "the energy $E$.", "at $x_1$", "能量大小为 $E$，在 $x_1$", None),  # the source has ended
        ("短 $x_1$", "open and", "at $x_1$", "短 $x_1$", None),  # too little would stay
        ("第一句话到此结束了。在 $x_1$", "open and", "at $x_1$", "第一句话到此结束了。", ["$x_1$"]),
        ("same $x_1$ in both of them", "has $x_1$ and", "at $x_1$", "same $x_1$ in both of them", None),
        (None, "open", "$x$", "", None), ("text", None, "$x$", "text", None), ("text $x$ of eight", "open", None, "text $x$ of eight", None),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, t string, s string, n string")
    got = df.orderBy("i").select(splits.without_leak(F.col("t"), F.col("s"), F.col("n")).alias("r")).collect()
    assert [(r.r.text, r.r.trimmed) for r in got] == [r[3:] for r in rows]


def test_provider_groups(spark):
    kind = "item_id string, page_idx int, block_idx int, text string, bodylike boolean, zone string, mode string, role string, source string, scope string, group_id string, reading_order int"
    long = "a text of some length here"

    def item(g, i, page, order, scope="cross_page", zone="single_column", mode="single", role="middle", text=long, source="provider"):
        return (f"{g}{i}", page, i, text, True, zone, mode, role, source, scope, f" {g} ", order)

    two = lambda g, **kw: [item(g, 0, 3, 0, role="tail", **kw), item(g, 1, 4, 1, role="head", **kw)]
    rows = [
        *two("ok"), *two("short", text="tiny one"), *two("odd", zone="margin"), item("same", 0, 1, 5, "intra_page"), item("same", 1, 1, 2, "intra_page"), item("tie", 0, 1, 2, "intra_page"), item("tie", 1, 1, 2, "intra_page"), item("lone", 0, 1, 0, "intra_page"),
        item("neg", 0, 1, -1, "intra_page"), item("neg", 1, 1, 2, "intra_page"), item("apart", 0, 1, 0, "intra_page"), item("apart", 1, 2, 1, "intra_page"), item("far", 0, 1, 0, role="tail"), item("far", 1, 3, 1, role="head"),
        item("dbl", 0, 1, 0, zone="right_column", mode="Double", role="single"), item("dbl", 1, 2, 1, zone="left_column", mode="double", role="Single"), item("wrong", 0, 1, 0, zone="left_column", mode="double", role="tail"), item("wrong", 1, 2, 1, zone="left_column", mode="double", role="head"),
        *two("model", source="model"), item("back", 0, 2, 0, role="tail"), item("back", 1, 1, 1, role="head"), *two("math", text="a $ alone and more words"),
    ]
    got = {r.item_id: (r.continuation_group, r.pos, r.prev_text, r.next_text) for r in chains.provider_groups(spark.createDataFrame(rows, kind)).collect()}
    assert got == {
        "ok0": ("ok", 0, "", long), "ok1": ("ok", 1, long, ""), "same1": ("same", 0, "", long), "same0": ("same", 1, long, ""), "dbl0": ("dbl", 0, "", long), "dbl1": ("dbl", 1, long, ""),
    }
