"""Order statistics beside sorting, and verdicts of all nine rules."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quillspark import rounds
from quillspark.functions import rules
from quillspark.operators import ordered, ranked, records


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(1)
    shapes = {"wide": lambda: rng.choice([-1.0, 1.0]) * 10 ** rng.uniform(-6, 12), "same": lambda: 5.0, "near": lambda: 1000 + rng.random() / 1e6, "few": lambda: float(rng.randint(-2, 2))}
    rows = [(k, f()) for k, f in shapes.items() for _ in range(500)] + [("one", 7.5), (None, 1.0), (None, 3.0), ("nulls", None)]
    rng.shuffle(rows)
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    return spark.createDataFrame(rows, "k string, v double").repartition(6), {k: sorted(v) for k, v in groups.items()}


def test_cells_keep_the_order(spark):
    xs = sorted([0.0, -0.0, 1e-300, -1e-300, 1e300, -1e300] + [s * 10.0**e * f for s in (-1, 1) for e in range(-8, 16) for f in (1, 1.0001, 3.7)])
    got = [r.c for r in spark.createDataFrame(list(enumerate(xs)), "i int, x double").orderBy("i").select(ranked.cell(F.col("x")).alias("c")).collect()]
    assert got == sorted(got)


def test_ranks_and_quantiles_as_by_sorting(values):
    df, groups = values
    got = {r.k: r for r in ranked.at_ranks(df, ["k"], "v", {"first": F.lit(0), "third": F.floor((F.col("n") - 1) * 0.3), "last": F.col("n") - 1, "out": F.col("n")}).collect()}
    assert {k: (r.n, r.first, r.third, r.last, r.out) for k, r in got.items()} == {k: (len(v), v[0], v[int((len(v) - 1) * 0.3)], v[-1], None) for k, v in groups.items()}
    q = {r.k: r for r in ranked.quantiles(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    for k, v in groups.items():
        assert math.isclose(q[k].p50, statistics.median(v), rel_tol=1e-12, abs_tol=1e-12)
        at = (len(v) - 1) * 0.95
        assert math.isclose(q[k].p95, v[int(at)] + (v[math.ceil(at)] - v[int(at)]) * (at - int(at)), rel_tol=1e-12, abs_tol=1e-12)
    assert {r.k for r in records.latency_summary(df, ["k"], "v").collect()} == set(groups)


def test_gaps_as_by_sorting(values):
    df, groups = values
    got = {}
    for r in ranked.gaps(df, ["k"], "v").collect():
        got.setdefault(r.k, set()).add((r.was, r.value))
    assert got == {k: set(zip([None, *sorted(set(v))], sorted(set(v)))) for k, v in groups.items()}  # noqa: B905


def test_peak_over_cells(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), s := rng.randint(-50, 500), s + rng.randint(1, 120)) for _ in range(300)]
    want = {}
    for k in "ab":
        edges = sorted([(s, 1) for g, s, _ in rows if g == k] + [(e, -1) for g, _, e in rows if g == k])
        n = best = 0
        for _, d in edges:
            n += d
            best = max(best, n)
        want[k] = best
    df = spark.createDataFrame(rows, "k string, s long, e long")
    for size in (1, 7, 10**9):
        assert {r.k: r.peak for r in ordered.peak_open(df, ["k"], F.col("s"), F.col("e"), size).collect()} == want


def test_numbers_in_groups(spark):
    df = spark.range(700).selectExpr("nullif(id % 3, 2) as k", "id * 11 % 700 as v").repartition(5)
    got = {}
    for r in rounds.numbered(df, ["v"], by=["k"]).collect():
        got.setdefault(r.k, []).append((r.n, r.v))
    for rows in got.values():
        assert [n for n, _ in sorted(rows)] == list(range(1, len(rows) + 1)) and [v for _, v in sorted(rows)] == sorted(v for _, v in rows)
    assert len(got) == 3


def test_last_few(spark):
    df = spark.createDataFrame([("a", i, f"s{i}") for i in range(20)] + [("b", 1, "x"), ("b", 2, None)], "k string, o int, s string")
    assert {r.k: r["last"] for r in ranked.last_few(df, ["k"], ["o"], "s", 3).collect()} == {"a": ["s17", "s18", "s19"], "b": ["x", None]}


def test_all_verdicts(spark):
    kind = "t string, skip boolean, labels array<string>, raw string, zone string, caption boolean"
    cases = [
        (" \n", True, None, None, None, True, "empty_source_text"), ("<f1-abc/> \t<t2-0f0/>", True, None, None, None, False, "placeholder_only"), ("prose of some words", True, ["code"], None, None, False, "policy_skip"),
        ("prose of some words", False, ["x", " skip_model_keep_origin "], "table", None, False, "skip_model_keep_origin"), ("prose of some words", None, ["x"], " Table ", None, False, "non_textual_raw_block"), ("(www.a.example)", None, None, "text", None, False, "hard_metadata_fragment"),
        ("me@a.example", None, None, None, None, False, "hard_metadata_fragment"), ("Copyright  2020 A. All rights reserved.", None, None, None, None, False, "hard_metadata_fragment"), (" ".join(["0A"] * 40), None, None, None, None, False, "protocol_hex_dump"),
        ("a 1é", None, None, None, None, True, "short_non_body_label"), ("a<f1-abc/>1", None, None, None, "Non_Flow", False, "short_non_body_label"), ("ab", False, None, None, "non_flow", False, None), ("ab", True, None, None, "non_flow", False, "policy_skip"), ("a-1", None, None, None, "non_flow", True, None),
        ("Plain prose is translated.", False, [], "text", "body", False, None), ("prose", None, [None], None, None, None, None),
    ]
    df = spark.createDataFrame([(i, *c[:-1]) for i, c in enumerate(cases)], f"i int, {kind}")
    more = {"skip": F.col("skip"), "labels": F.col("labels"), "raw_type": F.col("raw"), "zone": F.col("zone"), "is_caption": F.col("caption")}
    got = rules.with_verdict(df, "t", **more).orderBy("i").collect()
    assert [r.reason for r in got] == [c[-1] for c in cases] and {r.action for r in got if r.reason} == {"keep_origin"}
    assert [r.r for r in df.orderBy("i").select(rules.policy_verdict(F.col("t"), **more)[1].alias("r")).collect()] == [c[-1] for c in cases]
