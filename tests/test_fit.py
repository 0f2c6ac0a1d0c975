"""Texts in boxes, beside breaking one text at a time."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from quillspark.operators import fit
from quillspark.package import ship


def lines(width, text, formulas, size):
    if width <= 0 or size <= 0:
        return 1, 0
    room, n, special, used, has = max(1.0, width * 0.98 / size), 1, 0, 0.0, False
    for w, formula in zip(*fit.widths(text, formulas), strict=True):
        w = max(0.01, w)
        if used > 0 and used + w > room:
            special += has
            n, used, has = n + 1, 0.0, False
        if w > room:
            n += max(1, math.ceil(w / room)) - 1
            used = w % room
        else:
            used += w
        has = has or formula
    return max(1, n), special + has


def height(width, text, formulas, size, leading):
    n, special = lines(width, text, formulas, size)
    return round(n * max(size * 1.02, size * (1 + leading)) + special * size * (1.04 - 1.0), 2), n


def solve(width, tall, text, formulas, leading, least, most):
    low = max(7.8, least)
    high = max(low, most)
    best, (h, n) = low, height(width, text, formulas, low, leading)
    while high - low > 0.04:
        mid = (low + high) / 2
        now, k = height(width, text, formulas, mid, leading)
        if now <= tall:
            best, h, n, low = mid, now, k, mid
        else:
            high = mid
    return round(best, 2), h, n, round(h / max(tall, 1.0), 3)


def test_widths():
    assert fit.widths("中a-b 、x__FORMULA_1__$\\alpha x$", {"__FORMULA_1__": r"\frac{a}{b}"}) == ([1.0, 3 * 0.55, 0.32, 0.62, 0.8, 0.65 + 2 * 0.24, 0.65 + 0.24], [False] * 5 + [True] * 2)
    assert fit.widths("$ 5 and 6$", {})[1].count(True) == 0 and fit.widths(None, {}) == ([], [])
    assert fit.formula_width("x" * 99) == 4.8


def test_fit_as_one_at_a_time():
    rng = random.Random(8)
    words = ["中文", "word", "a", " ", "，", "$x+y$", "__FORMULA_2__", "averyveryverylongwordthatneedstobebroken" * 3, "\n", "é"]
    texts = ["".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 60, 200]))) for _ in range(300)]
    forms = [rng.choice([{}, {"__FORMULA_2__": "E=mc^2"}]) for _ in texts]
    box = [(rng.choice([0.0, 30.0, 200.0, rng.uniform(5, 400)]), rng.choice([0.0, 20.0, rng.uniform(10, 500)]), rng.choice([0.0, 0.3, 0.55]), rng.choice([0.0, 8.0, 9.5]), rng.choice([7.0, 12.0, 14.0])) for _ in texts]
    w, h, lead, least, most = map(np.array, zip(*box, strict=True))
    got = fit.Texts.of(texts, forms).solve(w, h, lead, least, most)
    for i, (t, f, b) in enumerate(zip(texts, forms, box, strict=True)):
        assert (got["font_size"][i], got["height"][i], got["n_lines"][i], got["overflow"][i]) == solve(b[0], b[1], t, f, *b[2:]), (t, f, b)


def test_fit_of_columns(spark):
    ship(spark)
    rows = [("中" * 50, {}, 100.0, 60.0), ("formula $x$", {"a": "b"}, 100.0, 60.0), (None, None, None, None), ("", {}, 100.0, 60.0)]
    df = spark.createDataFrame(rows, "t string, f map<string,string>, w double, h double")
    got = [r.r for r in df.select(fit.fitted(F.col("t"), F.col("f"), F.col("w"), F.col("h"), F.lit(0.3), F.lit(8), F.lit(14)).alias("r")).collect()]
    assert (got[0].font_size, got[0].height, got[0].n_lines, got[0].overflow) == solve(100.0, 60.0, "中" * 50, {}, 0.3, 8, 14)
    assert (got[1].formula_ratio, got[1].confidence, got[1].max_shrink) == (round(0.89 / (3.85 + 0.32 + 0.89), 3), 0.6, 0.4)
    assert got[2].n_lines == got[3].n_lines == 1 and got[3].formula_ratio == 0.0 and got[3].confidence == 1.0


def test_demand_and_capacity(spark):
    r = spark.range(1).select(
        fit.demand(F.lit("中文 word,a  b-c")).alias("d"), fit.capacity(F.lit(92.0), F.lit(30.0), F.lit(10.0), F.lit(0.3)).alias("c"), fit.capacity(F.lit(92.0), F.lit(130.0), F.lit(10.0), F.lit(0.3), F.lit(2)).alias("v"),
        fit.required_lines(F.lit(92.0), F.lit(10.0), F.lit(20.0)).alias("n"), fit.required_lines(F.lit(1.0), F.lit(10.0), F.lit(0.0)).alias("one"), fit.demand(F.lit(None).cast("string")).alias("none"),
    ).first()
    assert round(r.d, 6) == round(2 + 0.25 + 2.2 + 0.45 + 1 + 0.5 + 1.65, 6) and r.none == 0
    assert round(r.c, 6) == round(2 * 10 * 0.98, 6) and round(r.v, 6) == round(3 * 10 * 0.98, 6) and r.n == 3 and r.one == 1
