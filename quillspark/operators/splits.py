"""One text for several boxes: split by token costs, split at the space nearest to a share, and cut where the next item's formulas begin."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import text
from quillspark.package import ship

# Tokens, their costs, and how far a cut may move for a better place.
PLACEHOLDER = r"<[futnvc]\d+-[0-9a-z]{3}/>|\[\[FORMULA_\d+]]"
WORD, CJK = r"[A-Za-z0-9_\-./]+", "[一-鿿]"
MATH = r"(?<!\\)\$(?:\\.|[^$\\\n])+(?<!\\)\$"
TOKEN, MATH_TOKEN = re.compile(rf"{PLACEHOLDER}|\s+|{WORD}|{CJK}|."), re.compile(rf"{PLACEHOLDER}|\s+|{MATH}|{WORD}|{CJK}|.")
SPACE_COST, FORMULA_COST, LETTER_COST, PLAIN_COST, NEAR = 20, 300, 55, 100, 36
LEAST_SHARE, MOST_SHARE, SPLIT_TEXT, SPLIT_PART = 0.18, 0.55, 16, 6
ENDED, LEAD_IN, SENTENCE, LEAST_LEFT = r"[.!?。！？；;:：)\]）】”’\"']\s*$", r"[，,、\s]*(?:在|为|是|等于|对于)\s*$", r"[。！？；]", 8


def cost(token: str) -> int:
    """In hundredths."""
    if token.isspace():
        return SPACE_COST
    if token.startswith("<") or token.startswith("[[FORMULA_"):
        return FORMULA_COST
    return max(PLAIN_COST, len(token) * LETTER_COST) if re.fullmatch(WORD, token) else PLAIN_COST


def units(x: str | None) -> int:
    return sum(map(cost, TOKEN.findall(x or "")))


def shared_out(whole: str | None, members: list[str | None]) -> list[str]:
    """A text in as many parts as members, by their texts' costs. Each cut is the place nearest to its share within NEAR tokens of the first that reaches it.

    The costs before each token are summed once, so every place is one subtraction. Punctuation gives a place no advantage.
    """
    n = len(members)
    if n <= 1:
        return [(whole or "").strip()] * n
    tokens = MATH_TOKEN.findall((whole or "").strip())
    if not tokens:
        return [""] * n
    before = np.r_[0, np.cumsum([cost(x) for x in tokens])]
    weight = np.cumsum([max(PLAIN_COST, units(x)) for x in members])
    out, at = [], 0
    for i in range(n - 1):
        target = before[-1] * weight[i] / weight[-1]
        last = len(tokens) - (n - 1 - i)  # a token at least for each member after this one
        anchor = max(at + 1, min(last, int(np.searchsorted(before[at:], target, "left")) + at + 1))
        low, high = max(at + 1, anchor - NEAR), min(last, anchor + NEAR)
        best = low + int(np.argmin(np.abs(before[low : high + 1] - target))) if low <= high else anchor
        out.append("".join(tokens[at:best]).strip())
        at = best
    return [*out, "".join(tokens[at:]).strip()]


def split_over_members(groups: DataFrame, text_col: str, members_col: str) -> DataFrame:
    """The groups' other columns with member (from 1) and part: the text split over the members' texts (an array, in order)."""
    ship(groups.sparkSession)
    kind = T.ArrayType(T.StringType())
    parts = F.arrow_udf(lambda x, m: pa.array([shared_out(a.as_py(), b.as_py() or []) for a, b in zip(x, m, strict=True)], pa.list_(pa.string())), kind)
    rest = [c for c in groups.columns if c not in (text_col, members_col)]
    return groups.select(*rest, F.posexplode(parts(text_col, members_col)).alias("__i", "part")).select(*rest, (F.col("__i") + 1).alias("member"), "part")


def at_share(whole: Column, mine: Column, other: Column) -> Column:
    """struct<a, b, at>: a text split over two areas at the space nearest to the areas' share; null where no split is safe.

    The other part gets LEAST_SHARE to MOST_SHARE; the space is sought a sixth of the text (8 characters at least) around, the earlier of two; both parts
    have SPLIT_PART characters.
    """

    def cut(t: Column) -> Column:
        n = F.length(t)
        share = F.greatest(F.lit(LEAST_SHARE), F.least(F.lit(MOST_SHARE), other / (mine + other)))
        target = F.floor(n * (F.lit(1.0) - share)).cast("int")
        near = F.greatest(F.lit(8), F.floor(n / 6).cast("int"))
        low, high = F.greatest(F.lit(4), target - near), F.least(n - 4, target + near)
        left, right = F.substring(t, low + 1, F.least(target, high) - low + 1), F.substring(t, F.greatest(target, low) + 1, high - F.greatest(target, low) + 1)
        back, on = F.instr(F.reverse(left), " "), F.instr(right, " ")
        before, after = F.when(back > 0, low + F.length(left) - back), F.when(on > 0, F.greatest(target, low) + on - 1)
        place = F.when(F.coalesce(target - before <= after - target, after.isNull()), before).otherwise(after)
        return F.when((n >= SPLIT_TEXT) & (low < high), place)

    def parts(s: Column) -> Column:
        a, b = F.trim(F.substring(s["t"], F.lit(1), s["at"])), F.trim(F.substring(s["t"], s["at"] + 1, F.length(s["t"])))
        return F.when(s["at"].isNotNull() & (F.length(a) >= SPLIT_PART) & (F.length(b) >= SPLIT_PART), F.struct(a.alias("a"), b.alias("b"), s["at"].alias("at")))

    return text.let(text.let(text.normalized(whole), lambda t: F.struct(t.alias("t"), cut(t).alias("at"))), parts)


def formulas(x: Column) -> Column:
    """The formulas between unescaped dollar signs."""
    return F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(f"({MATH})"), 1), lambda m: F.trim(m))


def without_leak(translated: Column, source: Column, next_source: Column) -> Column:
    """struct<text, trimmed>: a translation cut before the first formula that only the next item's source has, if this item's source ends in mid-sentence.

    Words that lead up to the formula go too; if less than LEAST_LEFT characters stay, the cut is at the sentence's start; if still less, nothing is cut. trimmed: up to
    three formulas that leaked, null where nothing was cut.
    """

    def cut(v: Column) -> Column:
        t, leaked = v["t"], v["leaked"]
        hit = F.array_min(F.transform(leaked, lambda m: F.position(m, t)))
        head = F.substring(t, F.lit(1), hit - 1)
        first = F.rtrim(F.regexp_replace(F.regexp_replace(head, r"\s+$", ""), LEAD_IN, ""))
        sentence = F.regexp_replace(F.regexp_extract(head, rf"^([\s\S]*{SENTENCE})", 1), r"\s+$", "")
        kept = F.when(F.length(first) >= LEAST_LEFT, first).otherwise(sentence)
        good = (F.size(leaked) > 0) & (F.length(kept) >= LEAST_LEFT)
        return F.struct(F.when(good, kept).otherwise(t).alias("text"), F.when(good, F.slice(leaked, 1, 3)).alias("trimmed"))

    own, nothing = F.coalesce(source, F.lit("")), F.array().cast("array<string>")
    open_ = (F.regexp_replace(own, r"\s+", "") != "") & ~own.rlike(ENDED)
    t = F.coalesce(translated, F.lit(""))
    of = text.let(F.struct(formulas(own).alias("mine"), formulas(next_source).alias("its")), lambda m: F.filter(m["its"], lambda x: ~F.array_contains(m["mine"], x) & F.contains(t, x)))
    return text.let(F.struct(t.alias("t"), F.when(open_, of).otherwise(nothing).alias("leaked")), cut)
