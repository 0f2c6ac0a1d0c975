"""Texts in boxes: how many lines a text takes at a font size, the largest size that fits, and a text's demand against a box's room.

Lines are broken greedily, token by token, so sums must come in that order. A batch's texts are broken side by side: step k adds the k-th token of
every text that has one, and a bisection narrows all texts' sizes at once.

Null texts count as empty; they take one line. A box with a null side counts as one without width and height.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Widths in em, limits and precision.
FORMULA = re.compile(r"__FORMULA_\d+__|⟦FORMULA_\d+⟧|<FORMULA_\d+>")
DOLLARS = re.compile(r"\$(?!\s)(?:\\.|[^$\n]){1,240}?\$")
WORD = re.compile(r"[A-Za-z0-9]+(?:[-_./][A-Za-z0-9]+)*")
CJK, MARK, HIDDEN = re.compile(r"[㐀-䶿一-鿿豈-﫿]"), re.compile(r"[，。！？；：、,.!?;:()\[\]{}<>《》“”‘’\"']"), re.compile(r"\\[A-Za-z]+|[\s{}]")
TOKEN = re.compile(rf"({FORMULA.pattern})|({DOLLARS.pattern})|({WORD.pattern})|([\s\S])")
CJK_EM, LETTER_EM, MARK_EM, SPACE_EM, WORD_EM, FORMULA_EM, FORMULA_LETTER_EM, FORMULA_MOST_EM = 1.0, 0.55, 0.62, 0.32, 0.8, 0.65, 0.24, 4.8
FORMULA_HEIGHT, WIDTH_SAFE, LINE_LEAST, SIZE_LEAST, PRECISION, TOKEN_LEAST = 1.04, 0.98, 1.02, 7.8, 0.04, 0.01
CONFIDENCE = ((0.15, 1.0, 0.6), (0.35, 0.6, 0.4), (float("inf"), 0.25, 0.2))
BOX_LEAST, EM_WIDE, CHARS_LEAST, BOX_SAFE = 8.0, 0.92, 4.0, 0.98

RESULT = T.StructType([T.StructField(n, k) for n, k in (("font_size", T.DoubleType()), ("height", T.DoubleType()), ("n_lines", T.IntegerType()), ("overflow", T.DoubleType()), ("formula_ratio", T.DoubleType()), ("confidence", T.DoubleType()), ("max_shrink", T.DoubleType()))])


def formula_width(x: str) -> float:
    return min(FORMULA_MOST_EM, FORMULA_EM + len(HIDDEN.sub("", x)) * FORMULA_LETTER_EM)


def widths(text: str | None, formulas: dict[str, str]) -> tuple[list[float], list[bool]]:
    """The tokens' widths in em, and which are formulas. formulas: what placeholders stand for."""
    out, is_formula = [], []
    for placeholder, dollars, word, c in TOKEN.findall(text or ""):
        is_formula.append(bool(placeholder or dollars))
        if placeholder:
            out.append(formula_width(formulas.get(placeholder, placeholder)))
        elif dollars:
            out.append(formula_width(dollars.strip("$")))
        elif word:
            out.append(max(WORD_EM, len(word) * LETTER_EM))
        else:
            out.append(SPACE_EM if c.isspace() else CJK_EM if CJK.match(c) else MARK_EM if MARK.match(c) else LETTER_EM)
    return out, is_formula


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """To the decimal nearest to the exact value, which numpy's own rounding can miss."""
    return np.array([round(v, digits) for v in x.tolist()], float)


@dataclass
class Texts:
    """Tokens of many texts, the longest text first: step k of all texts that have one lies together."""

    order: np.ndarray
    steps: list[np.ndarray]
    formula: list[np.ndarray]
    ratio: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None], formulas: list[dict[str, str]]) -> Texts:
        tokens = [widths(x, f) for x, f in zip(texts, formulas, strict=True)]
        n = np.array([len(w) for w, _ in tokens], np.int64)
        order = np.argsort(-n, kind="stable")
        flat, flags, start = np.concatenate([np.empty(0), *[w for w, _ in tokens]]), np.concatenate([np.empty(0, bool), *[f for _, f in tokens]]).astype(bool), np.r_[0, np.cumsum(n)][:-1]
        steps, formula = [], []
        for k in range(int(n.max(initial=0))):
            at = start[order[: int(np.searchsorted(-n[order], -k, "left"))]] + k
            steps.append(np.maximum(TOKEN_LEAST, flat[at]))
            formula.append(flags[at])
        total = np.array([sum(w) for w, _ in tokens], float)
        part = np.array([sum(x for x, f in zip(w, fs, strict=True) if f) for w, fs in tokens], float)
        return cls(order, steps, formula, np.divide(part, total, out=np.zeros(len(tokens)), where=total > 0))

    def lines(self, width: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lines, and lines with a formula, of each text in a box of that width at that size."""
        flat = (width <= 0) | (size <= 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            room = np.maximum(1.0, width * WIDTH_SAFE / size)[self.order]
        lines, with_formula, used, has = np.ones(len(room), np.int64), np.zeros(len(room), np.int64), np.zeros(len(room)), np.zeros(len(room), bool)
        for w, f in zip(self.steps, self.formula, strict=True):
            m = len(w)
            r, u, h = room[:m], used[:m], has[:m]
            new = (u > 0) & (u + w > r)
            with_formula[:m] += new & h
            u, h = np.where(new, 0.0, u), h & ~new
            wide = w > r
            lines[:m] += new + np.where(wide, np.maximum(1, np.ceil(w / r)) - 1, 0).astype(np.int64)
            used[:m], has[:m] = np.where(wide, np.mod(w, r), u + w), h | f
        with_formula += has
        out, formula = np.empty_like(lines), np.empty_like(lines)
        out[self.order], formula[self.order] = lines, with_formula
        return np.where(flat, 1, out), np.where(flat, 0, formula)

    def height(self, width: np.ndarray, size: np.ndarray, leading: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lines, formula = self.lines(width, size)
        step = np.maximum(size * LINE_LEAST, size * (1.0 + leading))
        return rounded(lines * step + formula * size * max(0.0, FORMULA_HEIGHT - 1.0), 2), lines

    def solve(self, width: np.ndarray, height: np.ndarray, leading: np.ndarray, least: np.ndarray, most: np.ndarray) -> dict[str, np.ndarray]:
        """The largest size, within PRECISION, at which each text fits its box; the least where none does."""
        low = np.maximum(SIZE_LEAST, least)
        high = np.maximum(low, most)
        size, (tall, lines) = low.copy(), self.height(width, low, leading)
        while (open_ := high - low > PRECISION).any():
            mid = (low + high) / 2.0
            now, n = self.height(width, mid, leading)
            fits = open_ & (now <= height)
            size, tall, lines = np.where(fits, mid, size), np.where(fits, now, tall), np.where(fits, n, lines)
            low, high = np.where(fits, mid, low), np.where(open_ & ~fits, mid, high)
        rank = np.searchsorted([x for x, _, _ in CONFIDENCE], self.ratio, "left")
        return {
            "font_size": rounded(size, 2), "height": tall, "n_lines": lines.astype(np.int32), "overflow": rounded(tall / np.maximum(height, 1.0), 3), "formula_ratio": rounded(self.ratio, 3),
            "confidence": np.array([c for _, c, _ in CONFIDENCE])[rank], "max_shrink": np.array([c for _, _, c in CONFIDENCE])[rank],
        }


def numbers(x: pa.Array) -> np.ndarray:
    return x.fill_null(0.0).to_numpy(zero_copy_only=False).astype(float)


def fitted(text: Column, formulas: Column, width: Column, height: Column, leading: Column, least: Column, most: Column) -> Column:
    """struct<font_size, height, n_lines, overflow, formula_ratio, confidence, max_shrink>: the largest font size at which a text fits a box.

    formulas: map from placeholders to what they stand for. overflow: the text's height over the box's.
    """
    def run(t: pa.Array, f: pa.Array, *sizes: pa.Array) -> pa.Array:
        texts = Texts.of(t.to_pylist(), [dict(x) if x else {} for x in f.to_pylist()])
        got = texts.solve(*map(numbers, sizes))
        return pa.StructArray.from_arrays([pa.array(got[n]) for n in RESULT.names], names=RESULT.names)

    return F.arrow_udf(run, RESULT)(text, formulas, *[x.cast("double") for x in (width, height, leading, least, most)])


def capacity(width: Column, height: Column, font_size: Column, leading: Column, visual_lines: Column | None = None) -> Column:
    """How many em of text a box has room for; not more lines than one above those that are seen, where that is known and over one."""
    w, h = F.greatest(F.lit(BOX_LEAST), width), F.greatest(F.lit(BOX_LEAST), height)
    lines = F.greatest(F.lit(1), F.floor(h / F.greatest(font_size * LINE_LEAST, font_size * (1.0 + leading))))
    if visual_lines is not None:
        lines = F.when(visual_lines > 1, F.least(lines, visual_lines + 1)).otherwise(lines)
    return lines * F.greatest(F.lit(CHARS_LEAST), w / F.greatest(font_size * EM_WIDE, F.lit(1.0))) * BOX_SAFE


def required_lines(width: Column, font_size: Column, demand: Column) -> Column:
    """Lines that a demand in em needs in a box of that width."""
    chars = F.greatest(F.lit(CHARS_LEAST), F.greatest(F.lit(BOX_LEAST), width) / F.greatest(font_size * EM_WIDE, F.lit(1.0)))
    return F.greatest(F.lit(1), F.ceil(demand / F.greatest(chars * BOX_SAFE, F.lit(1.0))))


def demand(text: Column) -> Column:
    """The em that a text without formulas takes: words by length, CJK characters one, runs of white space a quarter a character, others less."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\s+|[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*|[一-鿿]|.)"), 1)
    size = lambda x: F.when(x.rlike(r"^\s+$"), F.greatest(F.lit(0.2), F.length(x) * 0.25)).when(x.rlike("^[一-鿿]$"), 1.0).when(x.rlike("^[A-Za-z0-9]"), F.greatest(F.lit(1.0), F.length(x) * 0.55)).otherwise(0.45)
    return F.aggregate(tokens, F.lit(0.0), lambda s, x: s + size(x))
