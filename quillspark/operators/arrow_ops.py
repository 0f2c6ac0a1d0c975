"""What built-in functions can't say: similarity of strings, protected spans, folds in order. Arrow batches, never rows alone."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COPY_RATIO = 0.82
FORMULA = re.compile(r"\$[^$\n]+\$|\\\([^\n]+?\\\)|\\\[[^\n]+?\\\]")


def copy_ratio(a: Column, b: Column) -> Column:
    """How alike two texts are, 0 to 1, by matching blocks."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y, strict=True)])

    return F.when(a == b, F.lit(1.0)).otherwise(ratio(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))


def protect(text: Column) -> Column:
    """text with formulas as tokens <f1-xxx/>, and the map from tokens to formulas. xxx is a checksum of the formula."""

    @F.pandas_udf("text string, tokens map<string, string>")
    def run(x: pd.Series) -> pd.DataFrame:
        import zlib

        rows = []
        for t in x:
            tokens: dict[str, str] = {}

            def put(m: re.Match, tokens: dict[str, str] = tokens) -> str:
                name = f"<f{len(tokens) + 1}-{zlib.crc32(m[0].encode()) % 4096:03x}/>"
                tokens[name] = m[0]
                return name

            rows.append((FORMULA.sub(put, t or ""), tokens))
        return pd.DataFrame(rows, columns=["text", "tokens"])

    return run(text)


def restore(text: Column, tokens: Column) -> Column:
    """The text with its formulas put back."""
    return F.aggregate(F.map_entries(tokens), text, lambda s, e: F.replace(s, e["key"], e["value"]))


#: Statuses and errors that tell of overload.
OVERLOAD, TIMEOUTS = (408, 429, 500, 502, 503, 504), ("ReadTimeout", "ConnectTimeout", "Timeout", "ConnectionError")


def next_limit(state: tuple[int, int, int], least: int, most: int, roomy: bool, success: bool, status: float | None, error: str | None, ms: float) -> tuple[int, int, int]:
    """The limit, and the runs of fast or ordinary and of slow successes, after a request. roomy: a provider of high capacity."""
    limit, good, slow = state
    cut = lambda ratio: max(least, int(limit * ratio))
    if not success:
        if status in OVERLOAD:
            return cut(0.75 if roomy else 0.5), 0, 0
        if error in TIMEOUTS:
            return (limit if roomy else cut(0.5)), 0, 0
        return state
    if not roomy and ms >= 60_000:
        return cut(0.5 if ms >= 90_000 else 0.75), 0, 0
    if not roomy and ms >= 45_000:
        return (cut(0.85), 0, 0) if slow else (limit, 0, 1)
    if ms <= 15_000 and good >= 11 and limit < most:
        return limit + 1, 0, 0
    return limit, good + 1, 0


def adaptive_limits(requests: DataFrame, by: str, order: str, workers: int = 32, roomy: bool = False) -> DataFrame:
    """by, order and limit: how many requests may run at once after each request of a run, from `workers` on and 8 (or workers) at least.

    Needs by, order, success, status_code, error_class and elapsed_ms. The fold needs a run's rows in order; runs are independent.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, state, least = None, (workers, 0, 0), max(1, min(8, workers))
        for pdf in batches:
            out = []
            for key, success, status, error, ms in zip(pdf[by], pdf["success"], pdf["status_code"], pdf["error_class"], pdf["elapsed_ms"], strict=True):
                if key != run:
                    run, state = key, (workers, 0, 0)
                state = next_limit(state, least, workers, roomy, success, status, error, ms)
                out.append(state[0])
            yield pd.DataFrame({by: pdf[by], order: pdf[order], "limit": out})

    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    dealt = requests.select(by, order, "success", "status_code", "error_class", "elapsed_ms").repartition(by).sortWithinPartitions(by, order)
    return dealt.mapInPandas(fold, f"{by} {kinds[by]}, {order} {kinds[order]}, limit int")
