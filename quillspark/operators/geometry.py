"""Rectangles as four columns x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap(a: str, b: str) -> Column:
    """The area that rectangles a.* and b.* share."""
    w = F.least(F.col(f"{a}.x1"), F.col(f"{b}.x1")) - F.greatest(F.col(f"{a}.x0"), F.col(f"{b}.x0"))
    h = F.least(F.col(f"{a}.y1"), F.col(f"{b}.y1")) - F.greatest(F.col(f"{a}.y0"), F.col(f"{b}.y0"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], band: float) -> DataFrame:
    """Pairs of one group whose rectangles overlap, l and r, with area. Rows meet in bands of y that both touch, each pair in the first such band only."""
    bands = lambda d: d.withColumn("__band", F.explode(F.sequence(F.floor(F.col("y0") / band), F.floor(F.col("y1") / band))))
    l, r = bands(left).alias("l"), bands(right).alias("r")
    same = F.col("l.__band") == F.col("r.__band")
    for c in by:
        same = same & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    first = F.col("l.__band") == F.floor(F.greatest(F.col("l.y0"), F.col("r.y0")) / band)
    return l.join(r, same & first).withColumn("area", overlap("l", "r")).where("area > 0")


def subtract(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rectangle a without rectangle b: up to four pieces with a positive area, piece_no and x0, y0, x1, y1."""
    f = lambda s, c: F.col(f"{s}.{c}")
    top, bottom = F.greatest(f(a, "y0"), f(b, "y0")), F.least(f(a, "y1"), f(b, "y1"))
    left, right = F.greatest(f(a, "x0"), f(b, "x0")), F.least(f(a, "x1"), f(b, "x1"))
    meets = (left < right) & (top < bottom)
    piece = lambda n, x0, y0, x1, y1: F.struct(F.lit(n).alias("piece_no"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    whole = piece(0, f(a, "x0"), f(a, "y0"), f(a, "x1"), f(a, "y1"))
    four = F.array(
        piece(1, f(a, "x0"), f(a, "y0"), f(a, "x1"), top), piece(2, f(a, "x0"), bottom, f(a, "x1"), f(a, "y1")),
        piece(3, f(a, "x0"), top, left, bottom), piece(4, right, top, f(a, "x1"), bottom),
    )
    kept = F.filter(F.when(meets, four).otherwise(F.array(whole)), lambda p: (p["x1"] > p["x0"]) & (p["y1"] > p["y0"]))
    return df.withColumn("__piece", F.explode(kept))
