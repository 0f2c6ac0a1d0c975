"""Deduplication, joins with fallbacks, upserts, pages of results, and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import ranked

Names = list[str]


def representatives(df: DataFrame, signature: Names, order: Names, key: str) -> DataFrame:
    """rep: the key of the first row with the same signature. Aggregated and joined, so a frequent signature isn't sorted in one task."""
    first = df.groupBy(*[F.col(c).alias(f"__{c}") for c in signature]).agg(F.min_by(key, F.struct(*order)).alias("rep"))
    return df.join(first, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in signature]).select(*df.columns, "rep")


def fan_out(members: DataFrame, results: DataFrame, key: str, value: str) -> DataFrame:
    """Each member with its representative's result; where that is null, kept_origin."""
    r = results.select(F.col(key).alias("rep"), F.col(value).alias("__v"))
    return members.join(r, "rep", "left").withColumn(value, F.col("__v")).withColumn("final_status", F.when(F.col("__v").isNull(), "kept_origin").otherwise("translated")).drop("__v")


def last_write_wins(df: DataFrame, key: Names, order: Names, keep: Names) -> DataFrame:
    """Of each key the last row, at the place of the first."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("__v"), F.min(F.struct(*order)).alias("__p")).select(*key, "__v.*", F.col("__p").getField(order[-1]).alias("first_pos"))


def first_write_wins(df: DataFrame, key: Names, order: Names, keep: Names) -> DataFrame:
    return df.groupBy(*key).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("__v")).select(*key, "__v.*")


def upsert(table: DataFrame, updates: DataFrame, key: Names, version: str) -> DataFrame:
    """The table with updates applied: of each key the newest version, of equal ones the update."""
    cols = [c for c in table.columns if c not in key]
    both = table.withColumn("__side", F.lit(0)).unionByName(updates.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    return both.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct(version, "__side")).alias("__v")).select(*key, "__v.*")


def replace_all(table: DataFrame, updates: DataFrame, key: Names) -> DataFrame:
    """The table with all rows of the updates' keys replaced by the updates."""
    return table.join(updates.select(*key).distinct(), key, "left_anti").unionByName(updates)


def page(df: DataFrame, order: list, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of results. The limit is clamped to 1..500."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(limit, 1), 500))


def difference(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """missing_result and unexpected_result rows."""
    a, b = expected.select(key).distinct(), actual.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("issue", F.lit("missing_result")).unionByName(b.join(a, key, "left_anti").withColumn("issue", F.lit("unexpected_result")))


def split_by_cache(df: DataFrame, cache: DataFrame, key: Column) -> DataFrame:
    """cached: whether the content's key is in the cache."""
    known = cache.select("cache_key").distinct().withColumn("cached", F.lit(True))
    return df.withColumn("cache_key", key).join(known, "cache_key", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def key_fallback(left: DataFrame, right: DataFrame, key: str, fallback: Column, value: str) -> DataFrame:
    """value by the exact key, else by the fallback key."""
    exact, loose = right.select(F.col(key).alias("__k"), F.col(value).alias("__e")), right.select(F.col(key).alias("__f"), F.col(value).alias("__l"))
    met = left.join(exact, F.col(key) == F.col("__k"), "left").join(loose, fallback == F.col("__f"), "left")
    return met.withColumn(value, F.coalesce("__e", "__l")).withColumn("matched_by", F.when(F.col("__e").isNotNull(), "exact").when(F.col("__l").isNotNull(), "fallback")).drop("__k", "__e", "__f", "__l")


def latency_summary(df: DataFrame, by: Names, value: str) -> DataFrame:
    """n, min, p50, p90, p95, max (interpolated, rounded half to even) and mean. Groups may be of any size."""
    whole = lambda c: F.bround(c).cast("long")
    q = ranked.quantiles(df, by, value, {"p50": 0.5, "p90": 0.9, "p95": 0.95})
    return q.select(*by, "n", whole("least").alias("min_ms"), *[whole(p).alias(f"{p}_ms") for p in ("p50", "p90", "p95")], whole("most").alias("max_ms"), F.round("mean", 2).alias("mean_ms"))


def slow_items(df: DataFrame, value: str, key: str, floor: float, limit: int = 20) -> DataFrame:
    """Rows above both the floor and the mean plus two population deviations, slowest first."""
    bound = df.agg(F.greatest(F.lit(floor), F.avg(value) + 2 * F.stddev_pop(value)).alias("bound"))
    return df.crossJoin(F.broadcast(bound)).where(F.col(value) > F.col("bound")).orderBy(F.desc(value), key).limit(limit)


def gated_stats(df: DataFrame, by: Names, value: str, least: int, most_std: float) -> DataFrame:
    """Mean and sample deviation of groups with enough observations that agree."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")).where((F.col("n") >= least) & (F.col("std") <= most_std))


def floor_quantile(df: DataFrame, by: Names, value: str, q: float, name: str) -> DataFrame:
    """by and the value at floor((n - 1) * q) of the sorted values."""
    return ranked.at_ranks(df, by, value, {name: F.floor((F.col("n") - 1) * F.lit(q))}).select(*by, name)


def null_report(df: DataFrame, columns: Names) -> DataFrame:
    """Of each column, how many values a default would replace; one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(c) for c in columns])
    return counts.select("__n", F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*columns))).alias("field", "n_defaults")).select("field", "n_defaults", F.col("__n").alias("n_rows"))


def largest_gap(df: DataFrame, by: Names, value: str, least_ratio: float, least_each: int) -> DataFrame:
    """Whether a group's values fall into two columns: the widest gap between sorted values, its share of the range, and how many stand on either side."""
    near = ranked.gaps(df, by, value).withColumn("gap", F.col("value") - F.col("was"))
    best = near.groupBy(*by).agg(F.max_by(F.struct(((F.col("value") + F.col("was")) / 2).alias("split_x"), "gap"), F.struct(F.coalesce("gap", F.lit(0.0)), "value")).alias("b"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    sides = df.join(best, by).groupBy(*by).agg(F.first("b.split_x").alias("split_x"), F.first("b.gap").alias("gap"), F.first(F.col("hi") - F.col("lo")).alias("width"), F.count_if(F.col(value) < F.col("b.split_x")).alias("n_left"), F.count_if(F.col(value) >= F.col("b.split_x")).alias("n_right"))
    double = (F.col("gap") >= least_ratio * F.col("width")) & (F.col("n_left") >= least_each) & (F.col("n_right") >= least_each)
    return sides.withColumn("layout", F.when(double, "double").otherwise("single"))
