"""Translations reviewed: a row for each issue, and what the issues add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import splits, term_index

# What stands for a formula or term, what a model says when it has nothing to translate, and kinds of issues with their severity and whether
# another try may help.
PLACEHOLDER = f"({text.PLACEHOLDER})"
PROMPT = (
    r"(?i)^(?:请\s*(?:提供|输入|给出|粘贴|发送)\s*(?:待翻译的?)?\s*(?:原文|文本|内容|source)(?:[。.!！?？\s]*)|"
    r"(?:please\s+)?(?:provide|send|enter|paste)\s+(?:the\s+)?(?:source\s+)?(?:text|content)(?:\s+to\s+translate)?(?:[。.!！?？\s]*))$"
)
PROMPT_LENGTH, SHELL = 48, ('"translated_text"', '"translations"', "“translated_text”", "“translations”")
KEEP_ORIGIN, SHOWN_LEAKS = "keep_origin", 5
KINDS = {
    "missing_result": ("error", True), "unexpected_result": ("error", True), "empty_translation": ("error", True), "math_delimiter_unbalanced": ("error", True), "protocol_shell_output": ("error", True), "context_bleed": ("error", True),
    "unexpected_placeholder": ("error", True), "placeholder_inventory_mismatch": ("error", True), "placeholder_order_changed": ("warning", False), "glossary_term_missing": ("warning", False),
}


def is_protocol_shell(x: Column) -> Column:
    """A request for text in place of a translation, or the JSON around one."""
    t = F.btrim(F.coalesce(x, F.lit("")), F.lit(" \t\r\n"))
    return ((F.length(t) <= PROMPT_LENGTH) & t.rlike(PROMPT)) | (F.startswith(t, F.lit("{")) & text.has_any(t, SHELL))


def placeholders(x: Column) -> Column:
    """The placeholders of a text, in order."""
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(PLACEHOLDER), 1)


def without_repeated_placeholders(source: Column, translated: Column) -> Column:
    """A translation without the placeholders that it repeats, where that is safe; else null.

    It has more placeholders than the source and no others, and those of the source are among them in order: of each the first that comes in its turn stays. Spaces
    that a dropped one leaves double, or before a mark, go.
    """
    t = F.coalesce(translated, F.lit(""))
    row = F.struct(placeholders(source).alias("mine"), placeholders(t).alias("its"), F.split(t, PLACEHOLDER).alias("parts"))

    def kept(v: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            token = F.get(v["its"], i)
            due = F.coalesce(token == F.get(v["mine"], s["k"]), F.lit(False))
            return F.struct((s["k"] + due.cast("int")).alias("k"), F.concat(s["text"], F.when(due, token).otherwise(""), F.get(v["parts"], i + 1)).alias("text"))

        begin = F.struct(F.lit(0).alias("k"), F.get(v["parts"], F.lit(0)).alias("text"))
        walked = F.aggregate(F.sequence(F.lit(0), F.size(v["its"]) - 1), begin, step)
        tidy = lambda s: F.btrim(F.regexp_replace(F.regexp_replace(s["text"], r"[ \t]{2,}", " "), r"\s+([,.;:!?])", "$1"), F.lit(" \t\r\n"))
        whole = text.let(walked, lambda s: F.when(s["k"] == F.size(v["mine"]), tidy(s)))
        more = (F.size(v["mine"]) > 0) & (F.size(v["its"]) > F.size(v["mine"])) & (F.size(F.array_except(v["its"], v["mine"])) == 0)
        return F.when(more, text.let(whole, lambda x: F.when(placeholders(x) == v["mine"], x)))

    return text.let(row, kept)


def issue(when: Column, kind: str, details: Column | None = None) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(kind).alias("kind"), (details if details is not None else F.array()).cast("array<string>").alias("details")))


def of_kinds(rows: DataFrame) -> DataFrame:
    """item_id, kind, details with severity and retryable."""
    pick = lambda i, kind: F.element_at(F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[i])]), F.col("kind")).cast(kind)
    return rows.select("item_id", "kind", pick(0, "string").alias("severity"), pick(1, "boolean").alias("retryable"), "details")


def text_issues(source: Column, translated: Column, direct_math: Column, after: Column) -> Column:
    """array of struct<kind, details>: what is wrong with a translation by itself. An empty one has that issue and those of its placeholders.

    direct_math: formulas are in the text, not behind placeholders. after: the text that follows the source.
    """
    t, mine, its = F.coalesce(translated, F.lit("")), placeholders(source), placeholders(translated)
    empty = F.btrim(t, F.lit(" \t\r\n")) == ""
    open_ = (F.regexp_replace(F.coalesce(source, F.lit("")), r"\s+", "") != "") & ~F.coalesce(source, F.lit("")).rlike(splits.ENDED)
    own = splits.formulas(source)
    leaked = F.filter(splits.formulas(after), lambda x: ~F.array_contains(own, x) & F.contains(t, x))
    extra, same = F.array_sort(F.array_except(its, mine)), F.array_sort(its) == F.array_sort(mine)
    found = F.array(
        issue(empty, "empty_translation"), issue(~empty & direct_math & (text.unescaped_dollars(t) % 2 != 0), "math_delimiter_unbalanced"), issue(~empty & is_protocol_shell(t), "protocol_shell_output"),
        issue(~empty & direct_math & open_ & (F.size(leaked) > 0), "context_bleed", F.slice(leaked, 1, SHOWN_LEAKS)), issue(~direct_math & (F.size(extra) > 0), "unexpected_placeholder", extra),
        issue(~direct_math & ~same, "placeholder_inventory_mismatch", its), issue(~direct_math & same & (its != mine), "placeholder_order_changed", its),
    )
    return F.filter(found, lambda x: x.isNotNull())


def review(items: DataFrame, results: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """item_id, kind, severity, retryable, details: the issues of results (item_id, decision, translated) for items (item_id, source, direct_math, after).

    An item without a result and a result without an item are issues; blank ids take no part. What was kept as it is isn't reviewed. A term of the glossary in the source is looked
    for in the translation: itself if it is to be preserved, else its target. Each id should have one row on either side.
    """
    blank = lambda df: df.where(F.coalesce("item_id", F.lit("")) != "")
    met = blank(items).alias("i").join(blank(results).withColumn("__there", F.lit(True)).alias("r"), F.col("i.item_id") == F.col("r.item_id"), "full")
    name = F.coalesce("i.item_id", "r.item_id").alias("item_id")
    lone = met.select(name, F.when(F.col("r.item_id").isNull(), "missing_result").when(F.col("i.item_id").isNull(), "unexpected_result").alias("kind"), F.array().cast("array<string>").alias("details")).where("kind is not null")
    both = blank(items).join(blank(results), "item_id").where(F.coalesce(F.lower(F.trim("decision")), F.lit("")) != KEEP_ORIGIN).withColumn("direct_math", F.coalesce("direct_math", F.lit(False)))
    own = both.select("item_id", F.explode(text_issues(F.col("source"), F.col("translated"), F.col("direct_math"), F.col("after"))).alias("x")).select("item_id", "x.*")
    out = lone.unionByName(own)
    if glossary is not None:
        terms = term_index.matched_entries(both.select("item_id", F.col("source").alias("__source"), F.lower(F.coalesce("translated", F.lit(""))).alias("__low")), glossary, "__source")
        expected = F.when(F.col("level") == "preserve", F.col("source")).otherwise(F.col("target"))
        out = out.unionByName(terms.where(~F.contains("__low", F.lower(expected))).select("item_id", F.lit("glossary_term_missing").alias("kind"), F.array(expected).alias("details")))
    return of_kinds(out)


def summary(issues: DataFrame) -> DataFrame:
    """kind, severity, n and whether any issue of all is an error; a row for each kind, with n = 0 too."""
    spark = issues.sparkSession
    every = spark.createDataFrame([(k, v[0]) for k, v in KINDS.items()], "kind string, severity string")
    n = every.join(issues.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "kind", "left").na.fill(0, ["n"])
    errors = issues.agg(F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False)).alias("has_errors"))
    return n.crossJoin(F.broadcast(errors))  # one row
