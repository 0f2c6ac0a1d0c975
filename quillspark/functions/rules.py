"""Ordered rules, the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text

Rules = list[tuple[str, Column]]


def first_match(rules: Rules, otherwise: str | None = None) -> Column:
    """The name of the first rule that holds."""
    out = F
    for name, holds in rules:
        out = out.when(holds, name)
    return out.otherwise(F.lit(otherwise).cast("string")) if rules else F.lit(otherwise).cast("string")


# Labels and kinds of blocks that no model is asked about.
SKIP_LABELS, NOT_TEXT, ASIDE = ("code", "keep_origin", "no_trans", "skip_model_keep_origin"), ("display_formula", "formula", "image", "table", "chart"), "non_flow"
SHORT = 4


def keep_origin_rules(source: Column, normal: Column, compact: Column, is_caption: Column | None = None, skip: Column | None = None, labels: Column | None = None, raw_type: Column | None = None, zone: Column | None = None) -> Rules:
    """Why a block is kept as it is. normal: its text with white space collapsed; compact: that without placeholders; skip: false where its policy says translate.

    Lengths and single characters are tested before patterns: most text is long prose, which no rule fits.
    """
    holds = lambda c: F.coalesce(c, F.lit(False)) if c is not None else F.lit(False)
    low = lambda c: F.lower(F.trim(c)) if c is not None else None
    short = (F.length(compact) <= SHORT) & F.regexp_replace(compact, " ", "").rlike(r"^[\p{L}\p{N}]+$")
    metadata = (~F.contains(normal, F.lit(" ")) & text.is_url(source)) | text.is_email(source) | text.note_of_rights(normal)
    return [
        ("empty_source_text", normal == ""),
        ("placeholder_only", compact == ""),
        ("policy_skip", holds(skip)),
        ("skip_model_keep_origin", holds(F.arrays_overlap(F.transform(labels, lambda x: F.trim(x)), F.array(*map(F.lit, SKIP_LABELS))) if labels is not None else None)),
        ("non_textual_raw_block", holds(low(raw_type).isin(*NOT_TEXT) if raw_type is not None else None)),
        ("hard_metadata_fragment", metadata),
        ("protocol_hex_dump", text.hex_dump(normal)),
        ("short_non_body_label", short & holds(is_caption)),
        ("short_non_body_label", short & holds((low(zone) == ASIDE) & (F.coalesce(skip, F.lit(True)) if skip is not None else F.lit(True)) if zone is not None else None)),
    ]


def policy_verdict(source: Column, **more: Column) -> tuple[Column, Column]:
    """action (keep_origin or translate) and reason."""
    reason = first_match(keep_origin_rules(source, text.normalized(source), text.normalized(text.without_placeholders(source)), **more))
    return F.when(reason.isNotNull(), "keep_origin").otherwise("translate"), reason


def with_verdict(df: DataFrame, source: str, **more: Column) -> DataFrame:
    """The rows with action and reason. What the rules share is projected once; only texts with odd spaces or a placeholder meet a pattern there."""
    of = F.col(source)
    normal = df.withColumn("__normal", F.when(text.has_any(of, text.ODD_SPACES), text.normalized(of)).otherwise(F.trim(text.empty_for_null(of))))
    compact = normal.withColumn("__compact", F.when(text.has_any(F.col("__normal"), text.PLACEHOLDER_SIGNS), text.normalized(text.without_placeholders(of))).otherwise(F.col("__normal")))
    named = compact.withColumn("reason", first_match(keep_origin_rules(of, F.col("__normal"), F.col("__compact"), **more)))
    return named.withColumn("action", F.when(F.col("reason").isNotNull(), "keep_origin").otherwise("translate")).drop("__normal", "__compact")


# A failed job's category, whether it may be retried, and what its error or log says; the first that fits holds.
FAILURES = (
    ("dns_resolution_failed", True, ("Failed to resolve", "NameResolutionError", "Temporary failure in name resolution", "socket.gaierror")),
    ("upstream_timeout", True, ("ReadTimeout", "ConnectTimeout", "timed out")),
    ("placeholder_unstable", True, ("PlaceholderInventoryError", "UnexpectedPlaceholderError", "placeholder inventory mismatch", "unexpected placeholders in translation", "placeholder instability")),
    ("source_pdf_missing", False, ("source pdf not found",)),
    ("auth_failed", False, ("401", "403", "missing or invalid X-API-Key", "Unauthorized")),
    ("rate_limited", True, ("429", "rate limit", "Too Many Requests")),
    ("typst_dependency_download_failed", True, ("packages.typst.org", "failed to download package", "downloading @preview/")),
)


def failure_category(log: Column) -> Column:
    """A failed job's category, from its error and the end of its log."""
    return first_match([(name, text.has_any(text.empty_for_null(log), parts)) for name, _, parts in FAILURES], "unknown")


def failure_retryable(log: Column) -> Column:
    return ~failure_category(log).isin(*[name for name, again, _ in FAILURES if not again])


def error_taxonomy(message: Column, status: Column) -> Column:
    """A failed request's kind, from its HTTP status or else its message."""
    low = F.lower(text.empty_for_null(message))
    has = lambda *p: text.has_any(low, p)
    return first_match(
        [
            ("rate_limit", status == 429),
            ("transport", status >= 500),
            ("rate_limit", has("429", "rate limit", "retry-after")),
            ("transport", has("timeout", "connection", "http", "transport")),
            ("refusal", has("refusal", "refused", "safety")),
            ("validation", has("placeholder", "segment", "validation", "inventory")),
        ],
        "protocol",
    )
