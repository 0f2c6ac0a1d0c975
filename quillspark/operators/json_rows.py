"""JSON columns: decoded strictly, with a row's error beside it, or leniently, with a default; and secrets taken out at any depth."""

from __future__ import annotations

import json
from json.encoder import encode_basestring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.package import ship

# Keys whose value is never shown, and what stands for a secret.
SENSITIVE, REDACTED = ("api_key", "mineru_token", "paddle_token"), "[REDACTED]"


def is_json(raw: Column) -> Column:
    """Whether a text is one JSON value and nothing else. The parser stops after a value, so the text is read inside brackets and inside braces: no
    text can end both early."""
    one = F.size(F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))).cast("array<variant>")) == 1
    last = F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"a":'), raw, F.lit(',"z":0}'))), "$.z", "int") == 0
    return F.coalesce(one & last, F.lit(False))


def strict(raw: Column, schema: str, name: str, required: tuple[str, ...] = ()) -> Column:
    """struct<value, error>: the fields of the schema, or why the row can't be read. Null is an error, other fields don't matter.

    A value that isn't JSON, has a field of another type, or lacks a required one has no fields at all.
    """
    bad = "__bad"
    parsed = F.from_json(raw, f"{schema}, {bad} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    fields = [f.name for f in T._parse_datatype_string(schema).fields]
    whole = F.try_parse_json(raw)
    missing = [F.when(parsed[c].isNull(), f"missing field `{c}`") for c in required]
    why = F.coalesce(
        F.when(raw.isNull(), "null"), F.when(~is_json(raw), "malformed JSON"), F.when(~F.schema_of_variant(whole).startswith("OBJECT"), "not an object"),
        F.when(parsed[bad].isNotNull(), "a field of another type"), *missing,
    )
    error = F.concat(F.lit(f"failed to decode {name}: "), why)
    return F.struct(F.when(error.isNull(), F.struct(*[parsed[c].alias(c) for c in fields])).alias("value"), error.alias("error"))


def split_rows(df: DataFrame, column: str, schema: str, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows with the column decoded, rows that can't be, with their error and the raw text)."""
    read = df.withColumn("__read", strict(F.col(column), schema, column, required))
    return read.where("__read.error is null").withColumn(column, F.col("__read.value")).drop("__read"), read.where("__read.error is not null").withColumn("error", F.col("__read.error")).drop("__read")


def lenient(raw: Column, schema: str, default: Column, required: tuple[str, ...] = ()) -> Column:
    """The fields of the schema, or the default for a row that can't be read."""
    return F.coalesce(strict(raw, schema, "", required)["value"], default)


class Raw(str):
    """A number as it was written."""


def redacted(text: str | None, secrets: list[str]) -> str | None:
    if text is not None:
        for secret in secrets:
            if secret:
                text = text.replace(secret, REDACTED)
    return text


def redacted_json(raw: str | None, secrets: list[str]) -> str | None:
    """JSON with sensitive keys emptied and secrets replaced in every string value, however deep. Keys keep their order, numbers their digits.

    What isn't JSON is redacted as text.
    """
    if raw is None:
        return None
    try:
        root = json.loads(raw, parse_float=Raw, parse_int=Raw)
    except ValueError:
        return redacted(raw, secrets)
    out: list[str] = []
    todo: list[object] = [root]
    mark = object()  # before a piece of text that is written as it is
    while todo:
        x = todo.pop()
        if x is mark:
            out.append(todo.pop())
        elif isinstance(x, Raw):
            out.append(str(x))
        elif isinstance(x, str):
            out.append(encode_basestring(redacted(x, secrets)))
        elif isinstance(x, dict):
            todo += ["}", mark]
            for i, (k, v) in reversed(list(enumerate(x.items()))):
                todo += ["" if k in SENSITIVE else v, ("," if i else "") + encode_basestring(k) + ":", mark]
            todo += ["{", mark]
        elif isinstance(x, list):
            todo += ["]", mark]
            for i, v in reversed(list(enumerate(x))):
                todo += [v, "," if i else "", mark]
            todo += ["[", mark]
        else:
            out.append(json.dumps(x))
    return "".join(out)


def redact(df: DataFrame, json_col: str, secret_cols: list[str], text_cols: tuple[str, ...] = ()) -> DataFrame:
    """The rows with their secrets (trimmed, of each row its own, empty ones none) taken out of a JSON column and of text columns."""
    ship(df.sparkSession)
    secrets = F.filter(F.array(*[F.trim(F.coalesce(F.col(c), F.lit(""))) for c in secret_cols]), lambda s: s != "")
    run = F.arrow_udf(lambda raw, hide: pa.array([redacted_json(a.as_py(), b.as_py()) for a, b in zip(raw, hide, strict=True)], pa.string()), T.StringType())
    out = df.withColumn("__hide", secrets)
    for c in text_cols:
        out = out.withColumn(c, F.aggregate("__hide", F.col(c), lambda text, s: F.replace(text, s, F.lit(REDACTED))))
    return out.withColumn(json_col, run(F.col(json_col), F.col("__hide"))).drop("__hide")
