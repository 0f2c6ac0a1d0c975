"""Event logs and glossaries as tables, and how they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "job_id string, seq long, ts string, level string, stage string, substage string, event string, event_type string, progress_current long, progress_total long, message string, payload string"
# Names of glossary columns in a header.
ALIASES = {"source": ("source", "src", "term", "原文", "源"), "target": ("target", "dst", "translation", "译文", "目标"), "note": ("note", "comment", "备注")}


def events_of_lines(lines: DataFrame, job_id: str | None = None) -> DataFrame:
    """Events of JSON lines (value). Blank and malformed lines go silently, and other jobs' if a job is named."""
    got = lines.where(F.trim("value") != "").select(F.from_json("value", EVENT, {"mode": "PERMISSIVE"}).alias("e")).where("e.job_id is not null").select("e.*")
    return got.where(F.col("job_id") == job_id) if job_id else got


def read_events(spark: SparkSession, path: str, job_id: str | None = None) -> DataFrame:
    return events_of_lines(spark.read.text(path), job_id)


def combined(stored: DataFrame, logged: DataFrame, children: DataFrame | None = None, parent: Column | None = None) -> DataFrame:
    """Events of all origins, children's under their parent's id, numbered anew by (ts, seq, event) in each job."""
    from quillspark.operators.ordered import resequence

    both = stored.withColumn("origin", F.lit("db")).unionByName(logged.withColumn("origin", F.lit("pipeline")), allowMissingColumns=True)
    if children is not None:
        mirrored = children.withColumn("payload", F.to_json(F.struct(F.col("job_id").alias("source_job_id"), F.col("payload").alias("payload")))).withColumn("job_id", parent if parent is not None else F.regexp_replace("job_id", "-ocr$", ""))
        both = both.unionByName(mirrored.withColumn("origin", F.lit("child")), allowMissingColumns=True)
    return resequence(both.withColumnRenamed("seq", "source_seq"), ["job_id"], ["ts", "source_seq", "event", "origin"])


def append_events(stored: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """New events numbered on from each job's last."""
    from quillspark.operators.ordered import resequence

    last = stored.groupBy("job_id").agg(F.max("seq").alias("__last"))
    numbered = resequence(new.drop("seq"), ["job_id"], [order], "__n").join(last, "job_id", "left")
    return numbered.withColumn("seq", F.coalesce("__last", F.lit(0)) + F.col("__n")).drop("__n", "__last")


def write_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """pos, source, target, note of a CSV. A first row with known names is a header; without one the columns are source, target, note."""
    raw = spark.read.option("header", False).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    n = len(raw.columns)
    first = [str(x or "").strip().lstrip("﻿").lower() for x in (raw.first() or [])]
    at = {name: next((i for i, x in enumerate(first) if x in names), None) for name, names in ALIASES.items()}
    header = at["source"] is not None and at["target"] is not None
    place = at if header else {"source": 0, "target": 1 if n > 1 else None, "note": 2 if n > 2 else None}
    column = lambda name: F.trim(F.coalesce(F.col(raw.columns[place[name]]), F.lit(""))) if place[name] is not None else F.lit("")
    rows = raw.withColumn("__row", F.monotonically_increasing_id())
    if header:
        rows = rows.where(F.lower(F.trim(F.regexp_replace(raw.columns[place["source"]], "^﻿", ""))) != first[place["source"]])
    return rows.select(F.col("__row").alias("pos"), *[column(c).alias(c) for c in ("source", "target", "note")]).where("source != ''")


def glossary_csv(df: DataFrame) -> DataFrame:
    """line: entries as CSV lines with quotes where they are needed."""
    return df.select("pos", F.to_csv(F.struct("source", "target", "note"), {"quoteAll": "false"}).alias("line"))
