"""The event log as a stream: the same rules as in batch, as far as late rows allow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import records
from quillspark.sources import logs

LATE = "10 minutes"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON files as they come."""
    return logs.events_of_lines(spark.readStream.text(path)).withColumn("at", F.try_to_timestamp("ts"))


def progress(events: DataFrame) -> DataFrame:
    """The greatest progress so far of each job and stage. Progress never falls, so late rows can't change it wrongly."""
    return events.groupBy("job_id", "stage").agg(F.max("progress_current").alias("progress_current"), F.max("progress_total").alias("progress_total"), F.count(F.lit(1)).alias("n_events"))


def rates(events: DataFrame, every: str = "5 minutes") -> DataFrame:
    """Events by window, stage and level; rows later than LATE are dropped."""
    return events.withWatermark("at", LATE).groupBy(F.window("at", every), "stage", "level").agg(F.count(F.lit(1)).alias("n"))


def latest_state(events: DataFrame) -> DataFrame:
    """The event with the greatest (ts, seq) of each job."""
    return events.groupBy("job_id").agg(F.max_by(F.struct("stage", "event", "progress_current"), F.struct("ts", "seq")).alias("s")).select("job_id", "s.*")


def upsert_into(spark: SparkSession, path: str, key: list[str], version: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merge each batch into a table of versions. Batch n writes path/v=n, so a batch that is run again gives the same."""

    def merge(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(*key).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in key]), F.struct(version)).alias("v")).select(*key, "v.*")
        made = records.upsert(spark.read.parquet(f"{path}/v={number - 1}"), newest, key, version) if number else newest
        made.write.mode("overwrite").parquet(f"{path}/v={number}")

    return merge
