"""A worker's output, line by line, folded into its job's state: stage, artifacts, metrics and the log's tail.

One fold serves batches (`folded`) and streams (`follow`). A stream keeps a job's state until its stage is terminal or nothing has come for IDLE, by event
time; so state grows with the jobs that run, not with those that ever ran. Lines that come for a job after that begin a new state.

Lines are trimmed; null and blank ones change nothing. Lines of one job apply in order of (seq, line) within a batch.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillspark.operators import grouped
from quillspark.package import ship

# Labels of lines, keys of published artifacts, stages and what is said of them.
LABELS = {
    "job root": "job_root", "source pdf": "source_pdf", "layout json": "layout_json", "normalized document json": "normalized_document_json", "normalization report json": "normalization_report_json", "provider raw dir": "provider_raw_dir",
    "provider zip": "provider_zip", "provider summary json": "provider_summary_json", "schema version": "schema_version", "translations dir": "translations_dir", "output pdf": "output_pdf", "summary": "summary", "events jsonl": "events_jsonl",
    "batch_id": "batch_id", "task_id": "task_id", "full_zip_url": "full_zip_url",
}
PUBLISHED = {
    "job_root": "job_root", "source_pdf": "source_pdf", "layout_json": "layout_json", "normalized_document_json": "normalized_document_json", "source_json_used": "normalized_document_json", "normalization_report_json": "normalization_report_json",
    "provider_raw_dir": "provider_raw_dir", "provider_zip": "provider_zip", "provider_bundle_zip": "provider_zip", "provider_summary_json": "provider_summary_json", "provider_result_json": "provider_summary_json", "translations_dir": "translations_dir",
    "output_pdf": "output_pdf", "translated_pdf": "output_pdf", "summary": "summary", "pipeline_summary": "summary", "pipeline_summary_json": "summary", "events_jsonl": "events_jsonl", "pipeline_events_jsonl": "events_jsonl",
}
METRICS = {
    "pages_processed": r"^pages processed:\s*(\d+)$", "translated_items": r"^translated items:\s*(\d+)$", "translate_render_time_seconds": r"^translation time:\s*([0-9.]+)s$",
    "save_time_seconds": r"^(?:render\+save time|save time):\s*([0-9.]+)s$", "total_time_seconds": r"^total time:\s*([0-9.]+)s$",
}
PROVIDER = {
    "waiting-file": ("mineru_upload", "等待文件上传到 MinerU"), "pending": ("mineru_processing", "MinerU 已接收任务，等待排队"), "running": ("mineru_processing", "MinerU 正在解析文件"), "converting": ("mineru_processing", "MinerU 正在转换文件"),
    "done": ("ocr_result_ready", "MinerU 结果已就绪，准备标准化"), "failed": ("failed", "MinerU 处理失败"),
}
UNKNOWN_STATE, UPLOADED, NORMALIZING, QUEUED = "MinerU 状态: {}", ("mineru_processing", "文件上传完成，等待 MinerU 处理"), ("normalizing", "OCR 完成，开始标准化"), ("queued", "任务已创建，等待可用执行槽位")
READING = ("", "translation_prepare", "queued", "ocr_submitting", "ocr_upload", "ocr_processing", "ocr_result_ready", "normalizing")
TERMINAL = ("finished", "canceled", "failed")
TAIL = 40

IDLE = "2 hours"
SNAPSHOT = "job_id string, stage string, stage_detail string, artifacts map<string,string>, metrics map<string,double>, log_tail array<string>, n_lines long"


@dataclass
class Job:
    """What a job's lines have said so far."""

    stage: str = QUEUED[0]
    stage_detail: str = QUEUED[1]
    artifacts: dict[str, str] = field(default_factory=dict)
    metrics: dict[str, float] = field(default_factory=dict)
    log_tail: list[str] = field(default_factory=list)
    n_lines: int = 0

    def apply(self, line: str | None) -> None:
        line = (line or "").strip()
        if not line:
            return
        self.n_lines += 1
        self.log_tail = [*self.log_tail, line][-TAIL:]
        if not self.publish(line):
            for label, name in LABELS.items():
                if value := labelled(line, label):
                    self.artifacts[name] = value
        for name, pattern in METRICS.items():
            if m := re.match(pattern, line):
                try:
                    self.metrics[name] = float(m[1])
                except ValueError:  # as 1.2.3
                    self.metrics.pop(name, None)
        self.move(line)

    def publish(self, line: str) -> bool:
        """A line that is the event of a published artifact."""
        try:
            event = json.loads(line) if line[:1] == "{" else None
        except ValueError:
            return False
        payload = event.get("payload") if isinstance(event, dict) and str(event.get("event_type") or "").strip() == "artifact_published" else None
        key, path = (payload.get(k).strip() if isinstance(payload, dict) and isinstance(payload.get(k), str) else "" for k in ("artifact_key", "path"))
        if not path or key not in PUBLISHED:
            return False
        self.artifacts[PUBLISHED[key]] = path
        return True

    def move(self, line: str) -> None:
        """The stage, as lines about it say. A report moves a job on only while it is still being read."""
        if labelled(line, "normalization report json") and (self.stage in READING or self.stage.startswith("mineru_")):
            self.stage, self.stage_detail = NORMALIZING
        elif line.startswith("upload done: "):
            self.stage, self.stage_detail = UPLOADED
        elif (m := re.match(r"(batch|task) (.*?): state=(.*)$", line)) and m[2].strip() and m[3].strip():
            self.artifacts[f"{m[1]}_id"] = m[2].strip()
            self.stage, self.stage_detail = PROVIDER.get(m[3].strip(), (UPLOADED[0], UNKNOWN_STATE.format(m[3].strip())))

    def row(self, job_id: object) -> dict[str, Any]:
        return {"job_id": job_id, "stage": self.stage, "stage_detail": self.stage_detail, "artifacts": self.artifacts, "metrics": self.metrics, "log_tail": self.log_tail, "n_lines": self.n_lines}


def labelled(line: str, label: str) -> str:
    """The value of `label: value`."""
    return line[len(label) + 1 :].strip() if line.startswith(label + ":") else ""


def folded(lines: DataFrame) -> DataFrame:
    """SNAPSHOT of each job from its lines (job_id, seq, line). Jobs are spread over tasks; a task reads one job's lines in order and keeps its state alone."""

    def each(g: grouped.Group) -> dict:
        job = Job()
        for line in g["line"]:
            job.apply(line)
        row = job.row(g["job_id"][0])
        return {k: [list(v.items()) if isinstance(v, dict) else v] for k, v in row.items()}

    return grouped.map_groups(lines.select(F.col("job_id").cast("string").alias("job_id"), "seq", "line"), ["job_id"], ["seq", "line"], SNAPSHOT, each)


class Follow(StatefulProcessor):
    """Keeps a job's state as JSON and gives its snapshot after each batch that has lines of it."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", T.StructType([T.StructField("json", T.StringType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        job = Job(**json.loads(self.state.get()[0])) if self.state.exists() else Job()
        lines = pd.concat(list(rows)).sort_values(["seq", "line"])
        for line in lines["line"]:
            job.apply(line)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if job.stage in TERMINAL:
            self.state.clear()
        else:
            self.state.update((json.dumps(vars(job)),))
            latest = int(pd.Timestamp(lines["at"].max()).timestamp() * 1000)
            self.handle.registerTimer(max(latest, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        yield pd.DataFrame([job.row(key[0])])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def follow(lines: DataFrame, idle: str = IDLE, late: str = "10 minutes") -> DataFrame:
    """A stream of SNAPSHOT from a stream of lines (job_id, seq, at, line), for update mode. Needs the RocksDB state store."""
    ship(lines.sparkSession)
    n, unit = idle.split()
    idle_ms = int(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.removesuffix("s")]
    keyed = lines.select(F.col("job_id").cast("string").alias("job_id"), "seq", "at", "line").withWatermark("at", late).groupBy("job_id")
    return keyed.transformWithStateInPandas(Follow(idle_ms), SNAPSHOT, "Update", "EventTime")


# When remembered sizes can be relied on.
LEAST_SEEN, FONT_STD, LEADING_STD, BASE, MOST, SLOWNESS = 3, 0.45, 0.12, 0.55, 0.98, 40.0


def typography(observed: DataFrame) -> DataFrame:
    """feature_key, observations and the mean and deviation of font_size and leading, from a batch or a stream (update mode). Values that aren't positive don't count.

    Means and squared deviations are merged, so partial sums of tasks and of earlier batches are one state for each key, and keys are bins.
    """
    good = observed.where("feature_key <> '' and font_size > 0 and leading > 0")
    spread = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std")
    return good.groupBy("feature_key").agg(F.count(F.lit(1)).alias("observations"), F.avg("font_size").alias("font_mean"), F.avg("leading").alias("leading_mean"), spread("font_size"), spread("leading"))


def relied_on(stats: DataFrame) -> DataFrame:
    """feature_key, font_size, leading, observations, confidence: what is known well enough to be used."""
    good = stats.where((F.col("observations") >= LEAST_SEEN) & (F.col("font_size_std") <= FONT_STD) & (F.col("leading_std") <= LEADING_STD))
    sure = F.round(F.least(F.lit(MOST), BASE + F.col("observations") / SLOWNESS), 3)
    return good.select("feature_key", F.round("font_mean", 2).alias("font_size"), F.round("leading_mean", 3).alias("leading"), "observations", sure.alias("confidence"))
