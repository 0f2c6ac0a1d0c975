"""What the operators share: tables, the shared scratch folder, bounded samples, calibration."""

from __future__ import annotations

import ctypes
import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    if "__file__" not in globals() or not root.is_dir():  # already running from a shipped archive
        return
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    to = Path(tempfile.mkdtemp(prefix="ship-")) / "quillspark_package.zip"
    to.write_bytes(body.getvalue())
    spark.sparkContext.addPyFile(str(to))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The columns of a table of the data folder; only Spark reads the path."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, as spark.checkpoint.dir names it.

    Only where all runs on one machine (a local master) a missing setting is made up for by a temporary folder.
    """
    sc = spark.sparkContext
    if not (at := sc.getCheckpointDir()):
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="checkpoints-"))
        at = sc.getCheckpointDir()
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that nothing reads any more."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


#: Spark removes the shuffle files of a query when it ends, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str, **options: str) -> DataFrame:
    conf = df.sparkSession.conf
    was = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").options(**options).parquet(path)
    finally:
        conf.unset(CLEANUP) if was is None else conf.set(CLEANUP, was)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows, written as Parquet in the shared folder and read again: lineage is cut and no executor's disk holds the only copy."""
    return write(df, scratch(df.sparkSession, name), **options)


#: What is broadcast at most, as Spark's own default; more is shuffled.
BROADCAST_BYTES = 10 << 20


def fits_broadcast(rows: int, row_bytes: int) -> bool:
    return rows * row_bytes <= BROADCAST_BYTES


def checked_broadcast(df: DataFrame, rows: int, row_bytes: int = 32) -> DataFrame:
    """To be broadcast if so many rows, as counted, of about so many bytes fit."""
    return F.broadcast(df) if fits_broadcast(rows, row_bytes) else df


def bind(value: Column, body) -> Column:
    """body(value) with value computed once, wherever body uses it, inside lambdas too."""
    return F.transform(F.array(value), body)[0]


def fold(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def chance(*columns: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns' values alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 32)) / float(1 << 32)


def bounded_sample(df: DataFrame, label: str, per_label: int, *key: str, seed: int = 0) -> DataFrame:
    """About per_label rows of each label, picked by a hash of the key columns; of rows with equal keys one stands for all.

    The labels' distinct keys are counted first, so no group is sorted or gathered, and a key with very many rows is one row. How many
    rows of a label are picked differs from per_label by a few square roots of it.
    """
    named = df.where(F.col(label).isNotNull()).withColumn("__key", F.xxhash64(F.lit(seed), *key))
    counts = {r[0]: r[1] for r in named.select(label, "__key").distinct().groupBy(label).count().collect()}
    take = F.lit(False)
    for value, n in sorted(counts.items(), key=str):
        take = take | ((F.col(label) == F.lit(value)) & (chance("__key", seed=seed) < min(1.0, per_label / n)))
    return named.where(take).dropDuplicates([label, "__key"]).drop("__key")


def one_of_each(df: DataFrame, *key: str) -> DataFrame:
    """The rows with __first, true for one row of each group with equal keys. Groups are told by their counts: only those of several rows are
    written and numbered, and no group is gathered in a task."""
    several = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*[F.col(k).alias(f"__of_{k}") for k in key])
    same = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in key]
    n = several.count()
    if not n:
        return df.withColumn("__first", F.lit(True))
    several = checked_broadcast(several, n)
    some = written(df.join(several, same, "left_semi").withColumn("__row", F.monotonically_increasing_id()), "repeated")
    least = some.groupBy(*key).agg(F.min("__row").alias("__least")).select("__least")
    first = some.join(least, some["__row"] == least["__least"], "left").withColumn("__first", F.col("__least").isNotNull()).drop("__row", "__least")
    return df.join(several, same, "left_anti").withColumn("__first", F.lit(True)).unionByName(first)


def give_back() -> None:
    """Return memory that is free to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow; when a task ends, its worker keeps no free memory. An executor can have more workers than cores, and idle ones add up."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights and, last, the bias of a logistic regression; columns of x should be near unit scale."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    # Platt's targets keep the fit finite where the classes are separable.
    t = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (t - p) - ridge * w)
        w += np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-8:
            break
    return w
