"""Tables between the rounds of a job, in the folder that all machines share, and numbers in order without one task that sees every row."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master may do without the setting."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="rounds-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written and read again; removed when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str = "n", by: list[str] = ()) -> DataFrame:
    """Rows numbered 1.. in order, in each group if by names any: a range numbers its own rows, and starts after those of the ranges before it.

    Ranges are by (by, order), so a large group lies in many. Rows with equal order and group lie in one range, in any order.
    """
    ranged = written(df.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()), "numbered")
    counts = ranged.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("__range")) - F.col("__c")  # a row for each range of a group
    starts = counts.select(*[F.col(c).alias(f"__of_{c}") for c in by], F.col("__range").alias("__at"), before.alias("__before"))
    own = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order))
    met = ranged.withColumn(name, own).join(starts, [F.col("__range") == F.col("__at"), *[F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by]])
    return met.withColumn(name, F.col(name) + F.col("__before")).select(*df.columns, name)
