"""The folder all executors share, where iterations cut their lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it sets none
    (single-machine tests) a temporary folder of this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="strataflow-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder as a table, its lineage cut there,
    in files of ``rows`` rows at most: a reader or writer holds all rows of a
    file at once where there are fewer than some thousands.

    Not by ``checkpoint()``: what that reads back keeps the partitioning and
    constraints of its plan, and where a loop joins it with itself these double
    each round, so that planning takes minutes after ten of them.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows or 0).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` made and nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            place = jvm.org.apache.hadoop.fs.Path(folder)
            if place.getName().startswith("cut-"):
                place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of steps that are done;
    otherwise they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


ROWS = 1 << 19  # that a task sorts or joins at once


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` dealt out by columns where the session's number of partitions is
    too small for so many rows, so that a task's share doesn't grow with them."""
    parts = -(-rows // ROWS)
    return df.repartition(parts, *by) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
