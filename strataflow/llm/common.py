"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by Spark's own reader (any Hadoop path)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session sets none (single-machine tests) a temporary
    folder of this machine is taken instead.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="strataflow-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of DataFrames that nothing
    refers to any more; otherwise they stay until the driver happens to collect
    its garbage."""
    for _ in range(2):  # the first round lets go of plans, the second of the shuffles they held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def tidy() -> None:
    """Gives the free memory of a Python worker back.  Workers stay for later
    tasks, beside the executor's heap."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def tidied(run):
    """``run``, a function of batches, that tidies up after its last one."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped


def kept_rows(batch, keep: list[bool], at_once: int = 512):
    """The rows of an Arrow batch that stay, in small batches."""
    import pyarrow as pa

    for start in range(0, batch.num_rows, at_once):
        yield batch.slice(start, at_once).filter(pa.array(keep[start : start + at_once], pa.bool_()))


def range_edges(df: DataFrame, key: str, buckets: int) -> list[int]:
    """At most ``buckets - 1`` increasing cut points of a whole-number column.

    Percentiles over all rows: the driver gets that many numbers, no rows.
    """
    fractions = [i / buckets for i in range(1, buckets)]
    got = df.agg(F.percentile_approx(key, fractions, 20 * buckets).alias("e")).first()["e"]
    return sorted(set(got or []))


def range_bucket(key: str, edges: list[int]) -> Column:
    """The 0-based range a key falls in; a null key comes before all others."""
    if not edges:
        return F.when(F.col(key).isNull(), -1).otherwise(0)
    cuts = F.array(*[F.lit(e).cast("long") for e in edges])
    return F.when(F.col(key).isNull(), -1).otherwise(F.size(F.filter(cuts, lambda e: e <= F.col(key))))


def column_bytes(batch, name: str | int) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a text column of an Arrow batch, one row at a time."""
    import pyarrow as pa

    column = batch.column(name if isinstance(name, int) else batch.schema.get_field_index(name))
    for value in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield value.as_py()
