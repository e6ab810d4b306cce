"""Structured Streaming jobs over event files.

Each job is a plan from a streaming DataFrame to another; :func:`drain` runs
one over the files at hand and gives the result as a table, which is how they
are tested and queried.  A live deployment starts the same plan with a trigger.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import shared_dir

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
PARTS = 1 << 16  # sums of a type and day that a task holds


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event files as a stream; ``ts`` becomes an instant, which watermarks need."""
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/[e]vents.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, span: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Sums of each type by window; rows later than ``late`` are dropped."""
    cents = F.sum(F.expr("cast(round(value * 100) as bigint)"))
    return stream.withWatermark("ts", late).groupBy(F.window("ts", span), "event_type").agg(cents.alias("hundredths"), F.count("*").alias("n"))


def sliding(stream: DataFrame, span: str = "24 hours", step: str = "6 hours", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", span, step), "event_type").agg(F.count("*").alias("n"))


def spells(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions: events of a user with less than ``gap`` between them."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def once(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, however often it is sent."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def daily_sums(stream: DataFrame) -> DataFrame:
    """``event_type, day, api, last, seen``: each task's values of a type and
    day, decayed to the day's end, with the last time and the number of rows."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        def done(parts):
            return pd.concat(parts).groupby(["event_type", "day"], dropna=False, as_index=False).agg(api=("api", lambda x: x.sum(skipna=False)), last=("last", "max"), seen=("seen", "sum"))

        kept = None
        for rows in batches:
            at = (rows["ts"] - pd.Timestamp(0)) / pd.Timedelta(days=1)
            day = at // 1
            part = pd.DataFrame({"event_type": rows["event_type"], "day": day, "api": rows["value"] * 0.87 ** (day + 1 - at), "last": at, "seen": 1})
            kept = done([part] if kept is None else [kept, part])
            if len(kept) >= PARTS:
                yield kept
                kept = None
        if kept is not None:
            yield kept

    return stream.select("event_type", "ts", "value").mapInPandas(run, "event_type string, day double, api double, last double, seen long")


def wetness_index(stream: DataFrame) -> DataFrame:
    """``event_type, api, seen``: the decayed sum of values up to the type's last
    event, kept as state and updated with each batch (0.87 a day).

    Tasks hand on sums of a day, so the state function gets a row a day and
    task, however many events there are; late events decay like others.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key, batches: Iterator, state: GroupState):
        import pandas as pd

        api, last, seen = state.get if state.exists else (0.0, 0.0, 0)
        for rows in batches:
            now = float(rows["last"].max())
            now = max(last, now) if seen else now
            api = (api * 0.87 ** (now - last) if seen else 0.0) + float((rows["api"] * 0.87 ** (now - rows["day"] - 1)).sum(skipna=False))
            last, seen = now, seen + int(rows["seen"].sum())
        state.update((float(api), float(last), int(seen)))
        yield pd.DataFrame({"event_type": [key[0]], "api": [api], "seen": [seen]})

    sums = daily_sums(stream)
    return sums.groupBy("event_type").applyInPandasWithState(update, "event_type string, api double, seen long", "api double, last double, seen long", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a plan over all files there are and gives what it put out.

    Executors write each batch as Parquet in the shared checkpoint folder, where
    the job's progress is too; no row goes through the driver.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/drained-{uuid.uuid4().hex}"
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        last[:] = [number]

    job = stream.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}-progress").start()
    job.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":  # each batch is the whole result so far
        return spark.read.schema(stream.schema).parquet(f"{path}/batch={last[0]}")
    return spark.read.option("basePath", path).parquet(path).select(*[F.col(f"`{c}`") for c in stream.columns])


def upsert_board(stream: DataFrame, path: str, key: str = "event_type"):
    """Starts a job that keeps the row of each key that its last batch gave.

    Each batch writes a whole board, ``path/version=N``, from the one before it,
    so a batch that is run again gives the same board; :func:`read_board` reads
    the newest.  The board has a row a key.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch", F.lit(number).cast("long"))
        before = _newest(spark, path, number)
        if before is not None:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{path}/version={before}"))
        names = rows.columns
        # the newest batch, and within one batch the largest row
        best = rows.groupBy(F.col(key).alias("_key")).agg(F.max(F.struct("batch", *[c for c in names if c != "batch"])).alias("_row"))
        best.select(*[F.col(f"_row.{c}").alias(c) for c in names]).write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.outputMode("update").foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", f"{path}-progress").start()


def _newest(spark: SparkSession, path: str, below: int | None = None) -> int | None:
    """The number of the newest complete board (before ``below``)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    numbers = [int(x.getPath().getParent().getName().partition("=")[2]) for x in found]
    return max((n for n in numbers if below is None or n < below), default=None)


def read_board(spark: SparkSession, path: str) -> DataFrame:
    """The newest board that :func:`upsert_board` wrote below ``path``."""
    number = _newest(spark, path)
    if number is None:
        raise ValueError(f"no board below {path}")
    return spark.read.parquet(f"{path}/version={number}")
