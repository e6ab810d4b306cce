"""Streams over several files: what is put out goes to files, whatever the batches."""

import pytest
from pyspark.sql import functions as F

from strataflow.streaming import jobs


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "all")
    rows = spark.range(3000).selectExpr(
        "id as event_id",
        "cast(timestamp_seconds(1700000000 + (id * 7919) % 3000 * 400) as timestamp_ntz) as ts",
        "id % 7 as user_id",
        "concat('t', id % 3) as event_type",
        "cast(id % 11 + 0.25 as double) as value",
        "'' as props",
    )
    rows.repartition(3, "event_id").write.parquet(path)
    return path


def stream(spark, folder, files):
    return spark.readStream.schema(jobs.SCHEMA).option("maxFilesPerTrigger", files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.mark.parametrize("files", [1, 10])
def test_drained_rows_are_in_files(spark, folder, files):
    got = jobs.drain(jobs.spells(stream(spark, folder, files), late="30 days"))
    assert got.inputFiles()
    assert got.agg(F.sum("n")).first()[0] == 3000
    once = jobs.drain(jobs.once(stream(spark, folder, files), late="30 days"), "append")
    assert once.inputFiles() and once.count() == 3000 and once.columns == jobs.events(spark, "/root/testdata/sf0.001").columns


@pytest.mark.parametrize("files", [1, 10])
def test_wetness_is_the_decayed_sum(spark, folder, files):
    """Also of events that come in a later batch than newer ones."""
    rows = jobs.drain(jobs.wetness_index(stream(spark, folder, files)), "update").groupBy("event_type").agg(F.max_by("api", "seen").alias("api"), F.max("seen").alias("seen")).collect()
    events = spark.read.parquet(folder).selectExpr("event_type", "unix_micros(cast(ts as timestamp)) / 8.64e10 as day", "value").collect()
    assert len(rows) == 3
    for r in rows:
        own = [(e["day"], e["value"]) for e in events if e["event_type"] == r["event_type"]]
        last = max(d for d, _ in own)
        assert r["seen"] == len(own) == 1000
        assert r["api"] == pytest.approx(sum(v * 0.87 ** (last - d) for d, v in own), rel=1e-9)


def test_the_state_gets_a_row_a_day(spark, folder):
    days = jobs.daily_sums(spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1))
    n = spark.read.parquet(folder).select("event_type", F.to_date("ts")).distinct().count()
    assert days.count() == n


def test_board_keeps_the_last_row_of_each_key(spark, tmp_path):
    """Three runs of one job, the last with nothing new; one row a key."""
    source, board = tmp_path / "in", str(tmp_path / "board")

    def send(rows):
        spark.createDataFrame(rows, "event_type string, v long").coalesce(1).write.mode("append").parquet(str(source))

    def run():
        stream = spark.readStream.schema("event_type string, v long").parquet(str(source))
        jobs.upsert_board(stream, board).awaitTermination()
        return sorted((r["event_type"], r["v"]) for r in jobs.read_board(spark, board).collect())

    send([("a", 1), ("b", 5), ("a", 3)])
    assert run() == [("a", 3), ("b", 5)]
    send([("a", 2), ("c", 9)])
    assert run() == [("a", 2), ("b", 5), ("c", 9)]
    assert run() == [("a", 2), ("b", 5), ("c", 9)]
