"""The replaying source, late rows, and state that expires."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strataflow.streaming import desk, replay

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def session(spark):
    replay.register(spark)
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    desk.prepare(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def stream(spark, path, schema, hours=24, time="ts"):
    return spark.readStream.format("replay").schema(schema).option("time", time).option("hours", hours).load(path)


def run(df, out, progress, mode="append", **trigger):
    return df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", progress).trigger(**(trigger or {"availableNow": True})).start(out)


def played(df, out, progress, batches=None):
    """Runs until all (or so many batches) are out."""
    job = run(df, out, progress, processingTime="0 seconds")
    done = lambda: (p := job.lastProgress) is not None and (p.batchId + 1 >= batches if batches else p.numInputRows == 0 and p.batchId > 0)
    import time

    for _ in range(1200):
        if job.exception() or done():
            break
        time.sleep(0.05)
    job.stop()
    if job.exception():
        raise job.exception()


def test_replay_gives_each_row_once_over_a_restart(session, tmp_path):
    schema = "event_id long, ts timestamp_ntz, value double"
    path, out, progress = f"{SF}/events.parquet", str(tmp_path / "out"), str(tmp_path / "progress")
    played(stream(session, path, schema, 96), out, progress, batches=2)
    first = session.read.parquet(out).count()
    want = session.read.parquet(path).select("event_id", "ts", "value")
    assert 0 < first < want.count()
    played(stream(session, path, schema, 96), out, progress)
    got = session.read.parquet(out)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    ends = replay.offsets(progress)
    assert ends == sorted(ends) and len(set(ends)) > 2


def test_batches_hold_the_hours_between_offsets(session, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=37 * i)) for i in range(200)]
    session.createDataFrame(rows, "i long, ts timestamp_ntz").repartition(3).write.parquet(str(tmp_path / "in"))
    reader = replay.ReplayReader(session.createDataFrame([], "i long, ts timestamp_ntz").schema, {"path": str(tmp_path / "in"), "hours": "12"})
    at, seen = reader.initialOffset(), []
    while (end := reader.latestOffset()) != at:
        got = sorted(i for g in reader.partitions(at, end) for b in reader.read(g) for i in b.column(0).to_pylist())
        low = rows[0][1] + dt.timedelta(hours=12 * len(seen))
        assert got == [i for i, t in rows if low <= t < low + dt.timedelta(hours=12)]
        seen.append(got)
        at = end
    assert sum(seen, []) == list(range(200)) and reader.latestOffset() == at


def test_late_rows_are_counted(session, tmp_path):
    """A row's own time may lie before the time it is sent at."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=i), start + dt.timedelta(hours=i - 4 * (i * 7 % 11))) for i in range(240)]
    session.createDataFrame(rows, "i long, sent timestamp_ntz, ts timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = stream(session, str(tmp_path / "in"), "i long, sent timestamp_ntz, ts timestamp_ntz", 10, "sent").withColumn("ts", F.col("ts").cast("timestamp"))
    late = replay.Late()
    session.streams.addListener(late)
    try:
        played(source.withWatermark("ts", "4 hours").dropDuplicatesWithinWatermark(["i"]).select("i"), str(tmp_path / "out"), str(tmp_path / "progress"))
        want, dropped, tops = [], 0, []
        for k in range(0, 240, 10):  # a batch is ten hours, and rows are late by the watermark that the batch before it had
            batch = rows[k : k + 10]
            limit = max(tops[:-1]) - dt.timedelta(hours=4) if tops[:-1] else None
            kept = [r for r in batch if limit is None or r[2] > limit]
            dropped += len(batch) - len(kept)
            want += [r[0] for r in kept]
            tops.append(max(r[2] for r in batch))
        assert sorted(r["i"] for r in session.read.parquet(str(tmp_path / "out")).collect()) == want and dropped > 5
        import time

        for _ in range(100):  # the listener hears of a batch a moment later
            if sum(late.rows.values()) == 240:
                break
            time.sleep(0.05)
        assert sum(late.dropped.values()) == dropped and sum(late.rows.values()) == 240
    finally:
        session.streams.removeListener(late)


def listed(rows, keep=900, rest=600, until=None):
    """Second by second what each place puts out; ``until``: the last watermark."""
    out = []
    for place in {r[0] for r in rows}:
        best, ends, resume = None, None, None
        own = sorted([(t, (0, v) if v is not None else (1, 0), v) for p, t, v in rows if p == place], key=lambda x: x[:2])
        for t, _, level in [*own, (until, None, "end")]:
            for at, what in sorted((x, w) for x, w in ((ends, "expired"), (resume, "resumed")) if x is not None and x <= t):
                out.append((place, at, what, best if what == "expired" else None))
                if what == "expired":
                    best = ends = None
                else:
                    resume = None
            if level == "end":
                break
            if level is None:
                if resume is None:
                    out.append((place, t, "stands down", None))
                resume = t + rest
            elif resume is not None:
                out.append((place, t, "held", level))
            else:
                if best is None or level > best:
                    out.append((place, t, "opened" if best is None else "raised", level))
                best, ends = level if best is None else max(best, level), t + keep
    return sorted(out, key=str)


@pytest.mark.parametrize("hours", [1, 6])
def test_assessments_expire_and_open_again(session, tmp_path, hours):
    """However the stream is cut, and over a restart, the same comes out."""
    import random

    r = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(r.choice("abc"), r.randrange(0, 20 * 3600), None if r.random() < 0.15 else float(r.randrange(9))) for _ in range(300)]
    rows.append(("z", 20 * 3600, 1.0))  # brings the last watermark
    table = [(p, start + dt.timedelta(seconds=t), v) for p, t, v in rows]
    schema = "place string, at timestamp_ntz, level double"
    session.createDataFrame(table, schema).coalesce(2).write.parquet(str(tmp_path / "in"))
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")

    def plan():
        source = stream(session, str(tmp_path / "in"), schema, hours, "at").withColumn("at", F.col("at").cast("timestamp"))
        return desk.assessments(source, late="30 minutes")

    played(plan(), out, progress, batches=2)
    half = session.read.parquet(out).count()
    played(plan(), out, progress)
    got = sorted(((x["place"], int((x["at"] - start).total_seconds()), x["what"], x["level"]) for x in session.read.parquet(out).collect()), key=str)
    assert half < len(got) and {x[2] for x in got} == {"opened", "raised", "held", "expired", "stands down", "resumed"}
    assert got == listed(rows, until=20 * 3600 - 1800)


def test_a_place_without_anything_live_is_forgotten():
    assert desk.read(None, 0, 0, 1000, 5.0, 900_000, 600_000) == (5.0, 901_000, 0, [(1000, "opened", 5.0)])
    assert desk.moved(5.0, 901_000, 0, 901_000) == (None, 0, 0, [(901_000, "expired", 5.0)])
    assert desk.moved(5.0, 901_000, 500_000, 499_999) == (5.0, 901_000, 500_000, [])
    assert desk.read(5.0, 901_000, 0, 2000, None, 900_000, 600_000)[2:] == (602_000, [(2000, "stands down", None)])


def test_query_against_a_plain_walk(spark):
    from strataflow.plans.catalogue import queries

    got = sorted(((x["place"], x["at"], x["what"], x["level"]) for x in queries()["live_assessments"](spark, SF).collect()), key=str)
    events = spark.read.parquet(f"{SF}/events.parquet").selectExpr("cast(user_id % 40 as string) as p", "unix_millis(cast(ts as timestamp)) as t", "case when event_id % 11 > 0 then value end as v").collect()
    last = max(e["t"] for e in events) - 3_600_000
    want = listed([(e["p"], e["t"], e["v"]) for e in events], 900_000, 600_000, until=last)
    # what lies beyond the last watermark hasn't run out yet
    assert got == sorted(((p, t // 1000, what, v) for p, t, what, v in want), key=str)
