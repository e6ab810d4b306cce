"""Keyed state with timers: assessments that expire, and standing down.

Each place has a live assessment for ``keep`` seconds after its last reading.
A refusal makes the place stand down for ``rest`` seconds, in which readings
are held back.  What happens in between two rows is put out at its own time,
whether a later row or a timer brings it up, so the result doesn't depend on
how the stream is cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "place string, at timestamp, what string, level double"
STATE = "best double, until long, resume long"
KEEP, REST = 900, 600  # fixed values: seconds an assessment lives, and a place stands down
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def moved(best: float | None, until: int, resume: int, now: int):
    """What has run out by ``now`` (milliseconds): the state after it, and what to put out."""
    out = []
    for at, what in sorted([(until, "expired"), (resume, "resumed")]):
        if at and at <= now:
            out.append((at, what, best if what == "expired" else None))
            if what == "expired":
                best, until = None, 0
            else:
                resume = 0
    return best, until, resume, out


def read(best: float | None, until: int, resume: int, now: int, level: float | None, keep: int, rest: int):
    """A row's effect; a null ``level`` is a refusal."""
    best, until, resume, out = moved(best, until, resume, now)
    if level is None:
        if not resume:
            out.append((now, "stands down", None))
        resume = now + rest
    elif resume:
        out.append((now, "held", level))
    else:
        if best is None:
            out.append((now, "opened", level))
        elif level > best:
            out.append((now, "raised", level))
        best, until = level if best is None else max(best, level), now + keep
    return best, until, resume, out


class Desk(StatefulProcessor):
    def __init__(self, keep: int = KEEP, rest: int = REST):
        self.keep, self.rest = 1000 * keep, 1000 * rest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("desk", STATE)

    def _get(self):
        got = self.state.get() if self.state.exists() else None
        return (None, 0, 0) if got is None else (got[0], got[1], got[2])

    def _put(self, best, until, resume) -> None:
        """Keeps the state, with a timer for what ends it; a place without any is forgotten."""
        for at in list(self.handle.listTimers()):
            if at not in (until, resume):
                self.handle.deleteTimer(at)
        for at in {until, resume} - {0}:
            self.handle.registerTimer(at)
        if until or resume:
            self.state.update((best, until, resume))
        else:
            self.state.clear()

    @staticmethod
    def _rows(key, out):
        import pandas as pd

        text = lambda x: pd.Series(x, dtype=object)
        at = pd.Series(pd.to_datetime([x[0] for x in out], unit="ms"))
        return pd.DataFrame({"place": text([key[0]] * len(out)), "at": at, "what": text([x[1] for x in out]), "level": pd.Series([x[2] for x in out], dtype="float64")})

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        state, out = self._get(), []
        # one place's rows of one batch: the trigger bounds them
        batch = pd.concat(list(rows)).sort_values(["at", "level"], na_position="last")
        for at, level in zip((batch["at"] - pd.Timestamp(0)) // pd.Timedelta(milliseconds=1), batch["level"]):
            *state, more = read(*state, int(at), None if pd.isna(level) else float(level), self.keep, self.rest)
            out += more
        self._put(*state)
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        *state, out = moved(*self._get(), expiredTimerInfo.getExpiryTimeInMs())
        self._put(*state)
        if out:
            yield self._rows(key, out)

    def close(self) -> None:
        pass


def prepare(spark: SparkSession) -> None:
    """Keyed state with timers needs this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def assessments(readings: DataFrame, late: str = "1 hour", keep: int = KEEP, rest: int = REST) -> DataFrame:
    """``place, at, what, level`` of a stream ``place, at, level``.

    ``what``: opened, raised (above the best so far), held, expired (with the
    best level), stands down, resumed.  A null level is a refusal.  Rows later
    than ``late`` are dropped; those of one batch are taken in order of time,
    of equal times by level.  Rows of one place that come out of order over
    batches meet the state as it then is.
    """
    return (
        readings.select("place", "at", "level")
        .withWatermark("at", late)
        .groupBy("place")
        .transformWithStateInPandas(statefulProcessor=Desk(keep, rest), outputStructType=OUT, outputMode="append", timeMode="EventTime")
    )
