"""A stream that replays a table by its time column, and late rows counted."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..sources.rasters import _open

FILES_EACH = 1  # row groups of a partition


class Group(InputPartition):
    """One row group of a file, and the times wanted of it."""

    def __init__(self, file: str, number: int, start: int, end: int):
        self.file, self.number, self.start, self.end = file, number, start, end


class ReplayReader(DataSourceStreamReader):
    """Offsets are times in microseconds: a batch holds the rows from one to the
    next, so a restart goes on exactly where the last batch ended."""

    def __init__(self, schema, options):
        self.schema, self.path, self.time = schema, options["path"], options.get("time", "ts")
        self.step = int(float(options.get("hours", "24")) * 3_600_000_000)
        self.groups = self._groups()
        self.low = min((g[2] for g in self.groups), default=0)
        self.high = max((g[3] for g in self.groups), default=-1)
        self.at = None

    def _groups(self) -> list[tuple[str, int, int, int]]:
        """Of each row group its file, number, and first and last time (from the
        file's own statistics; of a group without them it is the whole range)."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        files, inside = _open(self.path)
        listed = [self.path]
        if files.get_file_info(inside).type != fs.FileType.File:
            head = self.path[: len(self.path) - len(inside)] if self.path.endswith(inside) else "file:"
            listed = sorted(head + x.path for x in files.get_file_info(fs.FileSelector(inside, recursive=True)) if x.path.endswith(".parquet"))
        out = []
        for file in listed:
            files, inside = _open(file)
            meta = pq.read_metadata(inside, filesystem=files)
            column = meta.schema.to_arrow_schema().get_field_index(self.time)
            for k in range(meta.num_row_groups):
                found = meta.row_group(k).column(column).statistics
                if found is None or not found.has_min_max:
                    times = pq.ParquetFile(inside, filesystem=files).read_row_group(k, [self.time]).column(0).cast("timestamp[us]").cast("int64").drop_null()
                    if len(times):
                        out.append((file, k, min(times).as_py(), max(times).as_py()))
                else:
                    out.append((file, k, _micros(found.min), _micros(found.max)))
        return out

    def initialOffset(self) -> dict:
        return {"until": self.low}

    def latestOffset(self) -> dict:
        """One step further at each call, until all rows are out."""
        self.at = self.low if self.at is None else self.at
        self.at = min(self.at + self.step, self.high + 1) if self.at <= self.high else self.at
        return {"until": self.at}

    def partitions(self, start: dict, end: dict) -> list[Group]:
        self.at = max(self.at or self.low, end["until"])  # after a restart
        return [Group(f, k, start["until"], end["until"]) for f, k, low, high in self.groups if low < end["until"] and high >= start["until"]]

    def read(self, group: Group) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        names, instants = self.schema.fieldNames(), {"timestamp": pa.timestamp("us", "UTC"), "timestamp_ntz": pa.timestamp("us")}
        files, inside = _open(group.file)
        rows = pq.ParquetFile(inside, filesystem=files).read_row_group(group.number, sorted({*names, self.time}))
        at = rows.column(self.time).cast(pa.timestamp("us")).cast(pa.int64())
        rows = rows.filter(pc.and_(pc.greater_equal(at, group.start), pc.less(at, group.end)))
        for field in self.schema.fields:
            if kind := instants.get(field.dataType.typeName()):
                at = rows.schema.get_field_index(field.name)
                rows = rows.set_column(at, field.name, rows.column(at).cast(kind))
        yield from rows.select(names).to_batches()

    def commit(self, end: dict) -> None:
        pass


def _micros(value) -> int:
    import pyarrow as pa

    return pa.scalar(value).cast(pa.timestamp("us")).cast(pa.int64()).as_py()


class Replay(DataSource):
    """Options: ``path`` of Parquet files; ``time``, their time column (``ts``);
    ``hours`` of that time a batch (24).  Rows without a time are left out."""

    @classmethod
    def name(cls) -> str:
        return "replay"

    def streamReader(self, schema) -> ReplayReader:
        return ReplayReader(schema, self.options)


class Late(StreamingQueryListener):
    """Counts the rows that a query's stateful operators dropped as too late."""

    def __init__(self):
        self.dropped: dict[str, int] = {}
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        run = str(p.runId)
        self.dropped[run] = self.dropped.get(run, 0) + sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        self.rows[run] = self.rows.get(run, 0) + p.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def register(spark: SparkSession) -> None:
    """Makes ``replay`` known to the session."""
    spark.dataSource.register(Replay)


def offsets(path: str) -> list[int]:
    """The ends of the batches that a checkpoint has on record (local paths)."""
    from pathlib import Path

    found = sorted((int(p.name), p) for p in Path(path, "offsets").iterdir() if p.name.isdigit())
    return [json.loads(p.read_text().splitlines()[-1])["until"] for _, p in found]
