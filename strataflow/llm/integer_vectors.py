"""Vectors as blocks of whole numbers, shared by the operators on embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidied

NO_KEY = (1 << 63) - 1  # stands for a null key in a block: after all others
PER_BLOCK = 1024
NUMBERS = 1 << 16  # components of a block, unless one vector has more
SCHEMA = "part long, place long, first long, n long, dim long, low long, high long, keys array<long>, labels array<long>, marks array<boolean>, data binary"


def blocks(rows: DataFrame, scale: int, *, key: str, label: str, vector: str, mark: Column | None = None) -> DataFrame:
    """Blocks of at most ``PER_BLOCK`` vectors, their components floor(scale * x).

    A null vector, or one with a null or non-finite component, is left out.
    Each row has a number of its own: ``first`` and those after it.  ``part``
    and ``place`` tell blocks apart; ``marks`` says of each row whether ``mark``
    holds.  Keys and labels are whole numbers; a null key stands as
    ``NO_KEY``, a null label stays null.  Vectors of several lengths in a block
    and components of 2**62 and beyond end with a ValueError.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        place = number = 0
        for batch in batches:
            lists = batch.column(3)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # nulls become NaN
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            good = np.flatnonzero(bad[ends[1:]] == bad[ends[:-1]])
            sizes = np.diff(ends)[good]
            if not len(good):
                continue
            if (sizes != sizes[0]).any():
                raise ValueError("the vectors have several lengths")
            dim = int(sizes[0])
            each = max(1, min(PER_BLOCK, NUMBERS // max(dim, 1)))
            for at in range(0, len(good), each):
                take = good[at : at + each]
                numbers = np.floor(scale * values[ends[take][:, None] + np.arange(dim)])
                if numbers.size and np.abs(numbers).max() >= 1 << 62:
                    raise ValueError("a component is too large")
                numbers = numbers.astype(np.int64)
                low, high = (int(numbers.min()), int(numbers.max())) if numbers.size else (0, 0)
                kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
                own = [batch.column(i).take(pa.array(take)) for i in range(3)]
                row = (part, place, (part << 33) + number, len(take), dim, low, high, *(c.to_pylist() for c in own), numbers.astype(kind).tobytes())
                yield pa.record_batch([pa.array([x], t) for x, t in zip(row, _types())], SCHEMA_NAMES)
                place, number = place + 1, number + len(take)

    marks = F.coalesce(mark if mark is not None else F.lit(False), F.lit(False))
    usable = rows.where(F.col(vector).isNotNull()).select(
        F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("_key"), F.col(label).cast("long").alias("_label"), marks.alias("_mark"), F.col(vector).cast("array<double>").alias("_vector")
    )
    return usable.mapInArrow(tidied(run), SCHEMA)


SCHEMA_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def _types():
    import pyarrow as pa

    return [*[pa.int64()] * 7, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary()]


def numbers_of(data: bytes, n: int, dim: int):
    """A block's components, as an int64 array of ``n`` rows."""
    import numpy as np

    if not n * dim:
        return np.zeros((n, dim), np.int64)
    return np.frombuffer(data, f"<i{len(data) // (n * dim)}").reshape(n, dim).astype(np.int64)


def facts(packed: DataFrame):
    """Of all blocks: ``rows, blocks, parts, marked, dim, low, high`` (one row; null where there is none)."""
    marked = F.size(F.filter("marks", lambda m: m))
    got = packed.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count("*").alias("blocks"),
        (F.max("part") + 1).alias("parts"),
        F.coalesce(F.sum(marked), F.lit(0)).alias("marked"),
        F.min("dim").alias("dim"),
        F.max("dim").alias("longest"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    ).first()
    if got["dim"] != got["longest"]:
        raise ValueError("the vectors have several lengths")
    return got
