"""Product quantisation of vectors in whole numbers.

Vectors are cut into equal parts; each part position has a codebook of at most
256 entries.  Codebooks are broadcast; tasks compute all squared distances of a
block by the norms and one matrix product in int64 and take the first least
one.  Each round a task sends one sum an entry, a grouped shuffle merges them.
Everything is exact, so results don't depend on order or partitioning.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, tidied
from .integer_vectors import NO_KEY, blocks, facts, numbers_of


BROADCAST_LABELS = 100_000  # two numbers each; more are joined by a shuffle


@dataclass(frozen=True)
class Settings:
    """``scale``: components become floor(scale * x).  The codebooks are
    ``entries`` numbers for each component, whatever the table's size."""

    scale: int = 1024
    parts: int = 4
    entries: int = 256
    rounds: int = 4

    def __post_init__(self):
        if not 1 <= self.entries <= 256 or self.parts < 1 or self.rounds < 0 or self.scale < 1:
            raise ValueError("1 to 256 entries, at least one part, no negative rounds")


def nearest(vectors, books):
    """The first nearest entry of each part of each vector, and its squared
    distance: two int64 arrays of (vectors, parts).

    ``books`` has the shape (parts, entries, components of a part)."""
    import numpy as np

    parts, _, size = books.shape
    which, least = np.empty((len(vectors), parts), np.int64), np.empty((len(vectors), parts), np.int64)
    for p, book in enumerate(books):
        x = np.ascontiguousarray(vectors[:, p * size : (p + 1) * size])
        away = (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)[None]
        which[:, p] = away.argmin(1)
        least[:, p] = np.take_along_axis(away, which[:, p, None], 1)[:, 0]
    return which, least


def _first(packed: DataFrame, s: Settings) -> list:
    """The vectors of the smallest keys (null last; of equal keys by their
    components); every task sends at most as many as are wanted."""

    def run(batches):
        import heapq

        import numpy as np
        import pyarrow as pa

        best: list = []
        for batch in batches:
            for n, dim, keys, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                keys, x = np.array(keys, np.int64), numbers_of(data, n, dim)
                top = np.partition(keys, min(s.entries, n) - 1)[min(s.entries, n) - 1]
                if len(best) == s.entries:
                    top = min(top, best[-1][0])
                best = heapq.nsmallest(s.entries, [*best, *((int(keys[i]), x[i].tolist()) for i in np.flatnonzero(keys <= top))])
        if best:
            yield pa.record_batch([pa.array([k for k, _ in best], pa.int64()), pa.array([v for _, v in best], pa.list_(pa.int64()))], ["key", "vector"])

    found = packed.select("n", "dim", "keys", "data").mapInArrow(tidied(run), "key long, vector array<long>")
    return [r["vector"] for r in found.orderBy("key", "vector").limit(s.entries).collect()]


def _sums(packed: DataFrame, books) -> DataFrame:
    """``part, entry, place, n, total``: of all vectors' parts that have the
    entry as their nearest, their number and the sum of each component."""
    shared = packed.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        books = shared.value
        parts, entries, size = books.shape
        total, count = np.zeros((parts, entries, size), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for n, dim, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                x = numbers_of(data, n, dim)
                which, _ = nearest(x, books)
                for p in range(parts):
                    order = np.argsort(which[:, p], kind="stable")
                    used, starts = np.unique(which[order, p], return_index=True)
                    total[p, used] += np.add.reduceat(x[order, p * size : (p + 1) * size], starts, axis=0)
                    count[p, used] += np.diff(np.append(starts, n))
        p, e = np.nonzero(count)
        if len(p):
            yield pa.record_batch([pa.array(p), pa.array(e), pa.array(count[p, e]), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    sent = packed.select("n", "dim", "data").mapInArrow(tidied(run), "part long, entry long, n long, total array<long>")
    each = sent.select("part", "entry", "n", F.posexplode("total").alias("place", "total"))
    return each.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def train(packed: DataFrame, s: Settings = Settings()):
    """The codebooks of written ``blocks``: an int64 array of (parts, entries, components)."""
    import numpy as np

    got = facts(packed)
    if not got["rows"]:
        return np.zeros((s.parts, 0, 0), np.int64)
    if got["dim"] % s.parts:
        raise ValueError(f"vectors of {got['dim']} components can't be cut into {s.parts} equal parts")
    size = got["dim"] // s.parts
    if max(size, 1) * (2 * max(abs(got["low"]), abs(got["high"])) + 1) ** 2 >= 1 << 61:
        raise ValueError("the components are too large for exact distances in 64 bits")
    start = np.array(first := _first(packed, s), np.int64).reshape(len(first), s.parts, size)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    for _ in range(s.rounds if size else 0):
        books = books.copy()
        for r in _sums(packed, books.copy()).collect():  # entries x components numbers at most
            books[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return books


def encode(packed: DataFrame, books, *, key: str = "vec_id", label: str = "label") -> DataFrame:
    """``key, label, code, error`` of all vectors in the blocks."""
    shared = packed.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for n, dim, keys, labels, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
                which, least = nearest(numbers_of(data, n, dim), shared.value)
                codes = [w.tobytes().hex() for w in which.astype(np.uint8)]
                yield pa.record_batch(
                    [pa.array([None if k == NO_KEY else k for k in keys], pa.int64()), pa.array(labels, pa.int64()), pa.array(codes), pa.array(least.sum(1))], ["key", "label", "code", "error"]
                )

    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField(label, T.LongType()), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return packed.select("n", "dim", "keys", "labels", "data").mapInArrow(tidied(run), schema)


def digest(books) -> str:
    """SHA-256 of all components by part, entry and place, as decimal numbers parted by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, s: Settings = Settings(), *, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> tuple[DataFrame, object]:
    """``key, label, code, error, label_error`` and the codebooks.

    Each codebook starts as its part of the smallest keys' vectors.  Each round
    puts every part with its nearest entry (ties: the lower index) and replaces
    an entry by the floor of the mean of its parts; one without parts stays.
    ``code`` has two hexadecimal digits a part, ``error`` is the squared
    distance over all parts, ``label_error`` its sum over the rows of the label.

    A null vector, or one with a null or non-finite component, gives no row.  A
    null key stays null and comes after all others at the start; equal keys
    follow by their components; repeated rows count each.  Null labels are one
    label.  An empty table gives an empty result and empty codebooks.  With
    fewer vectors than entries there are as many entries as vectors.  Other
    columns are left out, so their names can't clash.  Keys and labels are
    whole numbers.  Vectors of several lengths, or of one that isn't divisible
    by the number of parts, end with a ValueError.
    """
    packed = cut(blocks(vectors, s.scale, key=key, label=label, vector=vector))
    books = train(packed, s)
    coded = cut(encode(packed, books, key="_key", label="_label"))
    totals = cut(coded.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error")))
    few = totals.count() <= BROADCAST_LABELS
    joined = coded.join(F.broadcast(totals) if few else totals, F.col("_label").eqNullSafe(F.col("_of")))
    return joined.select(F.col("_key").alias(key), F.col("_label").alias(label), "code", "error", "label_error"), books
