"""Removal of long passages that an earlier document already has.

Every window of ``window`` consecutive words gets a Rabin-Karp hash: the
polynomial of its words' 64-bit hashes modulo 2**64, rolled over a document
with prefix sums.  Spark deals the hashes out by value; each bucket finds the
hashes that start in several documents and marks those starts that are not in
the document of smallest key.  The marks go back to their documents, where
overlapping windows merge into maximal removal intervals.

The bucket comes from a second hash of the window, so windows count as equal
only if 64 bits of the one and the bucket of the other agree: at 100 TB, with
some 2**23 buckets, that is 87 bits.

A whole bucket is bounded: the number of buckets grows with the bytes of text,
and before the shuffle each task keeps only one start of a hash among its
documents (of the smallest key) for counting, and sends the others on as marks,
so a passage that many documents share doesn't pile up in its bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, cut, release

BASE = 0x9E3779B97F4A7C15 | 1
BUCKET_BYTES = 16 << 20  # of text; about 2.5 million windows
BLOCK = 1 << 20  # windows a task deals out at a time


class _Powers:
    """BASE**i and BASE**-i modulo 2**64, grown when a longer text comes."""

    def __init__(self):
        self.n = 0

    def upto(self, n: int):
        import numpy as np

        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 14)
            inverse = pow(BASE, -1, 1 << 64)
            out = []
            for b in (BASE, inverse):
                x = np.full(self.n, b, np.uint64)
                x[0] = 1
                out.append(np.cumprod(x, dtype=np.uint64))
            self.up, self.down = out
        return self.up[:n], self.down[:n]


def word_digests(words: list[bytes]):
    import numpy as np
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(h):
    """splitmix64: equal numbers stay equal, and remainders come out even."""
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolled(digests, window: int, powers: _Powers):
    """The Rabin-Karp hash of each window of a sequence of digests, mixed."""
    import numpy as np

    n = len(digests)
    if n < window:
        return np.empty(0, np.uint64)
    up, down = powers.upto(n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(digests * down, dtype=np.uint64)))
    return mixed((sums[window:] - sums[:-window]) * up[: n - window + 1])


def window_hashes(words: list[bytes], window: int, powers: _Powers):
    """The Rabin-Karp hash of each window of a list of words."""
    return rolled(word_digests(words), window, powers)


def _planes(values) -> bytes:
    """Differences of whole numbers, byte by byte: small ones compress to little."""
    import numpy as np

    steps = np.diff(values, prepend=values.dtype.type(0))
    return steps.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _unplanes(data: bytes, kind):
    import numpy as np

    steps = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view(kind).ravel(), dtype=kind)


def _starts(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """Rows of a bucket: starts to count (``marked`` false; with hashes) or
    already known to repeat an earlier document of the same block (true).
    ``keys, sums, counts`` name the documents, ``places`` the words' numbers.
    """

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        powers = _Powers()
        names = ["bucket", "marked", "hashes", "places", "keys", "sums", "counts"]

        def rows(marked, bucket, h, place, doc, keys, sums):
            order = np.argsort(bucket, kind="stable")  # keeps documents and places in order
            edges = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
            for a, b in zip(edges[:-1], edges[1:]):
                own = order[a:b]
                there, counts = np.unique(doc[own], return_counts=True)
                yield (int(bucket[own[0]]), marked, b"" if marked else h[own].tobytes(), _planes(place[own]), _planes(keys[there]), sums[there].tobytes(), _planes(counts.astype(np.uint32)))

        def block(found):
            keys, sums = np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.uint32)
            lens = [len(x[2]) for x in found]
            h, bucket = np.concatenate([x[2] for x in found]), np.concatenate([x[3] for x in found])
            doc = np.repeat(np.arange(len(found), dtype=np.int32), lens)
            place = np.concatenate([np.arange(n, dtype=np.uint32) for n in lens])
            order = np.lexsort((keys[doc], bucket, h))
            first = (np.diff(h[order], prepend=~h[order[:1]]) != 0) | (np.diff(bucket[order], prepend=-1) != 0)
            least = keys[doc[order]][np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))]
            late = np.zeros(len(h), bool)
            late[order] = keys[doc[order]] > least
            del order, first, least
            out = list(rows(False, bucket[~late], h[~late], place[~late], doc[~late], keys, sums))
            if late.any():
                own = (keys[doc[late]] % buckets).astype(np.int32)
                out += rows(True, own, None, place[late], doc[late], keys, sums)
            for at in range(0, len(out), 256):
                yield pa.record_batch([pa.array(c) for c in zip(*out[at : at + 256])], names)

        found, n = [], 0
        for batch in batches:
            for key, text in zip(batch.column(0), column_bytes(batch, "_text")):
                digests = word_digests((text or b"").split())
                h = rolled(digests, window, powers)
                if len(h):
                    found.append((key.as_py(), zlib.crc32(text), h, (rolled(mixed(digests), window, powers) % np.uint64(buckets)).astype(np.int64)))
                    n += len(h)
                if n >= BLOCK:
                    yield from block(found)
                    found, n = [], 0
        if found:
            yield from block(found)

    return docs.mapInArrow(run, "bucket long, marked boolean, hashes binary, places binary, keys binary, sums binary, counts binary")


def _mark(buckets: DataFrame) -> DataFrame:
    """``_key, _sum, starts``: places (4-byte numbers) where a window starts
    that a document of smaller key has too."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        out = {"_key": [], "_sum": [], "starts": []}
        for known in (False, True):
            parts = []
            for marked, hashes, places, keys, sums, counts in zip(*(table.column(c) for c in ("marked", "hashes", "places", "keys", "sums", "counts"))):
                if marked.as_py() == known:
                    counts = _unplanes(counts.as_py(), np.uint32)
                    parts.append((np.frombuffer(hashes.as_py(), np.uint64), _unplanes(places.as_py(), np.uint32), np.repeat(_unplanes(keys.as_py(), np.int64), counts), np.repeat(np.frombuffer(sums.as_py(), np.uint32), counts)))
            if not parts:
                continue
            h, place, key, total = (np.concatenate(x) for x in zip(*parts))
            del parts
            if not known:
                order = np.argsort(h)
                h, key = h[order], key[order]
                runs = np.flatnonzero(np.diff(h, prepend=~h[:1]) != 0)
                late = key > np.repeat(np.minimum.reduceat(key, runs), np.diff(np.append(runs, len(h))))
                own = order[late]
                key, place, total = key[late], place[own], total[own]
            if not len(key):
                continue
            order = np.lexsort((total, key))
            key, total, place = key[order], total[order], place[order]
            new = np.flatnonzero((np.diff(key, prepend=~key[:1]) != 0) | (np.diff(total.astype(np.int64), prepend=-1) != 0))
            out["_key"] += key[new].tolist()
            out["_sum"] += total[new].tolist()
            out["starts"] += [place[a:b].tobytes() for a, b in zip(new, np.append(new[1:], len(place)))]
        return pa.table({"_key": pa.array(out["_key"], pa.int64()), "_sum": pa.array(out["_sum"], pa.int64()), "starts": pa.array(out["starts"], pa.binary())})

    return buckets.groupBy("bucket").applyInArrow(run, "_key long, _sum long, starts binary")


def remove_repeats(docs: DataFrame, *, window: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, n_removed, intervals, kept_text`` for every document.

    Words are runs of other than ASCII white space.  A word goes if a window of
    ``window`` words covers it whose word sequence also starts in a document of
    smaller key; windows are those of the input.  ``intervals`` holds the
    maximal removed ranges [start, end) of word numbers, ``kept_text`` the
    other words joined by one space.

    A null text has no words; a text of fewer than ``window`` words loses
    none.  Rows of equal key don't make each other go, whatever their texts;
    each is judged against smaller keys.  Keys are whole numbers; a row of null
    key counts as later than all others (as one of the largest long), and every
    row comes back with its own key.  An empty table gives an empty result.
    """
    last = (1 << 63) - 1
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(last)).alias("_key"), F.col(text).alias("_text"), F.col(key).alias("_own"))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    marks = cut(_mark(_starts(rows.select("_key", "_text"), window, max(64, -(-size // BUCKET_BYTES)))))
    release(docs.sparkSession)  # the windows' shuffle files are no longer needed
    marks = marks.groupBy("_key", "_sum").agg(F.collect_list("starts").alias("starts"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, starts in zip(column_bytes(batch, "_text"), batch.column(batch.schema.get_field_index("starts"))):
                words = (text or b"").split()
                n, starts = len(words), starts.as_py()
                if not starts:
                    out.append((n, 0, [], b" ".join(words)))
                    continue
                at = np.frombuffer(b"".join(starts), np.uint32).astype(np.int64)
                steps = np.zeros(n + 1, np.int64)
                np.add.at(steps, at, 1)
                np.add.at(steps, at + window, -1)
                gone = np.cumsum(steps)[:n] > 0
                edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                kept = [words[i] for i in np.flatnonzero(~gone)]
                out.append((n, int(gone.sum()), [{"start": a, "end": b} for a, b in edges.tolist()], b" ".join(kept)))
            columns = list(zip(*out)) or [[]] * 4
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch(
                [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], span), pa.array(columns[3], pa.binary()).cast(pa.string())],
                ["_own", "n_words", "n_removed", "intervals", "kept_text"],
            )

    met = rows.withColumn("_sum", F.crc32(F.coalesce("_text", F.lit("")).cast("binary"))).join(marks, ["_key", "_sum"], "left")
    kind = docs.schema[key].dataType.simpleString()
    out = met.select("_own", "_text", "starts").mapInArrow(run, f"_own {kind}, n_words long, n_removed long, intervals array<struct<start:long,end:long>>, kept_text string")
    return out.withColumnRenamed("_own", key)
