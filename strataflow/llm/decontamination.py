"""Documents that hold a benchmark item, exactly or nearly.

Windows as long as an item are fingerprinted with SimHash over their word
shingles and looked up in a multi-index of the items' fingerprints: 8 blocks of
8 bits, each item filed under every value within 2 bits of its block.  Two
fingerprints at most 23 bits apart have a block at most 2 bits apart, so the
lookup finds all of them.  The weighted shingle similarity (shingles counted
with repeats) then decides exactly.

Only windows that hold at least one shingle of an item are fingerprinted:
others have similarity 0 to every item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, kept_rows, tidied
from .substring_dedup import _Powers, window_hashes

RADIUS = 23
BLOCKS = 8
ITEM_BYTES = 8 << 20  # of items in one broadcast block
AT_ONCE = 1 << 22  # windows times items that are looked up at a time
_PUNCTUATION = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case words; ASCII punctuation and white space part them."""
    return (text or b"").decode("utf-8", "replace").lower().encode().translate(_PUNCTUATION).split()


def simhash_windows(hashes, starts, count):
    """SimHash of ``count`` consecutive shingles from each of the starts."""
    import numpy as np

    base, stop = int(starts[0]), int(starts[-1]) + count
    bits = np.unpackbits(hashes[base:stop].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(bits) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:], dtype=np.int32)
    at = starts - base
    return np.packbits((sums[at + count] - sums[at]) * 2 > count, axis=1, bitorder="little").view("<u8").ravel()


class _Index:
    """A block of benchmark items, ready to look windows up."""

    def __init__(self, items: list[tuple[int, bytes | None]], width: int):
        import numpy as np

        powers = _Powers()
        self.items = []
        for item_id, text in items:
            words = words_of(text)
            if words:
                own = min(width, len(words))
                h = window_hashes(words, own, powers)
                value, weight = np.unique(h, return_counts=True)
                self.items.append((item_id, len(words), own, value, weight, int(simhash_windows(h, np.zeros(1, np.int64), len(h))[0])))
        self.widths = sorted({x[2] for x in self.items})
        #: by shingle width: the sorted shingles, each with the items that have it, and a bit table to pass over others
        self.shingles = {}
        for own in self.widths:
            pairs = [(int(v), i) for i, x in enumerate(self.items) if x[2] == own for v in x[3]]
            pairs.sort()
            value = np.array([v for v, _ in pairs], np.uint64)
            maybe = np.zeros(1 << 20, bool)
            maybe[(value >> np.uint64(44)).astype(np.int64)] = True
            self.shingles[own] = (value, np.array([i for _, i in pairs]), maybe)
        #: by item length: the items, and for each block and value those within 2 bits
        self.tables = {}
        near = np.array([i for i in range(256) if i.bit_count() <= RADIUS // BLOCKS], np.uint8)
        for length in {x[1] for x in self.items}:
            own = [i for i, x in enumerate(self.items) if x[1] == length]
            marks = np.array([self.items[i][5] for i in own], "<u8")
            table = np.zeros((BLOCKS, 256, len(own)), bool)
            for j, values in enumerate(marks.view(np.uint8).reshape(-1, BLOCKS)):
                for block, value in enumerate(values):
                    table[block, value ^ near, j] = True
            self.tables[length] = (own, marks, table)

    def matches(self, words: list[bytes], powers: _Powers, threshold: float):
        """``{item: (similarity, start, words, distance)}``, the best window of each."""
        import numpy as np

        best: dict = {}
        for own in self.widths:
            if len(words) < own:
                continue
            h = window_hashes(words, own, powers)
            value, item, maybe = self.shingles[own]
            at = np.flatnonzero(maybe[(h >> np.uint64(44)).astype(np.int64)])
            if not len(at):
                continue
            left, right = np.searchsorted(value, h[at]), np.searchsorted(value, h[at], "right")
            at, left, right = (x[right > left] for x in (at, left, right))
            lengths: dict = {}
            for p, a, b in zip(at.tolist(), left.tolist(), right.tolist()):
                for i in item[a:b].tolist():
                    lengths.setdefault(self.items[i][1], set()).add(p)
            for length, places in lengths.items():
                size = min(length, len(words))
                count = size - own + 1
                near = np.zeros(len(h) + 1, np.int64)
                p = np.array(sorted(places))
                np.add.at(near, np.maximum(p - count + 1, 0), 1)
                np.add.at(near, p + 1, -1)
                starts = np.flatnonzero(np.cumsum(near)[: len(words) - size + 1] > 0)
                for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                    # by pieces: a piece's table has a byte for each of its windows and each item of this length
                    step = max(1, AT_ONCE // len(self.tables[length][0]))
                    for at in range(0, len(run), step):
                        self._look_up(h, run[at : at + step], count, size, length, own, threshold, best)
        return best

    def _look_up(self, h, starts, count, size, length, own, threshold, best):
        import numpy as np

        if not len(starts):
            return
        marks = simhash_windows(h, starts, count)
        items, own_marks, table = self.tables[length]
        blocks = marks.view(np.uint8).reshape(-1, BLOCKS)
        found = table[0, blocks[:, 0]]
        for block in range(1, BLOCKS):
            found = found | table[block, blocks[:, block]]
        w, j = np.nonzero(found)
        distance = np.bitwise_count(marks[w] ^ own_marks[j])
        keep = distance <= RADIUS
        w, j, distance = w[keep], j[keep], distance[keep]
        for k in np.unique(j):
            i = items[int(k)]
            item_id, _, width, value, weight, _ = self.items[i]
            if width != own:
                continue
            region = h[starts[0] : starts[-1] + count]
            slot = np.minimum(np.searchsorted(value, region), len(value) - 1)
            slot = np.where(value[slot] == region, slot, -1)
            shared = np.concatenate(([0], np.cumsum(slot >= 0)))
            total = int(weight.sum())
            for x, d in sorted(zip(w[j == k].tolist(), distance[j == k].tolist())):
                a = int(starts[x] - starts[0])
                most = min(int(shared[a + count] - shared[a]), total)
                if most < threshold * (count + total - most):
                    continue
                have = np.bincount(slot[a : a + count][slot[a : a + count] >= 0], minlength=len(value))
                both = int(np.minimum(have, weight).sum())
                similarity = both / (count + total - both)
                if similarity >= threshold and (i not in best or similarity > best[i][0]):
                    best[i] = (similarity, int(starts[x]), size, int(d))


def _indexes(items: DataFrame, item_key: str, item_text: str, width: int) -> list[_Index]:
    """The items in blocks of at most 8 MB of text, or of one larger item."""
    listed = items.select(F.col(item_key).cast("long").alias("i"), F.col(item_text).alias("t"))
    size = listed.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-size // ITEM_BYTES) or 1
    parts = [listed.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b) if blocks > 1 else listed for b in range(blocks)]
    return [_Index([(r["i"], None if r["t"] is None else r["t"].encode()) for r in part.orderBy("i", "t").collect()], width) for part in parts]


def contaminated(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """``key, item_id, similarity, start, n_words, distance``: every pair of a
    document and a benchmark item it holds, with the best window.

    Words are lower-cased and parted by white space and ASCII punctuation.  A
    window has as many words as the item (or the whole document, if that is
    shorter); it holds the item if the weighted Jaccard similarity of their
    ``width``-word shingles (of all words, for an item of fewer) is at least
    ``threshold`` and their fingerprints differ in at most 23 bits.  Of equally
    similar windows the first counts.  Null or wordless documents and items
    match nothing; repeated documents each come with their own rows; a null
    key stays null.  The items are sent to the tasks in blocks of at most 8 MB
    of text (a larger single item makes a block of its own), each block against
    all documents.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = docs.schema[key].dataType.simpleString()
    out = None
    for index in _indexes(items, item_key, item_text, width):

        def run(batches, index=index):
            import pyarrow as pa

            powers = _Powers()
            for batch in batches:
                found = []
                for n, value in enumerate(column_bytes(batch, "_text")):
                    words = words_of(value)
                    for i, got in index.matches(words, powers, threshold).items() if words else ():
                        found.append((n, index.items[i][0], *got))
                if found:
                    n, *rest = zip(*found)
                    kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32()]
                    yield pa.record_batch([batch.column(0).take(pa.array(n)), *[pa.array(c, k) for c, k in zip(rest, kinds)]], ["_key", "item_id", "similarity", "start", "n_words", "distance"])

        part = rows.mapInArrow(run, f"_key {kind}, item_id long, similarity double, start long, n_words long, distance int")
        out = part if out is None else out.union(part)
    return out.withColumnRenamed("_key", key)


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs``, all columns, without the rows that hold an item (as
    :func:`contaminated` finds them).  Each row is judged by itself; nothing
    moves."""
    at = docs.columns.index(text)
    for index in _indexes(items, item_key, item_text, width):

        def run(batches, index=index):
            powers = _Powers()
            for batch in batches:
                yield from kept_rows(batch, [not index.matches(words_of(value), powers, threshold) for value in column_bytes(batch, at)])

        docs = docs.mapInArrow(tidied(run), docs.schema)
    return docs
