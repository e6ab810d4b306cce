"""Vector bin packing of examples into training sequences.

An example is a prompt, whose tokens bear no loss, and a text, whose tokens do.
A sequence has three limits at once: tokens, segments and loss-bearing tokens.
Each task tokenises its rows and keeps a bounded pool of examples.  Sequences
are filled one after the other: of all examples that still fit under every
limit, the one whose demand has the largest dot product with the room that is
left goes in next, each dimension weighted by its mean demand in the pool.
Texts move nowhere: the job is one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_bytes, tidied

TOKENIZER = "byte_bpe_50k"
OUT = ("start", "length", "loss", "doc_tokens", "sequence_id", "offset", "padded", "ids")


@dataclass(frozen=True)
class Limits:
    """Of a sequence.  ``pool`` bounds the examples a task holds at once."""

    tokens: int = 1024
    segments: int = 256
    loss: int = 1024
    pool: int = 8192

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss, self.pool) < 1:
            raise ValueError("every limit must be at least 1")


def encoder(name: str = TOKENIZER):
    """A function from a text to its ids (uint32), those of the JSON tokenizer
    ``name`` without added special tokens.

    The same vocabulary as ranks is some five times faster; where its pattern
    gives up, as on millions of spaces, the JSON tokenizer itself steps in.
    """
    import base64
    import json

    import numpy as np
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = public_tokenizers.path(f"{name}.json")
    with open(path, encoding="utf-8") as f:
        special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str):
        if not text:
            return np.empty(0, np.uint32)
        try:
            return fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        except ValueError:
            return np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def whole(n: int, limit: int) -> int:
    """The tokens of ``n`` that a sequence may keep without padding: all of a
    full one, else the largest power of two."""
    return n if n == limit else 1 << (n.bit_length() - 1)


@dataclass(slots=True)
class Piece:
    """Ids ``start`` to ``start + len(ids)`` of an example; its first
    ``silent`` ids bear no loss."""

    key: object
    total: int
    start: int
    ids: object
    silent: int

    @property
    def loss(self) -> int:
        return max(0, len(self.ids) - self.silent)

    def split(self, n: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.key, self.total, self.start, self.ids[:n], min(n, self.silent)),
            Piece(self.key, self.total, self.start + n, self.ids[n:], max(0, self.silent - n)),
        )

    def fitting(self, tokens: int, loss: int) -> int:
        """The most first ids within so many tokens and loss-bearing ones."""
        return min(len(self.ids), tokens, self.silent + loss)


class Pool:
    """Examples that wait, counted by their demand: (tokens, loss)."""

    def __init__(self, limits: Limits):
        import numpy as np

        self.limits, self.n, self.total = limits, 0, np.zeros(2)
        self.rows: dict = {}  # of a kind: its row below
        self.waiting: list = []
        self.demand, self.there = np.empty((64, 2), np.int64), np.zeros(64, bool)

    def add(self, piece: Piece) -> None:
        kind = (len(piece.ids), piece.loss)
        if kind not in self.rows:
            if len(self.waiting) == len(self.there):
                self.widen()
            self.rows[kind] = len(self.waiting)
            self.demand[len(self.waiting)] = kind
            self.waiting.append([])
        at = self.rows[kind]
        self.waiting[at].append(piece)
        self.there[at] = True
        self.n += 1
        self.total += kind

    def widen(self) -> None:
        """Lets go of kinds that are used up; room for as many again."""
        import numpy as np

        left = np.flatnonzero(self.there)
        self.waiting = [self.waiting[i] for i in left]
        demand, self.there = self.demand[left], np.zeros(2 * len(left) + 64, bool)
        self.demand = np.empty((len(self.there), 2), np.int64)
        self.demand[: len(left)], self.there[: len(left)] = demand, True
        self.rows = {tuple(k): i for i, k in enumerate(demand.tolist())}

    def best(self, room: tuple[int, int]) -> Piece | None:
        """Takes out the example that fits and has the largest dot product with
        the room (tokens, loss); of equal ones the kind that came first.  The
        third dimension, segments, has the demand 1 of every example and so
        changes no order."""
        import numpy as np

        fits = self.there & (self.demand[:, 0] <= room[0]) & (self.demand[:, 1] <= room[1])
        if not fits.any():
            return None
        size = np.array([self.limits.tokens, self.limits.loss], float)
        weight = self.total / size**3 * room  # mean demand x room, all as shares of the limits
        return self.take(int(np.where(fits, self.demand @ weight, -1.0).argmax()))

    def longest(self, loss: int) -> Piece | None:
        """Takes out the longest example of which a first part may bear ``loss``."""
        import numpy as np

        ready = self.there & ((loss > 0) | (self.demand[:, 0] > self.demand[:, 1]))
        return self.take(int(np.where(ready, self.demand[:, 0], -1).argmax())) if ready.any() else None

    def take(self, at: int) -> Piece:
        piece = self.waiting[at].pop()
        self.there[at] = bool(self.waiting[at])
        self.n -= 1
        self.total -= self.demand[at]
        return piece

    def sequence(self, cut: bool) -> list[Piece]:
        """The next sequence, of at least one token."""
        limits, out, tokens, loss = self.limits, [], self.limits.tokens, self.limits.loss
        while tokens and len(out) < limits.segments and self.n:
            piece = self.best((tokens, loss))
            if piece is None:
                if not cut or (piece := self.longest(loss)) is None:
                    break
                n = piece.fitting(tokens, loss)
                if not n:  # its silent ids are over and no loss may be added
                    self.add(piece)
                    break
                piece, rest = piece.split(n)
                self.add(rest)
            out.append(piece)
            tokens, loss = tokens - len(piece.ids), loss - piece.loss
        if cut:  # what is over a length that needs no padding goes back
            over = (used := limits.tokens - tokens) - whole(used, limits.tokens)
            while over:
                piece = out.pop()
                if len(piece.ids) > over:
                    piece, rest = piece.split(len(piece.ids) - over)
                    out.append(piece)
                    piece = rest
                over -= len(piece.ids)
                self.add(piece)
        return out


def cuts(piece: Piece, limits: Limits):
    """An example's pieces that fit into a sequence, each as long as can be."""
    while len(piece.ids) > (n := piece.fitting(limits.tokens, limits.loss)):
        first, piece = piece.split(n)
        yield first
    yield piece


def pack(
    examples: DataFrame,
    limits: Limits = Limits(),
    *,
    key: str = "doc_id",
    text: str = "text",
    prompt: str | None = None,
    tokenizer: str = TOKENIZER,
    end: int = 0,
    cut: bool = True,
) -> DataFrame:
    """One row per piece: ``key, start, length, loss, doc_tokens, sequence_id,
    offset, padded, ids``.

    An example's tokens are those of its prompt, those of its text and ``end``;
    all but the prompt's bear loss.  ``ids`` holds a piece's as little-endian
    unsigned 32-bit numbers, ``start`` is its place in the example, ``offset``
    that in its sequence.  Sequences are within all limits and padded to
    ``limits.tokens``, unless their length is a power of two; ``padded`` is
    that length.  With ``cut`` examples are cut where that saves padding, and
    none is left: a sequence that isn't full is cut back to a power of two and
    the rest goes into later ones, so that a task's last tokens make at most
    one short sequence for each power of two.  Without it only examples that
    exceed a limit by themselves are cut.

    A null text or prompt is an empty one; a null key stays null; rows are
    examples of their own, whether or not they repeat; ties go to the kind of
    demand that came first and in it to the latest row.  An empty table gives no row.  Other
    columns are left out, so their names can't clash.  Sequences hold rows of
    one task, so they depend on how the table is split; it should be read from
    files, which are split alike when a lost task is run again.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode, pool = encoder(tokenizer), Pool(limits)
        number, ready, size = TaskContext.get().partitionId() << 33, [], 0

        def close(pieces):
            nonlocal number, size
            used = sum(len(p.ids) for p in pieces)
            padded = used if whole(used, limits.tokens) == used else limits.tokens
            offset = 0
            for p in pieces:
                ready.append((p.key, p.start, len(p.ids), p.loss, p.total, number, offset, padded, p.ids.astype("<u4").tobytes()))
                offset += len(p.ids)
            number, size = number + 1, size + used

        def flush(kind):
            nonlocal ready, size
            columns = list(zip(*ready))
            ready, size = [], 0
            arrays = [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:-1]), pa.array(columns[-1], pa.binary())]
            return pa.record_batch(arrays, ["_key", *OUT])

        kind = None
        for batch in batches:
            kind, keys = batch.schema.field(0).type, batch.column(0)
            for i, (asked, said) in enumerate(zip(column_bytes(batch, 1), column_bytes(batch, 2))):
                silent = encode((asked or b"").decode("utf-8", "replace"))
                ids = np.concatenate([silent, encode((said or b"").decode("utf-8", "replace")), np.array([end], np.uint32)])
                for piece in cuts(Piece(keys[i].as_py(), len(ids), 0, ids, len(silent)), limits):
                    if len(piece.ids) == limits.tokens:
                        close([piece])
                    else:
                        piece.ids = piece.ids.copy()  # else it keeps the whole example's in memory
                        pool.add(piece)
                    if size >= 1 << 18:
                        yield flush(kind)
                if pool.n >= limits.pool:
                    while pool.n > limits.pool // 2:  # the rest meets later examples
                        close(pool.sequence(cut))
                        if size >= 1 << 18:
                            yield flush(kind)
        while pool.n:
            close(pool.sequence(cut))
            if size >= 1 << 18:
                yield flush(kind)
        if ready:
            yield flush(kind)

    rows = examples.select(F.col(key).alias("_key"), (F.col(prompt) if prompt else F.lit(None)).cast("string").alias("_prompt"), F.col(text).cast("string").alias("_text"))
    fields = [T.StructField("_key", rows.schema["_key"].dataType), *(T.StructField(c, T.LongType()) for c in OUT[:-1]), T.StructField("ids", T.BinaryType())]
    return rows.mapInArrow(tidied(run), T.StructType(fields)).withColumnRenamed("_key", key)
