"""Token ids in training order, as fixed-stride binary shards.

Documents are tokenised once and packed into sequences of equal length in a
staging table.  A sequence's number (its partition's offset plus its place
there) goes through a keyed Feistel permutation of the numbers 0 to N-1: the
permutation works on a power of four, and numbers that fall outside are walked
on until they fall inside.  The result is the sequence's slot.  Range
partitions of the slots write the shards, several rounds after each other, so
that the shuffle takes a part of the space the tokens take and an interrupted
run goes on after the last complete round.
"""

from __future__ import annotations

import struct
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column_bytes, release, shared_dir

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256  # the free id of that vocabulary parts documents
PAD = 65535
HEADER = 16  # bytes: slot (8), number of tokens (4), checksum of the tokens (4), all little-endian
MAX_PARTS = 1_000_000


@dataclass(frozen=True)
class Layout:
    """``length`` tokens of 2 bytes a sequence, ``per_shard`` sequences a shard
    (the last may have fewer), written in ``rounds``."""

    length: int = 1024
    per_shard: int = 8192
    rounds: int = 4

    @property
    def stride(self) -> int:
        return HEADER + 2 * self.length + 1  # Spark's text writer ends each record with a line feed


def _encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pack(docs: DataFrame, layout: Layout = Layout(), *, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``part, place, n_tokens, tokens``: the texts of each partition, each
    ended by the id 50256, cut into sequences; only a partition's last one is
    padded.  A null text is an empty one: an end and nothing else."""
    length = layout.length

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, place, encoding = TaskContext.get().partitionId(), 0, _encoding(tokenizer)
        rest = np.empty(0, "<u2")

        def sequences(ids, last):
            nonlocal place
            n = -(-len(ids) // length) if last else len(ids) // length
            counts = [min(length, len(ids) - i * length) for i in range(n)]
            rows = np.full((n, length), PAD, "<u2")
            rows.ravel()[: sum(counts)] = ids[: sum(counts)]
            places = range(place, place + n)
            place += n
            return pa.record_batch([pa.array([part] * n, pa.int64()), pa.array(places, pa.int64()), pa.array(counts, pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["part", "place", "n_tokens", "tokens"])

        for batch in batches:
            found, size = [rest], len(rest)
            for value in column_bytes(batch, "_text"):
                ids = encoding.encode_ordinary((value or b"").decode("utf-8", "replace"))
                ids.append(END)
                found.append(np.array(ids, "<u2"))
                size += len(ids)
                if size >= 1 << 20:
                    ids = np.concatenate(found)
                    yield sequences(ids, False)
                    found = [ids[len(ids) // length * length :]]
                    size = len(found[0])
            rest = np.concatenate(found)
            if len(rest) >= length:
                yield sequences(rest, False)
                rest = rest[len(rest) // length * length :]
        if len(rest):
            yield sequences(rest, True)

    return docs.select(F.col(text).alias("_text")).mapInArrow(run, "part long, place long, n_tokens int, tokens binary")


def permuted(number: Column | str, n: int, key: str, rounds: int = 6) -> Column:
    """A keyed permutation of 0 to ``n - 1``, as a column expression."""
    if n >= 1 << 60:
        raise ValueError("too many numbers")
    width = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask = (1 << width) - 1
    keys = F.array(*[F.xxhash64(F.lit(key), F.lit(i)) for i in range(rounds)])

    def once(x: Column) -> Column:
        start = F.struct(F.shiftright(x, width).alias("l"), x.bitwiseAND(F.lit(mask).cast("long")).alias("r"))
        return F.aggregate(
            keys,
            start,
            lambda s, k: F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(F.xxhash64(s["r"], k).bitwiseAND(F.lit(mask).cast("long"))).alias("r")),
            lambda s: F.shiftleft(s["l"], width).bitwiseOR(s["r"]),
        )

    # at most three in four numbers fall outside: 400 steps leave one with probability 1e-50
    first = once(F.col(number) if isinstance(number, str) else number)
    return F.aggregate(F.sequence(F.lit(1), F.lit(400)), first, lambda x, _: F.when(x < n, x).otherwise(once(x)))


def in_order(packed: DataFrame, key: str) -> tuple[DataFrame, int]:
    """``slot, n_tokens, tokens`` of a staging table, and the number of slots.

    ``packed`` is read twice and must not change between (a written table).
    """
    totals = packed.groupBy("part").agg(F.count("*").alias("_n"))
    parts, n = totals.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    if parts > MAX_PARTS:
        raise ValueError(f"{parts} partitions; their offsets are broadcast and may be {MAX_PARTS}: coalesce the input")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = packed.join(F.broadcast(offsets), "part")
    return numbered.select(permuted(F.col("_before") + F.col("place"), n, key).alias("slot"), "n_tokens", "tokens"), n


def _done(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` was committed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_shards(docs: DataFrame, path: str, key: str, layout: Layout = Layout(), *, text: str = "text", tokenizer: str = TOKENIZER) -> int:
    """Write all texts in training order below ``path``; gives the number of slots.

    ``path/staging`` holds the packed sequences, ``path/round=R/shard=S`` one
    file of records of ``layout.stride`` bytes in order of slot: shard S begins
    with slot ``S * per_shard``, so slot s starts at byte
    ``(s mod per_shard) * stride`` of its file.  Called again with the same
    arguments it goes on after the last complete step.  An empty table writes
    no shard.
    """
    spark = docs.sparkSession
    staging = f"{path}/staging"
    if not _done(spark, staging):
        pack(docs, layout, text=text, tokenizer=tokenizer).write.mode("overwrite").option("compression", "zstd").parquet(staging)
    ordered, n = in_order(spark.read.parquet(staging), key)
    shards = -(-n // layout.per_shard)
    each = -(-shards // layout.rounds)
    for r in range(layout.rounds):
        low, high = r * each * layout.per_shard, min((r + 1) * each * layout.per_shard, n)
        if low >= high or _done(spark, f"{path}/round={r}"):
            continue
        rows = ordered.where((F.col("slot") >= low) & (F.col("slot") < high)).withColumn("shard", F.expr(f"slot div {layout.per_shard}"))
        record = F.concat(_little(F.col("slot"), 8), _little(F.col("n_tokens"), 4), _little(F.crc32("tokens"), 4), F.col("tokens"))
        (
            rows.repartitionByRange(each, "shard")
            .sortWithinPartitions("shard", "slot")
            .select("shard", record.cast("string").alias("value"))
            .write.mode("overwrite")
            .partitionBy("shard")
            .text(f"{path}/round={r}", lineSep="\n")
        )
        release(spark)
    return n


def _little(number: Column, size: int) -> Column:
    """The little-endian bytes of a whole number."""
    digits = F.lpad(F.hex(number.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(size)]))


def read_shards(spark: SparkSession, path: str, layout: Layout = Layout(), *, from_shard: int = 0) -> DataFrame:
    """``shard, offset, slot, n_tokens, tokens, intact`` of the records in the
    files from ``from_shard`` on; ``offset`` is the record's first byte in its
    file, ``intact`` whether slot, length and checksum are as they should be."""

    def run(batches):
        import zlib

        import pyarrow as pa

        stride = layout.stride
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_buffer()
                rows = []
                for offset in range(0, len(data), stride):
                    slot, n, crc = struct.unpack("<qiI", data[offset : offset + HEADER])
                    tokens = bytes(data[offset + HEADER : offset + stride - 1])
                    good = slot == shard * layout.per_shard + offset // stride and len(tokens) == 2 * layout.length and zlib.crc32(tokens) == crc
                    rows.append((shard, offset, slot, n, tokens[: 2 * n], good))
                    if len(rows) == 1024 or offset + stride >= len(data):
                        yield pa.record_batch([pa.array(c) for c in zip(*rows)], ["shard", "offset", "slot", "n_tokens", "tokens", "intact"])
                        rows = []

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    shard = F.regexp_extract("path", r"/shard=(\d+)/", 1).cast("long").alias("shard")
    return files.select(shard, "content").where(F.col("shard") >= from_shard).mapInArrow(run, "shard long, offset long, slot long, n_tokens long, tokens binary, intact boolean")


def new_folder(spark: SparkSession) -> str:
    """A fresh folder in the shared one."""
    return f"{shared_dir(spark)}/training-order-{uuid.uuid4().hex}"
