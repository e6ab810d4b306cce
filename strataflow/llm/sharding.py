"""Contiguous shards of near-equal byte size.

Global prefix sums of the byte sizes come from per-range totals: documents are
put into key ranges, each range is summed on its own, the few range totals are
turned into offsets, and a running sum inside each range is added to its
offset.  No text moves: the one shuffle carries key, size and checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import range_bucket, range_edges


def shard_by_bytes(docs: DataFrame, shards: int, *, key: str = "doc_id", text: str = "text", ranges: int = 192) -> DataFrame:
    """Shard every document, in key order, at equal targets of total bytes.

    A document's size is its UTF-8 length plus 1 (a null text has size 1).  It
    goes to the shard in which the middle of its bytes lies, so shards are
    contiguous in key order and differ from the target by less than one
    document.  Returns ``key, size, text_crc32, position, shard, slot``;
    ``position`` counts over everything, ``slot`` within the shard, both from 0
    without gaps.  Other columns of ``docs`` are left out, so names cannot
    clash.

    Ties: rows of equal key follow in order of checksum, then size; rows equal
    in all three are interchangeable.  Null keys come first.  An empty table
    gives an empty result.  A shard can stay empty if there are fewer documents
    than shards or one is larger than a target.  ``2 * total bytes * shards``
    must fit in 63 bits.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("_key"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    edges = range_edges(rows, "_key", ranges)
    rows = rows.withColumn("_range", range_bucket("_key", edges))

    # at most ranges + 1 rows: one task orders them, and they are broadcast
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).partitionBy(F.lit(0))
    offsets = (
        rows.groupBy("_range")
        .agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
        .select(
            "_range",
            F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
            F.sum("_bytes").over(everything).alias("_total"),
        )
    )
    within = W.partitionBy("_range").orderBy("_key", "text_crc32", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = (
        rows.select("*", F.sum("size").over(within).alias("_run"), F.row_number().over(within).alias("_nth"))
        .join(F.broadcast(offsets), "_range")
        .withColumn("_twice_mid", 2 * (F.col("_bytes_before") + F.col("_run")) - F.col("size"))
        .select(
            F.col("_key"),
            "size",
            "text_crc32",
            (F.col("_rows_before") + F.col("_nth") - 1).alias("position"),
            F.expr(f"cast(least((_twice_mid * {shards}L) div (2 * _total), {shards - 1}) as int)").alias("shard"),
        )
    )
    # one row a shard
    first = placed.groupBy(F.col("shard").alias("_shard")).agg(F.min("position").alias("_first"))
    return (
        placed.join(F.broadcast(first), F.col("shard") == F.col("_shard"))
        .withColumn("slot", F.col("position") - F.col("_first"))
        .select(F.col("_key").alias(key), "size", "text_crc32", "position", "shard", "slot")
    )
