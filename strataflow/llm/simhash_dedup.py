"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two 32-bit segments.  If two fingerprints
differ in at most 2 bits, then either they agree in the low segment, or their
high segments differ in at most 1 bit.  So every distinct fingerprint looks up
the Hamming ball of radius 1 around its high segment and its own low segment
in the table of segments, and the complete distance of what it finds is
verified inside the join.  Copies never meet: only distinct fingerprints do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, cut

SEED = 42
MAX_DISTANCE = 2


def shingle_hashes(words: list[bytes], width: int):
    """The XXH64 values (seed 42) of all shingles, in order; none without a word."""
    import numpy as np
    import xxhash

    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)] if words else [], "<u8")
    ends = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(ends + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), "<u8", len(starts))


def fingerprint_of(text: bytes | None, width: int) -> int:
    """The unsigned SimHash of one text (see :func:`fingerprints`)."""
    return simhash_of(shingle_hashes((text or b"").lower().split(), width)) & (1 << 64) - 1


def simhash_of(hashes) -> int:
    """The SimHash of 64-bit hashes, as a signed long: the bits that more than half of them have."""
    import numpy as np

    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``key, fingerprint`` (a signed long) of every whole text.

    A-Z become lower case; words are runs of other than ASCII white space;
    shingles are ``width`` words joined by one space, repeats included, or the
    whole sequence if there are fewer words.  A bit is set if more than half
    of the shingles' XXH64 values (seed 42) have it.  A null or wordless text
    has fingerprint 0.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            got = np.fromiter((fingerprint_of(t, width) for t in column_bytes(batch, "_text")), "<u8", batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(got.view("<i8"))], ["_key", "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return (
        docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
        .mapInArrow(run, f"_key {kind}, fingerprint long")
        .withColumnRenamed("_key", key)
    )


def links(nodes: DataFrame, *, distance: int = MAX_DISTANCE) -> DataFrame:
    """All pairs ``a < b`` of the distinct longs in ``nodes.fingerprint`` that
    differ in 1 to ``distance`` (at most 2) bits, each once."""
    if not 0 <= distance <= 2:
        raise ValueError("two segments guarantee distances of at most 2")
    high, low = F.shiftrightunsigned("fingerprint", 32), F.expr("fingerprint & 4294967295L")
    ball = F.array(high, *[high.bitwiseXOR(F.lit(1 << i)) for i in range(32)])
    segments = F.array(F.struct(F.lit(0).alias("segment"), high.alias("value")), F.struct(F.lit(1).alias("segment"), low.alias("value")))
    table = nodes.select(F.col("fingerprint").alias("b"), F.explode(segments).alias("s")).select("b", "s.segment", "s.value")
    probes = nodes.select(
        F.col("fingerprint").alias("a"),
        F.explode(F.concat(F.transform(ball, lambda v: F.struct(F.lit(0).alias("segment"), v.alias("value"))), F.array(F.struct(F.lit(1).alias("segment"), low.alias("value"))))).alias("s"),
    ).select("a", "s.segment", "s.value")
    apart: Column = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    met = probes.join(table, ["segment", "value"]).where((F.col("a") < F.col("b")) & (apart <= distance))
    return met.select("a", "b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether, of edges ``a > b``, each ``a`` has one and no ``b`` is an ``a``."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("child").alias("n"), F.max("parent").alias("p")).where("n > 1 or n = 1 and p = 1").isEmpty()


def stars(edges: DataFrame, *, max_rounds: int = 40) -> DataFrame:
    """``a, b``: each node of the edge list ``a, b`` but the smallest of its
    component, with that one.

    Alternating large-star and small-star rounds; each round shrinks the graph
    towards stars around the smallest nodes, in about log rounds, and none is
    made once it consists of stars.  Each round is cut into the shared
    checkpoint folder.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    for _ in range(max_rounds):
        if _are_stars(edges):
            return edges
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour points at the least one
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every smaller neighbour and the node itself point at the least one
        down = large.where(F.col("b") < F.col("a"))
        small = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(small, "a")
        edges = cut(
            joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(small.select("a", F.col("m").alias("b")))
            .where(F.col("a") != F.col("b"))
            .distinct()
        )
    raise RuntimeError("components did not settle; raise max_rounds")


def components(edges: DataFrame, *, max_rounds: int = 40) -> DataFrame:
    """``node, component``: the smallest node reachable, for every node in the
    edge list ``a, b`` (nodes with no edge to another are not in it)."""
    edges = stars(edges, max_rounds=max_rounds)
    own = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(own)


def _labels(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``fingerprint, component_id``: the least key ``_least`` of each node's component over the edges ``found``."""
    member = components(found).withColumnRenamed("node", "fingerprint")
    named = nodes.join(member, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    least = named.groupBy("component").agg(F.min("_least").alias("component_id"))
    return named.join(least, "component").select("fingerprint", "component_id")


def labelled(marks: DataFrame, found: DataFrame) -> DataFrame:
    """``_key, fingerprint, component_id`` of every row of ``marks``."""
    nodes = cut(marks.groupBy("fingerprint").agg(F.min("_key").alias("_least")))
    return marks.join(_labels(nodes, found), "fingerprint").select("_key", "fingerprint", "component_id")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3, distance: int = MAX_DISTANCE) -> DataFrame:
    """``key, fingerprint, component_id, n_links`` for every document.

    ``component_id`` is the smallest key of all documents reachable over links
    of at most ``distance`` differing bits, ``n_links`` the number of other
    fingerprints within that distance.  Null keys are ignored in the minimum
    (null if the component has no other).  Repeated rows stay.  An empty table
    gives an empty result.
    """
    marks = cut(fingerprints(docs, key=key, text=text, width=width).withColumnRenamed(key, "_key"))
    nodes = cut(marks.groupBy("fingerprint").agg(F.min("_key").alias("_least")))
    found = cut(links(nodes.select("fingerprint"), distance=distance))
    degree = found.select(F.explode(F.array("a", "b")).alias("fingerprint")).groupBy("fingerprint").agg(F.count("*").alias("n_links"))
    labels = _labels(nodes, found).join(degree, "fingerprint", "left").select("fingerprint", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return marks.join(labels, "fingerprint").select(F.col("_key").alias(key), "fingerprint", "component_id", "n_links")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one whose
    key is the group's smallest (one row of that key, if it is repeated).
    Rows without a key cannot be named by it and all stay."""
    return keep_first(docs, near_duplicates(docs, key=key, text=text), key)


def keep_first(docs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``docs`` with the rows whose key is their ``component_id`` in ``found``, and those without a key."""
    first = found.where(F.col(key) == F.col("component_id")).groupBy(F.col(key).alias("_kept")).agg(F.count("*").alias("_n"))
    first = cut(first)
    kept = docs.join(first.select("_kept"), F.col(key) == F.col("_kept"), "left_semi")
    if first.where("_n > 1").isEmpty():
        once = kept
    else:
        once = kept.dropDuplicates([key])
    return once.unionByName(docs.where(F.col(key).isNull()))
