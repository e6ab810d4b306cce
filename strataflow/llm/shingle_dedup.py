"""Near-duplicates by SimHash, and by exact shingle similarity for the rest.

Every set of shingles has a 64-bit SimHash.  Sets whose fingerprints are equal or
at most 2 bits apart are found by multi-index hashing, and of the sets that meet
in the join below the ones with the nearest fingerprints are compared first.
Fingerprints propose pairs only: the whole sets decide, and what no fingerprint
proposes is found by an exact prefix-filtered join.

Two documents are near-duplicates if the Jaccard similarity of their sets of
five-word shingles is at least 0.8.  If a set of n shingles is put in an order
that all sets share, a similar set has one of its first n - ceil(0.8 n) + 1
shingles among its own first ones.  So only these are joined, the shingles that
are common in a tenth of the documents last; sizes, places
and counts of shingles by their hash rule out most pairs met, and the whole sets
decide on the others.  Every similar pair is found, whatever the
order.

Equal sets are one node.  Large groups aren't compared pair by pair: first each
node meets one smaller node that it shares a shingle with, then the smallest node
of every shingle whose nodes aren't in one component yet; only nodes that are
still apart meet each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column_bytes, cut, release, tidied
from .simhash_dedup import SEED, keep_first, labelled, shingle_hashes, simhash_of, stars
from .simhash_dedup import links as near_fingerprints

WIDTH = 5
#: The least similarity, as a fraction: all comparisons are of whole numbers.
PART, WHOLE = 4, 5
COMMON = 1 << 17  # shingles that are put last by their counts
#: Documents in which common shingles are counted: a part of all, and so many at least on average.  A fixed number would
#: let the groups of the join grow with the corpus, as a shingle has to be ever more frequent to be seen twice.
LOOK_PART, LOOK = 0.1, 5000
ROWS = 1 << 20  # numbers in a batch that a task hands on
FULL = 4  # shingles in one of the buckets that a set's shingles are counted in, at most and on average
SLOTS = 1 << 19  # longs of a bit table: 4 MB however many entries it has


def shingle_set(text: bytes | None, width: int = WIDTH):
    """The sorted distinct hashes of a text's shingles; none if it has no word."""
    import numpy as np

    return np.unique(shingle_hashes((text or b"").lower().split(), width)).view("<i8")


def node_of(own) -> int:
    """A set's name: a hash of it, as a signed long."""
    import xxhash

    value = xxhash.xxh64_intdigest(own.tobytes(), SEED)
    return value - (1 << 64) if value >> 63 else value


def _bits(nodes: DataFrame):
    """A bit table of the longs in ``nodes.node``, as a broadcast.  It has
    ``SLOTS`` longs at any scale; a node that isn't there may share its bit with
    one that is, so what passes it is still joined."""
    import numpy as np

    bit = F.expr("shiftleft(1L, cast(shiftright(node, 19) & 63 as int))")
    got = nodes.groupBy(F.expr(f"node & {SLOTS - 1}L").alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(SLOTS, np.int64)
    table[got.column("slot").to_numpy()] = got.column("bits").to_numpy()
    return nodes.sparkSession.sparkContext.broadcast(table)


def _in_bits(table, values):
    """Whether each of ``values`` may be in the bit table."""
    return table[values & SLOTS - 1] >> (values >> 19 & 63) & 1


def _sets(docs: DataFrame, text: str, bits=None) -> DataFrame:
    """``node, shingles`` of every row of ``docs``, or of those whose node is in
    the bit table."""

    @tidied
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def done(nodes, sets):
            offsets = np.append(0, np.cumsum([len(x) for x in sets])).astype(np.int32)
            return pa.record_batch([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], ["node", "shingles"])

        for batch in batches:
            nodes, sets, size = [], [], 0
            for value in column_bytes(batch, "_text"):
                own = shingle_set(value)
                node = node_of(own)
                if bits is not None and not _in_bits(bits.value, node):
                    continue
                nodes.append(node)
                sets.append(own)
                size += len(own)
                if size >= ROWS:
                    yield done(nodes, sets)
                    nodes, sets, size = [], [], 0
            if nodes:
                yield done(nodes, sets)

    return docs.select(F.col(text).alias("_text")).mapInArrow(run, "node long, shingles array<long>")


def sketch_of(own) -> bytes:
    """How many of a set's hashes have each value of their lowest bits: a byte a
    bucket, the buckets a power of two.  Empty if a byte is too small."""
    import numpy as np

    buckets = 1 << max(4, (-(-len(own) // FULL) - 1).bit_length())
    counts = np.bincount(own & buckets - 1, minlength=buckets)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def least_apart(x: bytes, y: bytes) -> int:
    """By how many shingles two sets differ at least, by their sketches; the finer one is folded."""
    import numpy as np

    x, y = (np.frombuffer(z, np.uint8).astype(np.int32) for z in sorted((x, y), key=len))
    return int(np.abs(x - y.reshape(-1, len(x)).sum(0)).sum()) if len(x) else 0


def _nodes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``_key, fingerprint, mark, size, sketch``: the node of every row, with its
    set's SimHash, size and counts."""

    @tidied
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for t in column_bytes(batch, "_text"):
                own = shingle_set(t)
                rows.append((node_of(own), simhash_of(own), len(own), sketch_of(own)))
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            if rows:
                yield pa.record_batch([batch.column(0), *columns], ["_key", "fingerprint", "mark", "size", "sketch"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"_key {kind}, fingerprint long, mark long, size long, sketch binary")


def _proposed(nodes: DataFrame) -> DataFrame:
    """``a, b``: each of ``nodes`` with the smallest of its SimHash, and the
    smallest of each SimHash with that of one other at most 2 bits apart."""
    least = cut(nodes.groupBy("mark").agg(F.min("node").alias("least")))
    same = nodes.join(least, "mark").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    near = near_fingerprints(least.select(F.col("mark").alias("fingerprint"))).groupBy("b").agg(F.min("a").alias("a"))
    named = near.join(least.select(F.col("mark").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("mark").alias("b"), F.col("least").alias("y")), "b")
    return cut(same.union(named.select(F.least("x", "y"), F.greatest("x", "y"))))


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``a, b, bits``: those of the pairs whose sets can be similar by their
    counts, and by how many bits their fingerprints differ.  No similar pair is lost."""

    @tidied
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            # sets of n and m shingles that share i differ in n + m - 2 i
            keep = [least_apart(x, y) * (PART + WHOLE) <= most * (WHOLE - PART) for most, x, y in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)))]
            yield pa.record_batch(batch.columns[:3], ["a", "b", "bits"]).filter(pa.array(keep, pa.bool_()))

    own = nodes.select(F.col("node").alias("a"), F.col("mark").alias("_ma"), F.col("size").alias("_na"), F.col("sketch").alias("_ka"))
    other = nodes.select(F.col("node").alias("b"), F.col("mark").alias("_mb"), F.col("size").alias("_nb"), F.col("sketch").alias("_kb"))
    both = pairs.select("a", "b").join(own, "a").join(other, "b")
    bits = F.bit_count(F.col("_ma").bitwiseXOR(F.col("_mb")))
    return both.select("a", "b", bits.alias("bits"), F.col("_na") + F.col("_nb"), "_ka", "_kb").mapInArrow(run, "a long, b long, bits int")


def _common(docs: DataFrame, text: str):
    """As broadcasts: sorted shingles that a sample has most often, with their
    counts, and a bit table of all that it has more than once.  They decide the
    order only, never what is found; a shingle that shares another's bit is
    put further back than it need be, in all sets alike."""
    import numpy as np

    sample = docs.sample(min(1.0, max(LOOK_PART, LOOK / max(docs.count(), 1))), seed=5)
    counts = cut(_sets(sample, text).dropDuplicates(["node"]).select(F.explode("shingles").alias("v")).groupBy("v").agg(F.count("*").alias("n")).where("n > 1"))
    got = counts.orderBy(F.desc("n"), "v").limit(COMMON).toArrow()
    value, n = (got.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    order = np.argsort(value)
    return docs.sparkSession.sparkContext.broadcast((value[order], n[order])), _bits(counts.select(F.col("v").alias("node")))


def _prefixes(docs: DataFrame, text: str) -> DataFrame:
    """``token, node, place``: the first shingles of every row's set; ``place``
    is the set's size, shifted left by 32, and the shingle's rank in it."""
    common, seen = _common(docs, text)

    @tidied
    def run(batches):
        import numpy as np
        import pyarrow as pa

        value, count = common.value

        def done(rows):
            return pa.record_batch([pa.array(np.concatenate(x), pa.int64()) for x in zip(*rows)], ["token", "node", "place"])

        for batch in batches:
            rows, size = [], 0
            for t in column_bytes(batch, "_text"):
                own = shingle_set(t)
                n = len(own)
                if not n:
                    continue
                rank = _in_bits(seen.value, own)  # 1 of those that were seen, but not among the most frequent
                if len(value):
                    at = np.minimum(np.searchsorted(value, own), len(value) - 1)
                    rank = np.where(value[at] == own, count[at], rank)
                first = np.lexsort((own, rank))[: n - -(-PART * n // WHOLE) + 1]
                rows.append((own[first], np.full(len(first), node_of(own)), (n << 32) + np.arange(len(first))))
                size += len(first)
                if size >= ROWS:
                    yield done(rows)
                    rows, size = [], 0
            if rows:
                yield done(rows)

    return docs.select(F.col(text).alias("_text")).mapInArrow(run, "token long, node long, place long")


def _may_reach(x: Column, y: Column) -> Column:
    """Whether sets whose first common shingle has these places can be similar."""
    n, m = F.shiftright(x, 32), F.shiftright(y, 32)
    i, j = x.bitwiseAND(F.lit((1 << 32) - 1)), y.bitwiseAND(F.lit((1 << 32) - 1))
    most = F.least(n - i, m - j)
    return most * (PART + WHOLE) >= (n + m) * PART


def _similar(pairs: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Those of the pairs ``a, b`` that are similar by their whole sets; without pairs, no text is read."""
    if pairs.isEmpty():
        return pairs
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # only sets that may be wanted are shuffled
    sets = cut(_sets(docs, text, _bits(wanted)).join(wanted, "node", "left_semi").dropDuplicates(["node"]))
    release(docs.sparkSession)
    both = F.size(F.array_intersect("_sa", "_sb"))
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("_sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("_sb")), "b")
    return met.where(both * (PART + WHOLE) >= (F.size("_sa") + F.size("_sb")) * PART).select("a", "b")


def links(docs: DataFrame, nodes: DataFrame, *, text: str = "text") -> DataFrame:
    """``a, b``: each node but the smallest of its component of similar nodes,
    with that one.  ``nodes`` has ``node, mark, size, sketch`` of each set once."""
    by_token = Window.partitionBy("token")
    rows = _prefixes(docs, text).repartition("token").dropDuplicates(["token", "node"])
    # a shingle that only one node has meets nothing
    rows = cut(rows.withColumn("_n", F.count("*").over(by_token)).where("_n > 1").drop("_n"))
    release(docs.sparkSession)  # the first shingles of all sets, the largest shuffle

    def apart(joined: DataFrame) -> DataFrame:
        """``rows`` with their components, without shingles of one component only."""
        named = rows.join(joined.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("token", "node", "place", F.coalesce("component", "node").alias("component"))
        named = named.withColumn("_few", F.min("component").over(by_token) == F.max("component").over(by_token))
        return cut(named.where("not _few").drop("_few"))

    def led(rows: DataFrame) -> DataFrame:
        """Each node with the smallest one of each shingle, if they can be similar."""
        lead = F.min(F.struct("node", "place", "component")).over(by_token)
        near = _may_reach(F.col("lead.place"), F.col("place")) & (F.col("lead.node") < F.col("node")) & (F.col("lead.component") != F.col("component"))
        met = rows.withColumn("lead", lead).where(near).select(F.col("lead.node").alias("a"), F.col("node").alias("b"))
        return _likely(met.distinct(), nodes)

    # each node first meets those that SimHash proposes, and of the smallest nodes of its shingles the one with the nearest
    # fingerprint, which joins most of a large group; then the others that are still apart
    nearest = led(rows.withColumn("component", F.col("node"))).groupBy("b").agg(F.min(F.struct("bits", "a")).alias("_")).select("_.a", "b")
    one = cut(_likely(_proposed(nodes), nodes).select("a", "b").union(nearest).distinct())
    joined = stars(_similar(one, docs, text))
    release(docs.sparkSession)  # the shuffle files and plans of the steps so far
    more = cut(led(apart(joined)).select("a", "b").join(one, ["a", "b"], "left_anti"))
    met_before = one.union(more)
    joined = stars(joined.union(_similar(more, docs, text)))
    release(docs.sparkSession)
    rows = apart(joined)
    x = rows.select("token", F.col("node").alias("a"), F.col("place").alias("_x"), F.col("component").alias("_c"))
    y = rows.select("token", F.col("node").alias("b"), F.col("place").alias("_y"), F.col("component").alias("_d"))
    met = x.join(y, "token").where((F.col("a") < F.col("b")) & (F.col("_c") != F.col("_d")) & _may_reach(F.col("_x"), F.col("_y")))
    rest = cut(_likely(met.select("a", "b").distinct().join(met_before, ["a", "b"], "left_anti"), nodes).select("a", "b"))
    return stars(joined.union(_similar(rest, docs, text)))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, component_id`` for every document: the smallest key of all that
    are reachable over similar documents.

    A-Z become lower case; words are runs of other than ASCII white space; a
    text of fewer than five words is one shingle, and null or wordless texts
    are similar to each other only.  Equality of shingles and sets is equality
    of 64-bit hashes.  Null keys are ignored in the minimum (null if the
    component has no other).  Repeated rows stay.  An empty table gives an
    empty result.  ``docs`` is read six times at most.
    """
    marks = cut(_nodes(docs, key, text))
    nodes = cut(marks.where("size > 0").select(F.col("fingerprint").alias("node"), "mark", "size", "sketch").dropDuplicates(["node"]))
    found = links(docs, nodes, text=text)
    release(docs.sparkSession)
    return labelled(marks.select("_key", "fingerprint"), found).select(F.col("_key").alias(key), "component_id")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one whose
    key is the group's smallest (one row of that key, if it is repeated).
    Rows without a key cannot be named by it and all stay."""
    return keep_first(docs, near_duplicates(docs, key=key, text=text), key)
