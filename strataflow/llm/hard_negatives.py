"""Hard negatives by bit-sliced integer products.

A row's components are cut into bit planes.  The product with an anchor is
summed plane by plane, the most significant first; what the planes left can
still add is between two bounds that halve each time, so every candidate has
an interval that tightens, and goes once the interval can't reach the scores
that are already held.

Work is laid out as a grid of cells: a block of anchors against a stripe of
row blocks.  A cell is one group of a cogrouped function; it goes through its
stripe block by block and keeps the best of each anchor, so that later blocks
meet tight bounds and only those few rows leave the cell.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut
from .integer_vectors import NO_KEY, blocks, facts, numbers_of


@dataclass(frozen=True)
class Settings:
    """Components become floor(scale * x).  A negative's score is from ``low``
    to ``high`` percent of the positive's.  ``anchors`` is a cell's mean number
    of anchors, ``rows`` the most its stripe has on average."""

    scale: int = 256
    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    anchors: int = 8192
    rows: int = 1 << 16


AT_ONCE = 512  # anchors of a cell that meet a block of rows at once
SPARSE = 16  # when fewer than one pair in so many is left, pairs go on one by one


class Planes:
    """The bit planes of a block of rows, two's complement, the top one first."""

    def __init__(self, x, low: int, high: int):
        self.x, self.bits = x, 1 + max(high.bit_length(), (~low).bit_length() if low < 0 else 0)

    def __iter__(self):
        """``(weight, plane, rest)``: ``rest`` is the most the lower planes can hold."""
        for b in reversed(range(self.bits)):
            yield (-(1 << b) if b == self.bits - 1 else 1 << b), (self.x >> b) & 1, (1 << b) - 1


class Best:
    """The ``k`` best (score, key) of each of ``n`` places: higher scores
    first, of equal ones the smaller key."""

    def __init__(self, n: int, k: int):
        import numpy as np

        self.n, self.k = n, k
        self.place, self.score, self.key = (np.empty(0, np.int64) for _ in range(3))

    def add(self, place, score, key) -> None:
        import numpy as np

        place, score, key = (np.concatenate(x) for x in ((self.place, place), (self.score, score), (self.key, key)))
        order = np.lexsort((key, -score, place))
        place, score, key = place[order], score[order], key[order]
        first = np.searchsorted(place, place)
        keep = np.arange(len(place)) - first < self.k
        self.place, self.score, self.key = place[keep], score[keep], key[keep]

    def bar(self, least):
        """What a score must reach to get in: at least ``least``, and the last one held where all are."""
        import numpy as np

        out = np.full(self.n, least, np.int64) if np.isscalar(least) else least.copy()
        full = np.bincount(self.place, minlength=self.n) == self.k
        last = np.append(self.place[1:] != self.place[:-1], True) if len(self.place) else np.empty(0, bool)
        at = self.place[last]
        out[at] = np.where(full[at], np.maximum(out[at], self.score[last]), out[at])
        return out


def survivors(a, x, low: int, high: int, alive, floor, ceiling, top: int = 0):
    """``i, j, score`` of the pairs of anchors and rows whose score is within
    ``floor`` and ``ceiling`` of the anchor (whole numbers).

    ``alive`` says which pairs take part.  With ``top`` a pair also goes once
    ``top`` others of its anchor are sure to score higher.
    """
    import numpy as np

    up, down = np.maximum(a, 0).sum(1), np.maximum(-a, 0).sum(1)
    # products of whole numbers below 2**53 are exact in floating point and run in BLAS
    exact = np.float64 if int(np.abs(a).sum(1).max(initial=0)) * (1 << Planes(x, low, high).bits) < 1 << 52 else np.int64
    left, total, pairs = a.astype(exact), np.zeros(alive.shape, exact), None
    floor = floor.astype(exact)
    for weight, plane, rest in Planes(x, low, high):
        if pairs is None:
            total += weight * (left @ plane.T.astype(exact))
            if top and alive.shape[1] > top:
                # the top-th best of the lower bounds: so many reach it for sure
                sure = np.where(alive, total, -np.inf if exact is np.float64 else np.iinfo(np.int64).min // 2)
                floor = np.maximum(floor, np.partition(sure, -top, axis=1)[:, -top] - (down * rest).astype(exact))
            alive &= (total + (up * rest)[:, None] >= floor[:, None]) & (total - (down * rest)[:, None] <= ceiling[:, None])
            if alive.sum() * SPARSE < alive.size:
                pairs = np.nonzero(alive)
                total = total[pairs].astype(np.int64)
                floor = floor[pairs[0]]
        else:
            i, j = pairs
            total = total + weight * np.einsum("pd,pd->p", a[i], plane[j])
            keep = (total + up[i] * rest >= floor) & (total - down[i] * rest <= ceiling[i])
            pairs, total, floor = (i[keep], j[keep]), total[keep], floor[keep]
    if pairs is None:
        pairs = np.nonzero(alive)
        total = total[pairs].astype(np.int64)
    return *pairs, total


def _read(stripe):
    """A stripe's blocks, one after the other: first number, keys, labels, components, low, high."""
    import numpy as np

    if not stripe.num_rows:  # it has no columns then
        return
    for r in stripe.sort_by([("part", "ascending"), ("place", "ascending")]).to_batches(max_chunksize=1):
        r = {c: r.column(c)[0].as_py() for c in ("first", "n", "dim", "low", "high", "keys", "labels", "data")}
        yield r["first"], np.array(r["keys"], np.int64), np.array(r["labels"], np.int64), numbers_of(r["data"], r["n"], r["dim"]), r["low"], r["high"]


def _anchors(table):
    """A cell's anchors in lots of bounded size: the lot, their components and labels."""
    import numpy as np

    for at in range(0, table.num_rows, AT_ONCE):
        lot = table.slice(at, AT_ONCE)
        a = np.array([numbers_of(d, 1, dim)[0] for d, dim in zip(lot["data"].to_pylist(), lot["size"].to_pylist())], np.int64).reshape(lot.num_rows, -1)
        yield lot, a, lot["label"].to_numpy()


def _nearest_of_label(s: Settings):
    def cell(anchors, stripe):
        import numpy as np
        import pyarrow as pa

        out = []
        for lot, a, labels in _anchors(anchors):
            numbers = lot["number"].to_numpy()
            best = Best(len(a), s.positives)
            for first, keys, own, x, low, high in _read(stripe):
                bar = best.bar(-(1 << 62))
                for label in np.intersect1d(labels, own):
                    i, j = np.flatnonzero(labels == label), np.flatnonzero(own == label)
                    alive = numbers[i][:, None] != (first + j)[None]  # all but the anchor's own row
                    gi, gj, score = survivors(a[i], x[j], low, high, alive, bar[i], np.full(len(i), 1 << 62), s.positives)
                    best.add(i[gi], score, keys[j[gj]])
            out.append(pa.table({"number": numbers[best.place], "positive_id": best.key, "positive_score": best.score}))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("number", "positive_id", "positive_score")})

    return cell


def _negatives(s: Settings):
    names = ("number", "nth", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")

    def cell(anchors, stripe):
        import numpy as np
        import pyarrow as pa

        out = []
        for lot, a, labels in _anchors(anchors):
            numbers, ids, found = lot["number"].to_numpy(), lot["anchor_id"].to_numpy(), lot["positives"].to_pylist()
            owner = np.repeat(np.arange(len(a)), [len(f) for f in found])
            score = np.array([p["positive_score"] for f in found for p in f], np.int64)
            other = np.array([p["positive_id"] for f in found for p in f], np.int64)
            nth = np.array([q for f in found for q in range(len(f))], np.int64)
            least, most = -((-s.low * score) // 100), (s.high * score) // 100
            best = Best(len(owner), s.negatives)
            for _, keys, own, x, low, high in _read(stripe):
                bar = best.bar(least)
                open_ = bar <= most
                floor, ceiling = np.full(len(a), 1 << 61), np.full(len(a), -(1 << 61))
                np.minimum.at(floor, owner[open_], bar[open_])
                np.maximum.at(ceiling, owner[open_], most[open_])
                i, j, got = survivors(a, x, low, high, labels[:, None] != own[None], floor, ceiling)
                for q in range(s.positives):  # each pair meets its anchor's q-th positive, where there is one
                    slot = np.full(len(a), -1)
                    slot[owner[nth == q]] = np.flatnonzero(nth == q)
                    slots = slot[i]
                    keep = (slots >= 0) & (got >= bar[slots]) & (got <= most[slots])
                    best.add(slots[keep], got[keep], keys[j[keep]])
            p = best.place
            out.append(pa.table(dict(zip(names, (numbers[owner[p]], nth[p], ids[owner[p]], other[p], score[p], best.key, best.score)))))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in names})

    return cell


def mine(
    vectors: DataFrame,
    anchor: Column,
    s: Settings = Settings(),
    *,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A score is the inner product of the whole numbers floor(scale * x); higher
    scores come first, of equal ones the smaller key.  The positives of an
    anchor, a row where ``anchor`` holds, are its first other rows of the same
    label; the negatives of each are the first rows of another label whose
    score is from ``low`` to ``high`` percent of the positive's.

    Rows with a null label, a null vector or a null or non-finite component
    take no part.  A null key comes after all others and stays null.  Repeated
    rows are rows of their own, as anchors, too; an anchor's own row is none of
    its positives, an equal one may be.  An empty table, or one without
    anchors, gives no row.  Other columns are left out, so their names can't
    clash.  Keys and labels are whole numbers (a key of 2**63 - 1 is taken for
    null).  Vectors of several lengths, and components so large that a score
    might not fit in 62 bits, end with a ValueError.
    """
    spark = vectors.sparkSession
    packed = cut(blocks(vectors.where(F.col(label).isNotNull()), s.scale, key=key, label=label, vector=vector, mark=anchor))
    got = facts(packed)
    if not got["marked"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if max(got["dim"], 1) * (2 * max(abs(got["low"]), abs(got["high"])) + 1) ** 2 * max(s.low, s.high, 1) >= 1 << 62:
        raise ValueError("the components are too large for exact scores in 62 bits")

    groups = -(-got["marked"] // s.anchors)
    # small tables get as many stripes as there are tasks, each of one block at least
    stripes = max(-(-got["rows"] // s.rows), min(2 * spark.sparkContext.defaultParallelism, got["blocks"]))
    tasks = 3 * groups * stripes  # cells are dealt out by a hash: few meet
    bytes_ = F.length("data").cast("long").alias("_bytes")
    width = F.expr("cast(_bytes div greatest(n * dim, 1) as int)")
    every = packed.select("first", "n", "dim", "keys", "labels", "marks", "data", bytes_).select("*", width.alias("_width"), F.posexplode("marks").alias("_at", "_mark")).where("_mark")
    anchors = cut(
        every.select(
            (F.col("first") + F.col("_at")).alias("number"),
            F.get("keys", "_at").alias("anchor_id"),
            F.get("labels", "_at").alias("label"),
            F.col("dim").alias("size"),  # a column that both sides of a cogroup have from one source gets lost
            F.substring("data", F.expr("_at * dim * _width + 1").cast("int"), F.expr("dim * _width").cast("int")).alias("data"),
        )
    )
    striped = packed.select("*", F.expr(f"pmod(part + place * {got['parts']}L, {stripes}L)").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("a"))
    dealt = striped.select(F.col("a").cast("long").alias("a"), "s", "part", "place", "first", "n", "dim", "low", "high", "keys", "labels", "data").repartition(tasks, "a", "s")

    def against(table: DataFrame, cell, schema: str) -> DataFrame:
        grid = table.select(F.expr(f"pmod(xxhash64(number), {groups}L)").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))).alias("s"), "*")
        return grid.repartition(tasks, "a", "s").groupBy("a", "s").cogroup(dealt.groupBy("a", "s")).applyInArrow(cell, schema)

    def first(df: DataFrame, by: list[str], score: str, other: str, k: int) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), other))).where(F.col("rank") <= k)

    near = against(anchors, _nearest_of_label(s), "number long, positive_id long, positive_score long")
    near = first(near, ["number"], "positive_score", "positive_id", s.positives)
    listed = near.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("positives"))
    far = against(
        cut(anchors.join(listed, "number")),
        _negatives(s),
        "number long, nth long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    ranked = first(far, ["number", "nth"], "negative_score", "negative_id", s.negatives)
    own = lambda c: F.when(F.col(c) != NO_KEY, F.col(c)).alias(c)
    return ranked.select(own("anchor_id"), own("positive_id"), F.col("rank").cast("int").alias("rank"), own("negative_id"), "positive_score", "negative_score")
