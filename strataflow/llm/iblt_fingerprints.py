"""Document fingerprints as invertible Bloom lookup sketches, in SQL functions.

A text is a set of paragraphs (lines; a line of more than ``PIECE`` characters
counts as several), each a 64-bit digest.  A digest is added to one cell in
each of three rows; a cell holds a count, the XOR of its digests and the XOR of
their checks.  Subtracting two sketches leaves the differing digests, and
peeling cells that hold a single one recovers them.  If that fails, both texts
are sketched anew over more cells: digests are dealt out to blocks by value,
each block a small sketch of its own, with twice as many blocks on each retry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import range_bucket, range_edges

PIECE = 256  # characters
WIDTH = 8  # cells of each of the three rows
ROUNDS = 6  # of peeling
RETRIES = 4

_ZERO = "named_struct('n', 0, 'k', 0L, 'h', 0L)"


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``value`` evaluated once, as ``name``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def digests(text: str) -> str:
    """SQL: the distinct paragraph digests of a text column."""
    return f"array_distinct(transform(regexp_extract_all({text}, '[^\\\\n]{{1,{PIECE}}}', 0), p -> xxhash64(p)))"


def _mask(h: str) -> str:
    """SQL: the three cells of a digest with check ``h``, one a row, as bits."""
    return " | ".join(f"shiftleft(1L, cast({row * WIDTH} + (shiftrightunsigned({h}, {16 * row}) & {WIDTH - 1}L) as int))" for row in range(3))


#: SQL: the bits of the cells, in order.
_BITS = "array(" + ", ".join(f"{1 << j}L" for j in range(3 * WIDTH)) + ")"


def _cells(signed: str) -> str:
    """SQL: the cells of an array of ``(s, k, h, m)``: sign, digest, check, cells."""
    return f"""transform({_BITS}, b -> aggregate(filter({signed}, e -> e.m & b != 0L), {_ZERO},
        (a, e) -> named_struct('n', a.n + e.s, 'k', a.k ^ e.k, 'h', a.h ^ e.h)))"""


def _signed(array: str, sign: int, salt: int) -> str:
    return f"transform(transform({array}, d -> named_struct('k', d, 'h', xxhash64(d, {salt}))), d -> named_struct('s', {sign}, 'k', d.k, 'h', d.h, 'm', {_mask('d.h')}))"


def _peeled(cells: str, salt: int) -> str:
    """SQL: the array of recovered ``(n, k, h, m)``, n being 1 for digests of
    the first text only and -1 for the second; null if cells are left over."""
    pure = f"array_distinct(transform(filter(s.cells, c -> abs(c.n) = 1 and xxhash64(c.k, {salt}) = c.h), c -> named_struct('n', c.n, 'k', c.k, 'h', c.h, 'm', {_mask('c.h')})))"
    step = _let(
        pure,
        "pure",
        f"""if(size(pure) = 0, s, named_struct('cells', zip_with(s.cells, {_BITS}, (c, b) -> aggregate(filter(pure, p -> p.m & b != 0L), c,
            (a, p) -> named_struct('n', a.n - p.n, 'k', a.k ^ p.k, 'h', a.h ^ p.h))), 'got', concat(s.got, pure)))""",
    )
    nothing = "filter(array(named_struct('n', 0, 'k', 0L, 'h', 0L, 'm', 0L)), x -> false)"
    return f"""aggregate(sequence(1, {ROUNDS}), named_struct('cells', {cells}, 'got', {nothing}), (s, i) -> {step},
        s -> if(exists(s.cells, c -> c.n != 0 or c.k != 0 or c.h != 0), null, s.got))"""


def sketch(array: str) -> str:
    """SQL: the sketch of an array of digests (cells of the first attempt)."""
    return _let(_signed(array, 1, 0), "z", _cells("z"))


def sketch_text(cells: str) -> str:
    """SQL: a sketch as a string of 36 hexadecimal digits a cell."""
    return f"lower(array_join(transform({cells}, c -> concat(lpad(hex(c.n & 65535), 4, '0'), lpad(hex(c.k), 16, '0'), lpad(hex(c.h), 16, '0'))), ''))"


def difference(a: str, b: str, cells_a: str, cells_b: str) -> str:
    """SQL: the number of digests in which two texts differ.

    First by subtracting their fingerprints, then by sketches over more and
    more blocks.  What four retries can't peel (about never) is counted from
    the digests themselves.
    """
    # a difference of many more digests than cells can't be peeled from the fingerprints
    tries = [f"if(abs(size({a}) - size({b})) > {3 * WIDTH}, null, {_known(_peeled(_subtracted(cells_a, cells_b), 0))})"]
    for salt in range(1, RETRIES + 1):
        # blocks in two levels of about equal numbers, so that a long text costs n * sqrt(blocks)
        own = "filter(v.{}, d -> pmod(shiftrightunsigned(d, 24), l.side) = y)"
        both = f"concat({_signed(own.format('a'), 1, salt)}, {_signed(own.format('b'), -1, salt)})"
        block = _let(both, "z", f"if(size(z) = 0, 0, {_known(_peeled(_cells('z'), salt))})")
        column = _let(
            f"named_struct('a', filter({a}, d -> pmod(d, l.side) = x), 'b', filter({b}, d -> pmod(d, l.side) = x))",
            "v",
            f"aggregate(sequence(0, l.side - 1), 0, (n, y) -> if(n is null, n, n + {block}))",
        )
        side = f"named_struct('side', cast(ceil(sqrt({2 ** (salt - 1)} * (size({a}) + size({b}) + 1) / 9.0)) as int))"
        tries.append(_let(side, "l", f"aggregate(sequence(0, l.side - 1), 0, (m, x) -> if(m is null, m, m + {column}))"))
    tries.append(f"size(array_except({a}, {b})) + size(array_except({b}, {a}))")
    return f"coalesce({', '.join(tries)})"


def _subtracted(x: str, y: str) -> str:
    return f"zip_with({x}, {y}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'h', x.h ^ y.h))"


def _known(peeled: str) -> str:
    """SQL: the number of recovered digests, null (not -1) if peeling failed."""
    return _let(peeled, "got", "if(got is null, null, size(got))")


def likeness(a: str, b: str, different: str) -> str:
    """SQL: shared digests over all digests, 1 for two texts without any."""
    return _let(f"named_struct('n', size({a}) + size({b}), 'd', {different})", "z", "if(z.n = 0, 1.0D, cast(z.n - z.d as double) / (z.n + z.d))")


def with_next(docs: DataFrame, *, key: str = "doc_id", text: str = "text", ranges: int = 384) -> DataFrame:
    """``key, body, next``: every text (null: empty) and that of the document
    next in descending key order; the last one's next is the first.

    Rows of equal key follow in order of a hash of the text; null keys come
    last.  Keys are cut into ranges of about equal counts, each ordered on its
    own; what follows a range's last row is the first row of the range below,
    of which there are at most ``ranges``.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), body.alias("body"))
    rows = rows.withColumn("_range", range_bucket("_key", range_edges(rows, "_key", ranges)))
    mark = F.xxhash64("body")
    first = rows.groupBy("_range").agg(F.max_by("body", F.struct(F.col("_key"), F.bitwise_not(mark))).alias("_first"))
    # at most ranges + 1 rows
    down = W.orderBy(F.desc("_range"))
    everything = down.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = first.select("_range", F.coalesce(F.lead("_first").over(down), F.first("_first").over(everything)).alias("_after"))
    own = W.partitionBy("_range").orderBy(F.desc("_key"), mark)
    return (
        rows.withColumn("_lead", F.lead("body").over(own))
        .join(first, "_range")
        .select(F.col("_key").alias(key), "body", F.coalesce("_lead", "_after").alias("next"))
    )


def versions(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, body, next, edited``: ``edited`` is ``body`` with its last half
    of the code points (rounded down) replaced by as many first ones of
    ``next``, or all of it if it is shorter."""
    half = "cast(length(body) div 2 as int)"
    return with_next(docs, key=key, text=text).withColumn("edited", F.expr(f"concat(left(body, length(body) - {half}), left(next, {half}))"))


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_chars, edited, fingerprint, edited_fingerprint, near_edited,
    near_next, n_paragraphs, n_changed`` for every document.

    ``near_*`` is the Jaccard likeness of the paragraph digests of two texts,
    from the recovered difference; ``n_changed`` is the number of digests that
    the edit takes away or adds.  A null text counts as empty, with a
    fingerprint of zeros; two empty texts are alike (1.0).  Equal texts have
    equal fingerprints; the order and the repetition of paragraphs don't count.
    Repeated rows each come back; a single document is its own next; an empty
    table gives an empty result.
    """
    rows = versions(docs, key=key, text=text).select(
        F.col(key).alias("_key"),
        F.length("body").cast("long").alias("n_chars"),
        "edited",
        F.expr(digests("body")).alias("_a"),
        F.expr(digests("edited")).alias("_e"),
        F.expr(digests("next")).alias("_n"),
    )
    rows = rows.select("*", *[F.expr(sketch(f"_{x}")).alias(f"_c{x}") for x in "aen"])
    rows = rows.select("*", F.expr(difference("_a", "_e", "_ca", "_ce")).alias("n_changed"), F.expr(difference("_a", "_n", "_ca", "_cn")).alias("_apart"))
    return rows.select(
        F.col("_key").alias(key),
        "n_chars",
        "edited",
        F.expr(sketch_text("_ca")).alias("fingerprint"),
        F.expr(sketch_text("_ce")).alias("edited_fingerprint"),
        F.expr(likeness("_a", "_e", "n_changed")).alias("near_edited"),
        F.expr(likeness("_a", "_n", "_apart")).alias("near_next"),
        F.size("_a").alias("n_paragraphs"),
        "n_changed",
    )
