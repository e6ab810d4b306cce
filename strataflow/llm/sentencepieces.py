"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into units: a run of letters or of other characters, with the
spaces before it, a digit, or a line feed.  No piece crosses a unit's border, so
the units' best paths are the text's.  Every distinct unit of the corpus
is exploded into substrings of bounded length, which are equi-joined to the
piece table; the edges found are grouped by unit, and a Viterbi fold with
Spark's ``aggregate`` picks the best path.

Tasks pack their documents into blocks of bounded size, as numbers of words and
of the words' units.  The paths go to the blocks that have their units, and
there the documents are put together.  Neither texts nor units are ever joined
occurrence by occurrence.  The paths of a bounded number of common units, which
nearly every block has, are broadcast instead of sent to each.  The few units
that are too long for a packed edge have a Viterbi of their own, linear in length.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, tidied, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_BYTES = 6 << 20  # of text
BATCH = 1 << 17  # rows a task hands on at a time
COMMON = 1 << 17  # units whose paths are broadcast
LOOK = 5000  # documents, on average, in which the common units are counted
LISTED = 1 << 16  # blocks, about, in one list of those that have a unit
#: The lattice has many edges a unit, and Spark sorts a partition's in memory: a partition has the units of so many bytes
#: of text, unless that takes more partitions than so many for each of the session's.
LATTICE_BYTES, FINER = 2 << 20, 4
UNIT = 48  # characters of a unit whose edges are packed
#: A unit's place in the corpus is one long: partition and block in it (32 bits), number in the block (26), checksum (5).
BLOCKS, NUMBERS, CHECK = 1 << 12, 1 << 26, 5
BUCKETS = 1 << 11  # lists that a block's units are dealt to by their checksums
HEADS = 1 << 16  # slots of the table of piece lengths by first characters
MAX_PIECES = 1_000_000
#: One piece of the model, a superscript two and a full stop, is of both kinds of characters; its runs stay together.
_UNITS = re.compile(r" *+[^\W\d_]++(?:(?<=²)(?=\.)(?:[^\w \n]|_)++)?| *+(?:[^\w \n]|_)++|\d|\n| ++")
_WORDS = re.compile(r" *+[^ \n]++|\n[^ \n]*+| ++")
#: An edge is one long: stop (6 bits), start (6), cost (31), id (20; all ones: spelt in bytes).
_STOP, _START, _COST, _SPELLED = 57, 51, 20, (1 << 20) - 1


@dataclass(frozen=True)
class Vocabulary:
    """``pieces`` (piece with a plain space for the space mark, id, cost in
    100,000ths) without control and byte pieces; ``byte_base`` is the id of
    byte 0, or -1: then ``unknown`` stands for what has no piece."""

    pieces: tuple[tuple[str, int, int], ...]
    byte_base: int
    unknown: int
    longest: int


def load(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a SentencePiece model file.

    A unigram model's scores are log-probabilities and are taken as they are.
    A BPE model's are ranks; by Zipf's law a piece of rank r has a
    log-probability of about -ln(r + 2), and that is taken.
    Pieces of spaces only, which the model ranks after all others (at 1e9), are
    taken by the same law.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    if n > MAX_PIECES:
        raise ValueError(f"{n} pieces; the piece table is broadcast and may have {MAX_PIECES}")
    plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    scores = {i: model.get_score(i) for i in plain}
    ranks = all(s == int(s) and s <= 0 for s in scores.values())
    pieces = []
    for i in plain:
        text = model.id_to_piece(i)
        if text and not re.search(r" |\n", text):
            pieces.append((text.replace("▁", " "), i, min(round(1e5 * (math.log(2 - scores[i]) if ranks else max(-scores[i], 0.0))), (1 << 24) - 1)))
    # pieces that no unit can hold are left out (the model given has none)
    pieces = [p for p in pieces if _UNITS.fullmatch(p[0])]
    bases = [i for i in range(n) if model.is_byte(i)]
    return Vocabulary(tuple(pieces), bases[0] if len(bases) == 256 else -1, model.unk_id(), max((len(p[0]) for p in pieces), default=1))


def _words(text: str) -> list[str]:
    """The text with a space before it, cut before runs of spaces and before
    line feeds; each word without its first space (see :func:`_units`)."""
    if not text:
        return []
    single = text.replace("\n", " \n")
    if "  " in single:
        return [w[1:] if w[0] == " " else w for w in _WORDS.findall(" " + text)]
    return single.split(" ")


def _units(word: str) -> list[str]:
    if word.isalpha():
        return [" " + word]
    return _UNITS.findall(word if word[:1] == "\n" else " " + word)


def _common(docs: DataFrame, text: str, rows: int, vocabulary: Vocabulary):
    """The paths of at most ``COMMON`` units, as a broadcast of units, their ids
    and where each one's ids start; a line feed is one of them.

    Which units are common is counted in a sample of about ``LOOK`` documents.
    It decides by which way a path reaches the documents, never what the path
    is: units that aren't found here go through the join as all others do.
    """
    import numpy as np

    spark = docs.sparkSession

    @tidied
    def run(batches):
        import pyarrow as pa

        def done():
            units = Counter()
            for word, n in found.items():
                for unit in _units(word):
                    units[unit] += n
            return pa.record_batch([pa.array(units.keys(), pa.string()), pa.array(units.values(), pa.int64())], ["unit", "n"])

        found = Counter()
        for batch in batches:
            for value in column_bytes(batch, "_text"):
                found.update(_words((value or b"").decode("utf-8", "replace")))
                if len(found) >= BATCH:
                    yield done()
                    found = Counter()
        if found:
            yield done()

    sample = docs.select(F.col(text).alias("_text")).sample(min(1.0, LOOK / max(rows, 1)), seed=5)
    counts = sample.mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")).where("n > 1 and unit <> '\n'")
    top = counts.orderBy(F.desc("n"), "unit").limit(COMMON).select("unit", F.lit(0).alias("part"), F.lit(0).alias("bucket"), (-F.col("n")).alias("place"))
    # the most common first: small numbers take little space
    got = best_paths(top, vocabulary).select("unit", "ids", F.col("places")[0].alias("n")).toArrow().sort_by([("n", "ascending"), ("unit", "ascending")]).combine_chunks()
    ids = got.column("ids").combine_chunks()
    line = vocabulary.byte_base + 10 if vocabulary.byte_base >= 0 else vocabulary.unknown
    starts = np.cumsum([0, *ids.value_lengths().to_pylist(), 1])
    return spark.sparkContext.broadcast(([*got.column("unit").to_pylist(), "\n"], np.append(ids.flatten().to_numpy(zero_copy_only=False), line).astype(np.int32), starts))


def _blocks(docs: DataFrame, key: str, text: str, common, *, parts: int | None = None) -> DataFrame:
    """``block, keys, texts`` (the documents of a block, see :func:`_opened`)
    or, given ``parts``, ``part, bucket, place, units`` for a block's units that
    aren't common: a line for each, those of one ``bucket`` in order.  ``place``
    holds the block and the first one's number in it, from which they count up;
    ``part`` is the remainder of the block by ``parts``.

    A block is named by partition and place, so both readings of ``docs`` must
    give the same rows in the same order.
    """
    whole = parts is None

    @tidied
    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() * BLOCKS
        shared = len(common.value[0])
        known = dict(zip(common.value[0], range(shared)))
        words, keys, counts, texts, size = defaultdict(itertools.count().__next__), [], [], [], 0

        def done():
            own: dict[str, int] = {}
            first, rest, lens = [], [], []
            for word in words:
                units = _units(word)
                lens.append(len(units))
                for at, unit in enumerate(units):
                    n = known.get(unit)
                    n = own.setdefault(unit, shared + len(own)) if n is None else n
                    (rest if at else first).append(n)
            if len(own) >= NUMBERS or block % BLOCKS == BLOCKS - 1:
                raise ValueError("a partition or a text of docs is too large; give docs more partitions")
            listed, sums = list(own), np.fromiter((zlib.crc32(unit.encode()) for unit in own), np.int64, len(own))
            buckets = sums >> CHECK & BUCKETS - 1
            # the block's own units are numbered by bucket, in order of the units
            ranked = np.array(sorted(range(len(own)), key=list(zip(buckets.tolist(), listed)).__getitem__), np.int64)
            if whole:
                marks = (sums & (1 << CHECK) - 1).astype(np.uint8)[ranked]
                numbers = np.arange(shared + len(own), dtype=np.int32)
                numbers[shared + ranked] = numbers[shared:].copy()
                # words in order of their first unit: its numbers have small steps, and common words small numbers
                first, lens = numbers[np.array(first, np.int64)], np.array(lens, np.int64)
                order = np.argsort(first, kind="stable")
                moved = np.empty(len(order), np.int32)
                moved[order] = np.arange(len(order), dtype=np.int32)
                more = lens - 1
                rest = _spread(numbers[np.array(rest, np.int64)], (np.cumsum(more) - more)[order], more[order])
                payload = _closed(np.array(counts, np.int32), moved[np.concatenate([*texts, np.empty(0, np.int32)])], lens[order].astype(np.int32), np.diff(first[order], prepend=np.int32(0)), rest, marks)
                yield pa.record_batch([pa.array([block], pa.int64()), pa.array([_stored(pa.table({"key": pa.chunked_array(keys)}))], pa.binary()), pa.array([payload], pa.list_(pa.binary()))], ["block", "keys", "texts"])
            elif own:
                buckets = buckets[ranked]
                starts = np.flatnonzero(np.diff(buckets, prepend=-1))
                lines = ["\n".join(map(listed.__getitem__, own_bucket.tolist())) for own_bucket in np.split(ranked, starts[1:])]
                places = block * NUMBERS + starts << CHECK
                yield pa.record_batch([pa.array(np.full(len(starts), block % parts, np.int32)), pa.array(buckets[starts].astype(np.int32)), pa.array(places), pa.array(lines, pa.string())], ["part", "bucket", "place", "units"])

        for batch in batches:
            start = 0
            for i, value in enumerate(column_bytes(batch, "_text")):
                value = (value or b"").decode("utf-8", "replace")
                size += len(value) + 16
                own = _words(value)
                if whole:
                    texts.append(np.fromiter(map(words.__getitem__, own), np.int32, len(own)))
                    counts.append(len(own))
                else:
                    for word in own:
                        words[word]
                if size >= BLOCK_BYTES:
                    keys.append(batch.column(0).slice(start, i + 1 - start))
                    yield from done()
                    block, start = block + 1, i + 1
                    words, keys, counts, texts, size = defaultdict(itertools.count().__next__), [], [], [], 0
                    tidy()
            if start < batch.num_rows:
                keys.append(batch.column(0).slice(start))
        if size:
            yield from done()

    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, "block long, keys binary, texts array<binary>" if whole else "part int, bucket int, place long, units string")


def _closed(*arrays) -> list[bytes]:
    """Arrays of whole numbers, byte by byte, compressed."""
    import numpy as np
    import zstandard

    return [zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 3) for x in arrays]


def _opened(payload: list[bytes]):
    """Of a block: the words of each document, the words' numbers one document
    after the other, the units of each word, their numbers, and the checksums
    of the units that aren't common."""
    import numpy as np
    import zstandard

    *numbers, marks = (np.frombuffer(zstandard.decompress(x), np.uint8) for x in payload)
    counts, words, lens, first, rest = (np.ascontiguousarray(x.reshape(4, -1).T).view(np.int32).ravel() for x in numbers)
    begins = np.cumsum(lens) - lens
    flat = np.empty(int(lens.sum()), np.int32)
    later = np.ones(len(flat), bool)
    later[begins] = False
    flat[begins], flat[later] = np.cumsum(first), rest
    return counts, words, lens, flat, marks


def _spread(values, starts, sizes):
    """The runs of ``values`` that begin at ``starts``, one after the other."""
    import numpy as np

    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    at = np.repeat((starts - ends + sizes).astype(kind), sizes)
    at += np.arange(total, dtype=kind)
    return values[at]


def _stored(table) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _viterbi(v: Vocabulary) -> str:
    """SQL: the ids of the best path through ``edges`` of ``unit``; of equally
    good ones that with the longest last piece, and so on.

    One fold over the edges in order of their stop.  Its state has a long for
    each place so far: the cost of the best path (37 bits), and its last edge's
    start (6) and id (20).  A walk from the last place back gives the ids.
    """
    stop, start = f"cast(shiftright(e, {_STOP}) as int)", f"cast(shiftright(e, {_START}) & 63 as int)"
    edge = f"(shiftright(e, {_START - _COST}) & {63 << _COST}L) | (e & {_SPELLED}L)"
    total = f"shiftright(a[{start}], {_COST + 6}) + (shiftright(e, {_COST}) & {(1 << 31) - 1}L)"
    reached = f"shiftleft({total}, {_COST + 6}) | {edge}"
    best = f"aggregate(sort_array(edges), array(0L), (a, e) -> if(size(a) > {stop}, array_append(slice(a, 1, {stop}), least(a[{stop}], {reached})), array_append(a, {reached})), a -> {{}})"
    char = "hex(encode(substr(unit, s.at, 1), 'utf-8'))"
    if v.byte_base >= 0:
        spelled = f"transform(sequence(0, length({char}) div 2 - 1), i -> {v.byte_base} + cast(conv(substr({char}, 2 * i + 1, 2), 16, 10) as int))"
    else:
        spelled = f"array({v.unknown})"
    ids = f"if(a[s.at] & {_SPELLED}L = {_SPELLED}L, concat({spelled}, s.ids), array_prepend(s.ids, cast(a[s.at] & {_SPELLED}L as int)))"
    back = f"named_struct('at', cast(shiftright(a[s.at], {_COST}) & 63 as int), 'ids', {ids})"
    return best.format(f"aggregate(sequence(2, size(a)), named_struct('at', size(a) - 1, 'ids', cast(array() as array<int>)), (s, x) -> if(s.at = 0, s, {back}), s -> s.ids)")


def _long_paths(distinct: DataFrame, vocabulary: Vocabulary, spell: int) -> DataFrame:
    """As :func:`best_paths`, with the same choices, for units of any length."""
    pieces = distinct.sparkSession.sparkContext.broadcast(vocabulary)

    @tidied
    def run(batches):
        import pyarrow as pa

        v = pieces.value
        table = {piece: (i, cost) for piece, i, cost in v.pieces}
        for batch in batches:
            ids = []
            for unit in batch.column(1).to_pylist():
                best, back = [0], [0]
                for stop in range(1, len(unit) + 1):
                    least, at = None, stop - 1
                    for start in range(max(0, stop - v.longest), stop):
                        got = table.get(unit[start:stop])
                        if got is None and start + 1 < stop:
                            continue
                        cost = best[start] + (spell if got is None else got[1])
                        if least is None or cost < least:
                            least, at = cost, start
                    best.append(least)
                    back.append(at)
                path, stop = [], len(unit)
                while stop:
                    piece = unit[back[stop] : stop]
                    if piece in table:
                        path.append(table[piece][0])
                    else:
                        path.extend([v.byte_base + b for b in reversed(piece.encode())] if v.byte_base >= 0 else [v.unknown])
                    stop = back[stop]
                ids.append(path[::-1])
            yield pa.record_batch([batch.column(1), batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["unit", "places", "ids"])

    return distinct.select("places", "unit").mapInArrow(run, "unit string, places array<long>, ids array<int>")


def _lengths(vocabulary: Vocabulary) -> str:
    """SQL: an array, by the low bits of a hash of the first three characters,
    of the greatest length of the pieces that begin with them (2 if there are
    none: two characters may be a piece whatever follows)."""
    import xxhash

    table = [2] * HEADS
    for piece, _, _ in vocabulary.pieces:
        at = xxhash.xxh64_intdigest(piece[:3].encode(), 42) % HEADS
        table[at] = max(table[at], len(piece))
    return f"cast(split('{','.join(map(str, table))}', ',') as array<int>)"


def best_paths(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``unit, places, ids`` of every distinct ``unit`` and ``part`` of
    ``units``, with the ``place`` of each of its rows.  A unit's ``bucket`` is
    the same in all of them; rows that lie together by both stay where they are.

    A character without a piece has an edge of its own that costs more than any
    path of pieces and stands for its bytes.  Only substrings that are no longer
    than the pieces with their first three characters are looked up.
    """
    spell = 100 * max((c for _, _, c in vocabulary.pieces), default=0) + 1
    # bounded: MAX_PIECES
    pieces = F.broadcast(units.sparkSession.createDataFrame(list(vocabulary.pieces), "piece string, id long, cost long"))
    listed = units.groupBy("part", "bucket", "unit").agg(F.collect_list("place").alias("places"))
    # a filter that names the aggregate stays above the shuffle, which both branches then share
    length = F.length("unit") + 0 * F.size("places")
    distinct = listed.where(length <= UNIT)
    # start -1: a row that stands for the unit itself
    starts = distinct.select("unit", "part", "bucket", "places", F.explode(F.sequence(F.lit(-1), F.length("unit") - 1)).alias("start")).withColumn("places", F.when(F.col("start") < 0, F.col("places")))
    longest = f"element_at({_lengths(vocabulary)}, 1 + cast(pmod(xxhash64(substr(unit, start + 1, 3)), {HEADS}L) as int))"
    stops = starts.select(
        "*",
        F.expr(f"explode(if(start < 0, array(0), sequence(start + 1, least(start + {longest}, length(unit)))))").alias("stop"),
    )
    edges = (
        stops.withColumn("piece", F.when(F.col("start") >= 0, F.substring("unit", F.col("start") + 1, F.col("stop") - F.col("start"))))
        .join(pieces, "piece", "left")
        .where("id is not null or start < 0 or stop = start + 1")
        .select(
            "unit",
            "part",
            "bucket",
            "places",
            F.expr(f"if(start < 0, null, shiftleft(cast(stop as long), {_STOP}) | shiftleft(cast(start as long), {_START}) | shiftleft(coalesce(cost, {spell}L), {_COST}) | coalesce(id, {_SPELLED}L))").alias("edge"),
        )
    )
    grouped = edges.groupBy("part", "bucket", "unit").agg(F.first("places", ignorenulls=True).alias("places"), F.collect_list("edge").alias("edges"))
    paths = grouped.select("unit", "places", F.expr(_viterbi(vocabulary)).alias("ids"))
    return paths.unionByName(_long_paths(listed.where(length > UNIT), vocabulary, spell))


def encode(docs: DataFrame, vocabulary: Vocabulary, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids``: the piece ids of every whole text, in array<int>.

    A space is put before the text, as SentencePiece does.  The ids are those of
    the whole text's best path, however long a run of letters or spaces is, for
    pieces that lie within a unit (all of the given model).  What has no piece
    becomes byte pieces (the unknown piece, if the model has none).  A null or
    empty text has no ids; repeated rows each come back; an empty table gives an
    empty result.

    ``docs`` is read four times (once for its size, once a sample) and must give
    the same rows in the same order, as a table in files does; what comes out of
    a shuffle should be written first.  If it doesn't, the job fails rather than
    giving other ids.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    common = _common(docs, text, rows, vocabulary)
    parts = 1 + (size + 16 * rows) // BLOCK_BYTES // LISTED
    width = 2 if max((i for _, i, _ in vocabulary.pieces), default=0) < 1 << 16 else 3  # bytes an id
    packed = F.expr(f"unhex(array_join(transform(ids, i -> lpad(hex(i), {2 * width}, '0')), ''))")
    # whole lists are shuffled, which takes fewer bytes than a row a unit; their bytes tell
    # little of the rows in them, so partitions aren't coalesced by bytes
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(usual, min(FINER * usual, size // LATTICE_BYTES))
    lists = _blocks(docs, key, text, common, parts=parts).repartition(partitions, "part", "bucket")
    units = lists.select("part", "bucket", "place", F.posexplode(F.split("units", "\n")).alias("at", "unit"))
    place = F.expr(f"place + shiftleft(cast(at as long), {CHECK}) + (crc32(unit) & {(1 << CHECK) - 1}L)")
    paths = best_paths(units.select("unit", "part", "bucket", place.alias("place")), vocabulary).select("places", packed.alias("ids")).select(F.explode("places").alias("place"), "ids")
    paths = paths.select(F.shiftright("place", CHECK + 26).alias("block"), F.expr(f"cast(place & {(NUMBERS << CHECK) - 1}L as int)").alias("name"), "ids")

    def run(texts, paths):
        import numpy as np
        import pyarrow as pa

        _, ids, starts = common.value
        shared = len(starts) - 1
        for keys, payload in zip(texts.column("keys"), texts.column("texts").to_pylist()):
            counts, words, lens, flat, marks = _opened(payload)
            names = paths.column("name").to_numpy()
            if len(names) != len(marks) or (marks[names >> CHECK] != names & (1 << CHECK) - 1).any():
                break
            packed = paths.column("ids").combine_chunks().cast(pa.large_binary())
            begins = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1] if len(packed) else np.zeros(1, np.int64)
            own = np.frombuffer(packed.buffers()[2] or b"", np.uint8)[begins[0] : begins[-1]].reshape(-1, width).astype(np.int32) @ np.array([1 << 16, 1 << 8, 1], np.int32)[3 - width :]
            first, length = np.empty(shared + len(marks), np.int64), np.empty(shared + len(marks), np.int64)
            first[:shared], length[:shared] = starts[:-1], np.diff(starts)
            first[shared + (names >> CHECK)] = len(ids) + (begins[:-1] - begins[0]) // width
            length[shared + (names >> CHECK)] = np.diff(begins) // width
            by_word = _spread(np.concatenate([ids, own]), first[flat], length[flat])
            ends = np.append(0, np.cumsum(length[flat]))[np.append(0, np.cumsum(lens))]
            out = _spread(by_word, ends[:-1][words], np.diff(ends)[words])
            offsets = np.append(0, np.cumsum(np.diff(ends)[words]))[np.append(0, np.cumsum(counts))].astype(np.int32)
            stored = pa.ipc.open_stream(keys.as_py()).read_all()
            tidy()
            return pa.table({"_key": stored.column("key").combine_chunks(), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(out, pa.int32()))})
        raise RuntimeError("docs gave other rows on its second reading; write it to files first")

    together = _blocks(docs, key, text, common).groupBy("block").cogroup(paths.groupBy("block"))
    return together.applyInArrow(run, f"_key {kind}, ids array<int>").withColumnRenamed("_key", key)


def decode(encoded: DataFrame, vocabulary: Vocabulary, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, text``: the text of every array of ids.

    Undoes :func:`encode` for any text if the model has byte pieces.  Unknown
    ids become U+2047; bytes that are no UTF-8 U+FFFD; a null array is an empty
    text.  SQL functions only: each id's bytes in hexadecimal digits are joined.
    """
    known = {i: piece.encode().hex() for piece, i, _ in vocabulary.pieces}
    if vocabulary.byte_base >= 0:
        known.update((vocabulary.byte_base + b, f"{b:02x}") for b in range(256))
    unknown = "⁇".encode().hex()
    table = ",".join(known.get(i, unknown) for i in range(max(known, default=0) + 1))
    rows = encoded.select(F.col(key).alias("_key"), F.expr(f"array_join(transform(`{ids}`, i -> coalesce(get(split('{table}', ','), i), '{unknown}')), '')").alias("_hex"))
    # the space that encode puts before a text goes
    body = "coalesce(make_valid_utf8(cast(unhex(if(startswith(_hex, '20'), substr(_hex, 3), _hex)) as string)), '')"
    return rows.select(F.col("_key").alias(key), F.expr(body).alias("text"))
