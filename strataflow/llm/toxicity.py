"""A convolutional text classifier for toxicity, trained in numpy.

Words are embedded by hashing: the word itself and its prefixes pick rows of a
table, which add up.  Filters of several widths run over the words; the largest
response of each goes to a logistic output.  Training takes all labelled
documents, in the tasks: they are dealt into shards, each shard trains its own
copy of the weights, and the copies are averaged before the next round.  Scoring
runs over whole texts in the tasks.  Decision thresholds are calibrated by
language on labelled documents that the training has not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, cut, kept_rows, release, tidied, tidy

PREFIXES = (3, 4, 5)
_PUNCTUATION = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


@dataclass(frozen=True)
class Settings:
    """``shard_labels`` and ``shard_bytes`` are what a shard has of labelled
    texts, about; a task holds one shard at a time, with 16 bytes a word."""

    shard_labels: int = 8192
    shard_bytes: int = 24 << 20
    rounds: int = 3  # in which shards train before they are averaged; one shard needs one
    table: int = 1 << 17
    size: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    epochs: int = 6
    steps: int = 900  # at least; few labels get more epochs
    batch: int = 32
    rate: float = 0.01
    calibration: int = 5  # one in so many labels calibrates, by a hash of the key
    bins: int = 1 << 12  # of scores, in which the labels that calibrate are counted
    least: int = 30  # labels of each class a language needs for a threshold of its own
    seed: int = 7


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case words; ASCII punctuation and white space part them."""
    return (text or b"").decode("utf-8", "replace").lower().encode().translate(_PUNCTUATION).split()


def word_rows(word: bytes, table: int) -> list[int]:
    """The rows of a word in the embedding table: its own and its prefixes'."""
    import xxhash

    letters = word.decode()
    parts = [b"w" + word, *(b"p" + letters[:n].encode() for n in PREFIXES)]
    return [xxhash.xxh32_intdigest(p) % table for p in parts]


class Network:
    """The classifier: embedding ``E``, filters ``W[width]`` of shape
    (width, size, filters) with bias ``b``, output ``v`` and ``c``.

    A filter of width w has a response at every word of a text: to it and the
    w - 1 words after it, zeros standing for those after the last.  A text
    without words has one response, to zeros."""

    def __init__(self, s: Settings):
        import numpy as np

        r = np.random.default_rng(s.seed)
        self.s, self.prior, self.thresholds, self.threshold = s, None, {}, 0.5
        self.p = {"E": r.normal(0, 0.1, (s.table, s.size)).astype(np.float32)}
        for w in s.widths:
            self.p[f"W{w}"] = r.normal(0, 0.4 / w, (w, s.size, s.filters)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(s.filters, np.float32)
        self.p["v"] = r.normal(0, 0.3, s.filters * len(s.widths)).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    # ---- training
    def step(self, texts, y):
        """Of a batch of texts (the rows of each word of each text): the scores,
        the gradients of all but ``E``, the rows of ``E`` and their gradients."""
        import numpy as np

        s, p = self.s, self.p
        pad = max(s.widths) - 1
        lens = np.array([len(t) for t in texts])
        rows = np.concatenate(texts)
        ends = np.cumsum(lens + pad)  # zeros part the texts; a text's responses end before its own
        place = np.arange(lens.sum()) + np.repeat(ends - lens - pad, lens) - np.repeat(np.cumsum(lens) - lens, lens)
        x = np.zeros((ends[-1] + pad, s.size), np.float32)
        x[place] = p["E"][rows].sum(1)
        back = np.full(len(x), -1)
        back[place] = np.arange(len(rows))
        pooled, top = [], []
        for w in s.widths:
            z = sum(x[j : j + ends[-1]] @ p[f"W{w}"][j] for j in range(w))
            got = np.array([z[a:b].argmax(0) + a for a, b in zip(ends - lens - pad, ends - pad)])
            top.append(got)
            pooled.append(np.maximum(np.take_along_axis(z, got, 0) + p[f"b{w}"], 0))
        h = np.concatenate(pooled, 1)
        out = 1 / (1 + np.exp(-(h @ p["v"] + p["c"])))
        error = (out - y) / len(texts)
        g = {"v": h.T @ error, "c": error.sum(keepdims=True)}
        dh = np.outer(error, p["v"]) * (h > 0)
        gx = np.zeros_like(x)
        for k, w in enumerate(s.widths):
            d = dh[:, k * s.filters : (k + 1) * s.filters]
            g[f"b{w}"] = d.sum(0)
            g[f"W{w}"] = np.zeros_like(p[f"W{w}"])
            for j in range(w):
                near = x[top[k] + j]  # (texts, filters, size)
                g[f"W{w}"][j] = np.einsum("nf,nfs->sf", d, near)
                np.add.at(gx, top[k] + j, d[:, :, None] * p[f"W{w}"][j].T[None])
        hit = np.flatnonzero(gx.any(1) & (back >= 0))
        which, inverse = np.unique(rows[back[hit]], return_inverse=True)
        ge = np.zeros((len(which), s.size), np.float32)
        np.add.at(ge, inverse.reshape(-1), np.repeat(gx[hit], rows.shape[1], 0))
        return out, g, which, ge

    def fit(self, texts, labels, passes: int, shuffle: int = 0) -> None:
        """``texts``: for each text, none without words, an array of the rows of
        each word.  ``shuffle`` sets the order of each pass."""
        import numpy as np

        s, p = self.s, self.p
        r = np.random.default_rng([s.seed + 1, shuffle])
        y = np.asarray(labels, np.float32)
        mean = {k: np.zeros_like(x) for k, x in p.items()}
        var = {k: np.zeros_like(x) for k, x in p.items()}
        step = 0
        for _ in range(passes):
            order = r.permutation(len(texts))
            for at in range(0, len(order), s.batch):
                some = order[at : at + s.batch]
                _, g, which, ge = self.step([texts[i] for i in some], y[some])
                step += 1
                rate = s.rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, gk, at_rows in [*((k, gk, ...) for k, gk in g.items()), ("E", ge, which)]:
                    mean[k][at_rows] = 0.9 * mean[k][at_rows] + 0.1 * gk
                    var[k][at_rows] = 0.999 * var[k][at_rows] + 0.001 * gk**2
                    p[k][at_rows] -= rate * mean[k][at_rows] / (np.sqrt(var[k][at_rows]) + 1e-8)

    # ---- scoring
    def _score(self, n: int, part, long: int = 1 << 14) -> float:
        """The score of a text of ``n`` words; ``part(a, b)`` gives the responses
        of all filters' rows to the words from ``a`` up to ``b``.  A very long
        text goes piece by piece, each with the words after it that its last
        responses need."""
        import numpy as np

        s, p = self.s, self.p
        best = np.full(s.filters * len(s.widths), -np.inf, np.float32)
        for start in range(0, max(n, 1), long):
            here = min(long, n - start)
            got = part(start, min(n, start + here + max(s.widths) - 1))
            column = 0
            for k, w in enumerate(s.widths):
                z = np.zeros((max(here, 1), s.filters), np.float32)
                for j in range(w):
                    m = min(here, len(got) - j)
                    if m > 0:
                        z[:m] += got[j : j + m, column : column + s.filters]
                    column += s.filters
                own = best[k * s.filters : (k + 1) * s.filters]
                np.maximum(own, z.max(0), out=own)
        h = np.maximum(best + np.concatenate([p[f"b{w}"] for w in s.widths]), 0)
        return float(1 / (1 + np.exp(-(h @ p["v"] + p["c"][0]))))

    def _filters(self):
        import numpy as np

        return np.concatenate([self.p[f"W{w}"][j] for w in self.s.widths for j in range(w)], 1)  # (size, all)

    def score_rows(self, rows) -> float:
        """The score of a text given by its words' rows."""
        filters = self._filters()
        return self._score(len(rows), lambda a, b: self.p["E"][rows[a:b]].sum(1) @ filters)

    def scorer(self, max_words: int = 50_000):
        """A function from a list of words to a score; keeps the filters'
        responses of words it has met (at most ``max_words``, then afresh)."""
        import numpy as np

        s, p = self.s, self.p
        if self.prior is not None:
            return lambda words: self.prior
        filters = self._filters()
        responses, known = np.zeros((1 << 14, filters.shape[1]), np.float32), {}

        def of(words):
            nonlocal responses
            if len(known) > max_words:
                known.clear()
            new = [w for w in dict.fromkeys(words) if w not in known]
            if new:
                at = len(known)
                if at + len(new) > len(responses):
                    bigger = np.zeros((max(2 * len(responses), at + len(new)), filters.shape[1]), np.float32)
                    bigger[:at] = responses[:at]
                    responses = bigger
                responses[at : at + len(new)] = p["E"][np.array([word_rows(w, s.table) for w in new])].sum(1) @ filters
                known.update(zip(new, range(at, at + len(new))))
            return responses[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]

        return lambda words: self._score(len(words), lambda a, b: of(words[a:b]))


def best_threshold(low, high, n, ones, doubt: int = 20) -> float:
    """The cut with the best F1 (of equal ones the one nearest to 0.5), drawn
    towards 0.5 as if by ``doubt`` further labels of class 1.  Cuts part bins of
    scores, given by their least and largest score, labels and labels of class 1."""
    import numpy as np

    order = np.argsort(-np.asarray(low), kind="stable")
    low, high, n, ones = (np.asarray(x)[order] for x in (low, high, n, ones))
    f1 = 2 * np.cumsum(ones) / (np.cumsum(n) + ones.sum())
    cuts = (low + np.append(high[1:], 0)) / 2
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    cut = float(cuts[best[np.argmin(np.abs(cuts[best] - 0.5))]])
    return (cut * ones.sum() + 0.5 * doubt) / (ones.sum() + doubt)


BLOCK = 1 << 11  # rows of the embedding table that are averaged together


def _trained(network: Network, shards: DataFrame, passes: int, turn: int) -> None:
    """One round: every shard trains ``network``'s weights, and ``network`` gets
    the average of what changed.  A row of the embedding table is averaged over
    the shards that moved it; rows that no shard's texts have become 0.  The
    driver gets one set of weights, however many shards there are."""
    import numpy as np

    s = network.s
    small = [k for k in network.p if k != "E"]
    held = shards.sparkSession.sparkContext.broadcast(network.p)

    def parts(shard, texts, labels):
        own = Network(s)
        own.p = {k: x.copy() for k, x in held.value.items()}
        own.fit(texts, labels, passes, shard * s.rounds + turn)
        change = own.p["E"] - held.value["E"]
        seen = np.zeros(s.table, bool)
        for t in texts:
            seen[t] = True
        yield -1, shard, np.concatenate([(own.p[k] - held.value[k]).ravel() for k in small]).tobytes(), b""
        for at in range(0, s.table, BLOCK):
            yield at, shard, change[at : at + BLOCK].tobytes(), seen[at : at + BLOCK].tobytes()

    @tidied
    def run(batches):
        import pyarrow as pa

        def done(*shard):
            at, which, change, seen = zip(*parts(*shard))
            return pa.record_batch([pa.array(at, pa.int32()), pa.array(which, pa.int32()), pa.array(change, pa.binary()), pa.array(seen, pa.binary())], ["at", "shard", "change", "seen"])

        known, shard, texts, labels = {}, None, [], []
        for batch in batches:
            for which, label, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), column_bytes(batch, 2)):
                if which != shard:
                    if texts:
                        yield done(shard, texts, labels)
                    known, shard, texts, labels = {}, which, [], []
                words = words_of(value)
                for w in words:
                    if w not in known:
                        known[w] = word_rows(w, s.table)
                texts.append(np.array([known[w] for w in words], np.int32))
                labels.append(label)
        if texts:
            yield done(shard, texts, labels)

    def averaged(group):
        import pyarrow as pa

        group = group.sort_by("shard")  # floats are added in one order
        at, width = group.column("at")[0].as_py(), s.size if group.column("at")[0].as_py() >= 0 else 1
        total, moved, seen = 0, 0, False
        for change, own in zip(group.column("change"), group.column("seen")):
            change = np.frombuffer(change.as_buffer(), np.float32).reshape(-1, width)
            total = total + change.astype(np.float64)
            moved = moved + (change.any(1, keepdims=True) if at >= 0 else 1)
            seen = seen | np.frombuffer(own.as_buffer(), bool)
        return pa.table({"at": pa.array([at], pa.int32()), "change": [(total / np.maximum(moved, 1)).astype(np.float32).tobytes()], "seen": [seen.tobytes()]})

    got = shards.select("_shard", "_label", "_text").mapInArrow(run, "at int, shard int, change binary, seen binary")
    for row in got.groupBy("at").applyInArrow(averaged, "at int, change binary, seen binary").toArrow().to_pylist():
        change, at = np.frombuffer(row["change"], np.float32), row["at"]
        if at >= 0:
            block = network.p["E"][at : at + BLOCK]
            block += change.reshape(-1, s.size)
            block[~np.frombuffer(row["seen"], bool)] = 0
            continue
        for k in small:
            network.p[k] += change[: network.p[k].size].reshape(network.p[k].shape)
            change = change[network.p[k].size :]
    held.destroy()


def _calibrated(network: Network, held: DataFrame) -> None:
    """Thresholds from all of ``held``, labelled texts that weren't trained on; labels are counted by bins of scores."""
    s = network.s

    @tidied
    def run(batches):
        import pyarrow as pa

        of = network.scorer()
        for batch in batches:
            yield pa.record_batch([*batch.columns[:2], pa.array([of(words_of(t)) for t in column_bytes(batch, 2)], pa.float64())], ["_label", "_lang", "score"])

    scores = cut(held.select("_label", "_lang", "_text").mapInArrow(run, "_label int, _lang string, score double"))
    bins = [F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("n"), F.sum("_label").alias("ones")]

    def best(bins):
        return best_threshold(*(bins.column(k).to_numpy() for k in ("low", "high", "n", "ones")))

    binned = scores.withColumn("bin", F.floor(F.col("score") * s.bins))
    everywhere = binned.groupBy("bin").agg(*bins).orderBy("bin").toArrow()
    ones, n = (sum(everywhere.column(k).to_pylist()) for k in ("ones", "n"))
    if not 0 < ones < n:
        return
    network.threshold = best(everywhere)
    # a language with too few labels of its own has the general threshold
    common = scores.groupBy("_lang").agg(F.sum("_label").alias("a"), F.sum(1 - F.col("_label")).alias("b")).where(f"_lang is not null and least(a, b) >= {s.least}").orderBy("_lang")
    for name in [r["_lang"] for r in common.collect()]:
        network.thresholds[name] = best(binned.where(F.col("_lang") == name).groupBy("bin").agg(*bins).orderBy("bin").toArrow())


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic", settings: Settings = Settings()) -> Network:
    """Fit on all labelled documents whose ``crc32(key as text) mod 5`` isn't 0.

    A fifth of them, by a hash of the key, calibrates; the others are dealt into
    shards by another.  A shard trains in one task; with several, the weights
    are averaged after each of ``settings.rounds`` rounds, and the driver gets
    the averages.  Null labels, keys or texts are left out, and so are texts
    without words; a key with both labels has label 1; of documents of equal
    key the one with the least hash of its text counts.  With no labels, or of
    one class only, the network gives the share of label 1 (0 without labels)
    as every score.
    """
    s, spark = settings, docs.sparkSession
    usable = (
        labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
        .where(F.col("_key").isNotNull() & F.col("_label").isin(0, 1) & (F.crc32(F.col("_key").cast("string").cast("binary")) % 5 != 0))
        .groupBy("_key")
        .agg(F.max("_label").alias("_label"))
    )
    known = cut(
        docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang"))
        .where(F.col("_text").isNotNull())
        .join(usable, "_key")
        .groupBy("_key")
        .agg(F.min(F.struct(F.xxhash64("_text").alias("h"), "_text", "_lang", "_label")).alias("_"))
        .select(F.xxhash64("_key").alias("_order"), F.pmod(F.xxhash64("_key", F.lit(s.seed)), F.lit(s.calibration)).alias("_fold"), "_._label", "_._lang", "_._text")
        .where(F.col("_text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"))  # has a word
    )
    release(spark)  # the shuffle of whole texts
    network = Network(s)
    n, ones = known.agg(F.count("*"), F.sum("_label")).first()
    if not n or ones in (0, n):
        network.prior = ones / n if n else 0.0
        return network
    own = known.where("_fold <> 0")
    m, size = own.agg(F.count("*"), F.sum(F.octet_length("_text"))).first()
    if m:
        shards = max(1, -(-m // s.shard_labels), -(-size // s.shard_bytes))
        dealt = own.select(F.pmod("_order", F.lit(shards)).cast("int").alias("_shard"), "_order", "_label", "_text")
        dealt = cut(dealt.repartitionByRange(shards, "_shard").sortWithinPartitions("_shard", "_order"))
        release(spark)
        rounds = min(s.rounds, shards)
        # a pass over more shards makes as many steps as more passes over one
        passes = -(-max(-(-s.epochs // shards), -(-s.steps * s.batch // m)) // rounds)
        for turn in range(rounds):
            _trained(network, dealt, passes, turn)
    _calibrated(network, known.where("_fold = 0"))
    tidy()  # the driver goes on with other work
    return network


def score(docs: DataFrame, network: Network, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``key, score, threshold, toxic`` of every whole text.

    ``threshold`` is that of the row's language (the general one for a null or
    rare language); ``toxic`` says whether the score reaches it.  The score
    itself sees nothing but the text.  A null text counts as empty; repeated
    rows each come back; an empty table gives an empty result.
    """
    kind = docs.schema[key].dataType.simpleString()

    @tidied
    def run(batches):
        import pyarrow as pa

        of = network.scorer()
        for batch in batches:
            scores = [of(words_of(t)) for t in column_bytes(batch, "_text")]
            cuts = [network.thresholds.get(x, network.threshold) for x in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64()), pa.array(cuts, pa.float64())], ["_key", "score", "threshold"])

    out = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang")).mapInArrow(run, f"_key {kind}, score double, threshold double")
    return out.select(F.col("_key").alias(key), "score", "threshold", (F.col("score") >= F.col("threshold")).alias("toxic"))


def drop_toxic(docs: DataFrame, network: Network, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs``, all columns, without the rows whose score reaches their
    language's threshold.  Each row is judged by itself; nothing moves."""
    names = docs.columns
    text_at, lang_at = names.index(text), names.index(lang)

    @tidied
    def run(batches):
        of = network.scorer()
        for batch in batches:
            cuts = [network.thresholds.get(x, network.threshold) for x in batch.column(lang_at).to_pylist()]
            yield from kept_rows(batch, [of(words_of(t)) < cut for t, cut in zip(column_bytes(batch, text_at), cuts)])

    return docs.mapInArrow(run, docs.schema)
