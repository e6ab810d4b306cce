"""Each operator against brute force on small tables, with the awkward cases:
nulls, empty and very long texts, ties, repeated rows, empty tables, extra
columns whose names clash with the operators' own."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.llm import (
    decontamination,
    html_extraction,
    iblt_fingerprints,
    pii_surrogates,
    sentencepieces,
    sharding,
    shingle_dedup,
    simhash_dedup,
    substring_dedup,
    toxicity,
    training_order,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, _text string, part long, ids string"


def words(n, seed=0, vocab=300):
    r = np.random.default_rng(seed)
    return " ".join(f"w{i}" for i in r.integers(0, vocab, n))


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None, "x", "y", 1, "z") for i, t in zip(ids, texts)], SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    long = words(30_000, 9)
    texts = [words(200, 1), None, "", " \n\t ", "one", words(200, 1), words(120, 2) + "\n" + words(80, 3), long, long + " tail", "é ü ß ▁ 日本 \U0001f600\x0bx", words(60, 1), words(200, 1)]
    return docs(spark, texts, [5, 3, 8, 1, 2, 9, 12, 40, 41, 7, None, 5]), texts


# ---- 1


def digests_of(text):
    return set(re.findall(r"[^\n]{1,%d}" % iblt_fingerprints.PIECE, text or ""))


def test_fingerprints_match_sets(spark, awkward):
    df, texts = awkward
    rows = iblt_fingerprints.fingerprints(df).collect()
    versions = iblt_fingerprints.versions(df).collect()
    assert len(rows) == len(versions) == len(texts)
    # rows of equal key may follow in any order: what comes next is held against the multiset
    order = sorted({r["doc_id"] for r in versions}, key=lambda k: (k is None, -(k or 0)))
    for k, after in zip(order, order[1:] + order[:1]):
        own, others = ([r["body"] for r in versions if r["doc_id"] == x] for x in (k, after))
        follow = Counter(r["next"] for r in versions if r["doc_id"] == k) - Counter(own)
        assert sum(follow.values()) <= 1 and set(follow) <= set(others)
        assert set(Counter(r["next"] for r in versions if r["doc_id"] == k)) <= {*own, *others}
    for v in versions:
        half = len(v["body"]) // 2
        assert v["edited"] == v["body"][: len(v["body"]) - half] + v["next"][:half]
    near = Counter()
    for v in versions:
        a, e, n = digests_of(v["body"]), digests_of(v["edited"]), digests_of(v["next"])
        near[v["doc_id"], round(len(a & e) / len(a | e) if a | e else 1.0, 9), round(len(a & n) / len(a | n) if a | n else 1.0, 9)] += 1
    assert near == Counter((r["doc_id"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault((r["doc_id"], r["n_chars"]), set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())


def test_fingerprints_of_one_and_none(spark):
    one = iblt_fingerprints.fingerprints(docs(spark, ["a\nb"])).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == 3
    assert iblt_fingerprints.fingerprints(docs(spark, [])).isEmpty()


# ---- 2


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(training_order.permuted("id", n, "k")).collect()]
    assert sorted(got) == list(range(n))
    if n == 1000:
        other = [r[0] for r in spark.range(n).select(training_order.permuted("id", n, "other")).collect()]
        assert got != other and got != sorted(got)


def test_shards_round_trip(spark, awkward, tmp_path):
    df, texts = awkward
    layout = training_order.Layout(length=64, per_shard=100, rounds=3)
    n = training_order.write_shards(df, str(tmp_path / "o"), "k", layout)
    rows = sorted(training_order.read_shards(spark, str(tmp_path / "o"), layout).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(n)) and all(r["intact"] for r in rows)
    assert all(r["offset"] == r["slot"] % 100 * layout.stride and r["shard"] == r["slot"] // 100 for r in rows)
    encoding = training_order._encoding(training_order.TOKENIZER)
    ids = [i for r in rows for i in np.frombuffer(r["tokens"], "<u2").tolist()]
    want = Counter(i for t in texts for i in [*encoding.encode_ordinary(t or ""), training_order.END])
    assert Counter(ids) == want
    # a second call finds everything written
    assert training_order.write_shards(df, str(tmp_path / "o"), "k", layout) == n


def test_shards_of_nothing(spark, tmp_path):
    assert training_order.write_shards(docs(spark, []), str(tmp_path / "e"), "k") == 0


# ---- 3


def test_contiguous_shards(spark, awkward):
    df, texts = awkward
    rows = sorted(sharding.shard_by_bytes(df, 4).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(len(texts)))
    keys = [r["doc_id"] for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    total, at, slots = sum(len((t or "").encode()) + 1 for t in texts), 0, Counter()
    for r in rows:
        assert r["shard"] == min((2 * at + r["size"]) * 4 // (2 * total), 3)
        assert r["slot"] == slots[r["shard"]]
        slots[r["shard"]] += 1
        at += r["size"]
    assert at == total
    assert Counter((r["size"], r["text_crc32"]) for r in rows) == Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    assert sharding.shard_by_bytes(docs(spark, []), 4).isEmpty()


def test_shards_are_near_equal(spark):
    df = docs(spark, [words(5 + i % 40, i) for i in range(800)])
    sums = [r[0] for r in sharding.shard_by_bytes(df, 8).groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sums) == 8 and max(sums) - min(sums) < 700


# ---- 4


def test_toxicity_learns_and_keeps_clean(spark):
    bad = ["vilest", "vileness", "vilely"]
    texts, labels = [], []
    for i in range(900):
        t = words(60, i).split()
        if toxic := i % 4 == 0:
            t[i % 50] = bad[i % 3]
        texts.append(" ".join(t))
        labels.append((i, int(toxic)))
    df, known = docs(spark, texts), spark.createDataFrame(labels + [(None, 1), (5000, None)], "doc_id long, toxic int")
    network = toxicity.train(df, known)
    got = {r["doc_id"]: r for r in toxicity.score(df, network).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(got[i]["toxic"] == bool(labels[i][1]) for i in held)
    assert right / len(held) > 0.95
    kept = {r["doc_id"] for r in toxicity.drop_toxic(df, network).collect()}
    assert kept == {i for i in got if not got[i]["toxic"]}


def test_a_training_step_sees_each_text_alone(spark):
    """Scores of a batch against a loop over single texts, and gradients against differences of the loss."""
    s = toxicity.Settings(table=64, size=3, filters=2)
    r = np.random.default_rng(2)
    texts = [r.integers(0, s.table, (n, 4)).astype(np.int32) for n in (1, 2, 7, 30, 1, 3)]
    y = np.array([0, 1, 1, 0, 1, 0], np.float32)
    network = toxicity.Network(s)
    network.p = {k: (8 if k == "E" else 1) * x.astype(np.float64) for k, x in network.p.items()}
    for w in s.widths:
        network.p[f"b{w}"] -= 0.3  # responses are negative for some texts, so zeros of a neighbour's padding would win
    p = network.p

    def alone(t):
        x, h = p["E"][t].sum(1), []
        for w in s.widths:
            z = [sum(x[i + j] @ p[f"W{w}"][j] for j in range(w) if i + j < len(x)) for i in range(len(x))]
            h.append(np.maximum(np.max(z, 0) + p[f"b{w}"], 0))
        return 1 / (1 + np.exp(-(np.concatenate(h) @ p["v"] + p["c"][0])))

    out, g, which, ge = network.step(texts, y)
    assert np.allclose(out, [alone(t) for t in texts], atol=1e-6)
    assert np.allclose(out, [network.score_rows(t) for t in texts], atol=1e-6)

    def loss():
        o = np.array([alone(t) for t in texts])
        return -np.mean(y * np.log(o) + (1 - y) * np.log(1 - o))

    full = np.zeros(p["E"].shape)
    full[which] = ge
    for name, grad in [*g.items(), ("E", full)]:
        for at in r.choice(p[name].size, min(12, p[name].size), replace=False):
            was = p[name].flat[at]
            p[name].flat[at] = was + 1e-5
            up = loss()
            p[name].flat[at] = was - 1e-5
            down = loss()
            p[name].flat[at] = was
            assert abs((up - down) / 2e-5 - grad.flat[at]) < 1e-3, name


def test_labels_that_contradict_and_repeat(spark):
    df = docs(spark, [words(30, i) for i in range(40)] * 2, list(range(40)) * 2)
    known = spark.createDataFrame([(i, j) for i in range(40) for j in ((0, 1) if i % 2 else (0,))], "doc_id long, toxic int")
    first = toxicity.train(df, known.orderBy(F.desc("doc_id"), "toxic"))
    again = toxicity.train(df.repartition(3), known.orderBy("doc_id", F.desc("toxic")))
    assert first.prior is None and all((first.p[k] == again.p[k]).all() for k in first.p)


def test_toxicity_of_pieces_and_awkward_texts(spark, awkward):
    df, texts = awkward
    s = toxicity.Settings(table=1 << 10)
    network = toxicity.Network(s)
    got = toxicity.score(df, network).collect()
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got)
    # very long texts are scored piece by piece, with the same result
    own = [w.encode() for w in words(40_000, 3, 5000).split()]
    x = np.array([network.p["E"][toxicity.word_rows(w, s.table)].sum(0) for w in own])
    h = []
    for w in s.widths:
        padded = np.concatenate([x, np.zeros((max(s.widths), s.size), np.float32)])
        z = sum(padded[j : j + len(x)] @ network.p[f"W{w}"][j] for j in range(w))
        h.append(np.maximum(z.max(0) + network.p[f"b{w}"], 0))
    want = 1 / (1 + np.exp(-(np.concatenate(h) @ network.p["v"] + network.p["c"][0])))
    assert abs(network.scorer()(own) - want) < 1e-5
    nothing = toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert nothing.scorer()([b"x"]) == 0.0


def test_all_labels_are_trained_on(spark):
    """every word of every labelled text has its row, over several shards, in whatever order the rows come."""
    n = 500
    texts = [f"own{i} {words(20, i)}" + (" vilest" if i % 4 == 0 else "") for i in range(n)]
    df, known = docs(spark, texts), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(n)], "doc_id long, toxic int")
    s = toxicity.Settings(shard_labels=100)
    network = toxicity.train(df, known, settings=s)
    again = toxicity.train(df.repartition(3), known.orderBy(F.desc("doc_id")), settings=s)
    assert all((network.p[k] == again.p[k]).all() for k in network.p) and network.threshold == again.threshold
    moved = network.p["E"].any(1)
    fold = {r[0]: r[1] for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(s.seed)), F.lit(s.calibration))).collect()}
    used = [i for i in range(n) if zlib.crc32(str(i).encode()) % 5 and fold[i]]
    assert len(used) > 250 and all(moved[toxicity.word_rows(f"own{i}".encode(), s.table)].all() for i in used)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, network).collect()}
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in got) > 0.95 * n


def test_thresholds_by_bins():
    bins = np.array([0.9, 0.8, 0.3, 0.1])
    assert toxicity.best_threshold(bins, bins, np.array([1, 2, 1, 1]), np.array([1, 1, 0, 0]), doubt=0) == pytest.approx(0.55)


# ---- 5


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepieces.load()


COSTS: dict = {}


def viterbi(v, unit):
    if id(v) not in COSTS:
        COSTS[id(v)] = {p: (i, c) for p, i, c in v.pieces}, max(c for _, _, c in v.pieces), {}
    known = COSTS[id(v)][2]
    if unit not in known:
        known[unit] = best_path(v, unit)
    return known[unit]


def best_path(v, unit):
    if unit == "\n":
        return [v.byte_base + 10]
    table, worst, _ = COSTS[id(v)]
    st = [(0, [])]
    for p in range(1, len(unit) + 1):
        best = None
        for s in range(max(0, p - v.longest), p):
            if (t := table.get(unit[s:p])) and (best is None or st[s][0] + t[1] < best[0]):
                best = (st[s][0] + t[1], st[s][1] + [t[0]])
        spelled = (st[p - 1][0] + 100 * worst + 1, st[p - 1][1] + [v.byte_base + b for b in unit[p - 1].encode()])
        st.append(spelled if best is None or spelled[0] < best[0] else best)
    return st[-1][1]


def test_encoding_is_the_best_path_and_comes_back(spark, awkward, vocabulary):
    df, texts = awkward
    encoded = sentencepieces.encode(df, vocabulary)
    got = sorted((r["doc_id"] or -1, tuple(r["ids"])) for r in encoded.collect())
    want = sorted((i or -1, tuple(x for u in (sentencepieces._UNITS.findall(" " + t) if t else []) for x in viterbi(vocabulary, u))) for i, t in zip([r["doc_id"] for r in df.collect()], texts))
    assert got == want
    back = sorted((r["doc_id"] or -1, r["text"]) for r in sentencepieces.decode(encoded, vocabulary).collect())
    assert back == sorted((r["doc_id"] or -1, r["text"] or "") for r in df.collect())
    assert sentencepieces.encode(docs(spark, []), vocabulary).isEmpty()


def test_long_runs_and_spaces_have_the_whole_texts_best_path(spark, vocabulary):
    """Against one Viterbi over the whole text, which knows no units."""
    r = np.random.default_rng(6)
    letters = "".join(r.choice(list("etaoinshrdlu"), 700))
    texts = [
        "def f(x):" + " " * 8 + "return   x" + " " * 37 + "# end  ",
        "   two  and" + " " * 100,
        letters,
        "x" + letters[:47] + "  " + letters[:48] + " " + letters[:49],
        "这是一个很长的句子" * 12 + "，日本語の文章もここにあります。" * 6,
        "a 5 m². b 6 m²... c²,d.² _²._",
        "=" * 130 + "-" * 49 + "\U0001f600" * 60,
    ]
    got = {x["doc_id"]: x["ids"] for x in sentencepieces.encode(docs(spark, texts), vocabulary).collect()}
    for i, t in enumerate(texts):
        assert got[i] == viterbi(vocabulary, " " + t), t
    held = {p for p, _, _ in vocabulary.pieces}
    assert {" " * n for n in range(2, 15)} <= held and "²." in held
    back = sentencepieces.decode(sentencepieces.encode(docs(spark, texts), vocabulary), vocabulary).collect()
    assert {x["doc_id"]: x["text"] for x in back} == dict(enumerate(texts))


def test_small_blocks_and_several_parts_give_the_same(spark, vocabulary, monkeypatch):
    """Nearly all units go through the lists of buckets, and by several parts."""
    texts = [" ".join([f"x{n % 7}é-{n}ü", *(f"{w}{'aeiou'[n % 5]}" for w in words(40 + n, n).split())]) + "\n\t\r\0ß" * (n % 3) for n in range(60)]
    for name, value in (("BLOCK_BYTES", 1500), ("LISTED", 3), ("COMMON", 2)):
        monkeypatch.setattr(sentencepieces, name, value)
    encoded = sentencepieces.encode(docs(spark, texts).repartition(3).checkpoint(), vocabulary)
    got = {x["doc_id"]: x["ids"] for x in encoded.collect()}
    for i, t in enumerate(texts):
        assert got[i] == [x for u in sentencepieces._UNITS.findall(" " + t) for x in viterbi(vocabulary, u)], t
    assert {x["doc_id"]: x["text"] for x in sentencepieces.decode(encoded, vocabulary).collect()} == dict(enumerate(texts))


def test_lattice_partitions_are_bounded_by_text(spark, vocabulary, monkeypatch):
    """F1a: the units of much text meet in more partitions than the session's, and the ids stay the same."""
    monkeypatch.setattr(sentencepieces, "LATTICE_BYTES", 1000, raising=False)
    texts = [" ".join(f"unit{i * 300 + j:x}é" for j in range(300)) for i in range(40)]
    encoded = sentencepieces.encode(docs(spark, texts), vocabulary)
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert re.search(rf"hashpartitioning\(part#\d+, bucket#\d+, {4 * usual}\)", encoded._jdf.queryExecution().toString())
    for row in encoded.collect():
        text = texts[row["doc_id"]]
        assert row["ids"] == [x for u in sentencepieces._UNITS.findall(" " + text) for x in viterbi(vocabulary, u)]


def test_runs_are_spread_in_narrow_numbers():
    """F1a: positions take four bytes where that is enough; empty runs and no runs are fine."""
    values, starts, sizes = np.arange(50, dtype=np.int32), np.array([7, 0, 49, 20]), np.array([3, 0, 1, 5])
    assert sentencepieces._spread(values, starts, sizes).tolist() == [7, 8, 9, 49, 20, 21, 22, 23, 24]
    assert sentencepieces._spread(values[:0], starts[:0], sizes[:0]).tolist() == []


# ---- 6


def simhash(text):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def linked(marks, distance=2):
    parent = {m: m for m in marks}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = list(parent)
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                parent[root(a)] = root(b)
    return root


@pytest.mark.parametrize("seed", range(4))
def test_stars_match_union_find(spark, seed):
    r = np.random.default_rng(seed)
    chain = [(i, i + 1) for i in range(40)]
    edges = [[(5, 5)], chain, [(9, 1), (1, 9), (9, 1), (9, 4), (3, 2)], [tuple(map(int, e)) for e in r.integers(-80, 80, (90, 2))]][seed]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    df = spark.createDataFrame(edges, "a long, b long")
    assert sorted(map(tuple, simhash_dedup.stars(df).collect())) == sorted((n, find(n)) for n in root if find(n) != n)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert sorted(map(tuple, simhash_dedup.components(df).collect())) == sorted((n, find(n)) for n in linked)


def test_simhash_components(spark, awkward):
    base = words(400, 5).split()
    near = []
    for i in range(60):
        t = list(base)
        t[i * 6] = "changed"
        near.append(" ".join(t))
    df, texts = awkward
    more = docs(spark, near, list(range(100, 160)))
    rows = simhash_dedup.near_duplicates(df.union(more)).collect()
    text_of = {}
    for r in df.union(more).collect():
        text_of.setdefault(r["doc_id"], []).append(simhash(r["text"]))
    root = linked({m for ms in text_of.values() for m in ms})
    groups = {}
    for k, ms in text_of.items():
        for m in ms:
            groups.setdefault(root(m), set()).add(k)
    for r in rows:
        mark = r["fingerprint"] & (1 << 64) - 1
        assert mark in text_of[r["doc_id"]]
        assert r["component_id"] == min((k for k in groups[root(mark)] if k is not None), default=None)
    kept = [r["doc_id"] for r in simhash_dedup.keep_one(df.union(more)).collect()]
    assert sorted(x for x in kept if x is not None) == sorted({min(k for k in g if k is not None) for g in groups.values() if g - {None}})
    assert simhash_dedup.near_duplicates(docs(spark, [])).isEmpty()


def test_simhash_links_are_complete(spark):
    r = np.random.default_rng(3)
    marks = {int(x) for x in r.integers(-(1 << 63), 1 << 63, 300, dtype=np.int64)}
    for m in list(marks)[:150]:
        a, b = r.choice(64, 2, replace=False)
        u = (m & (1 << 64) - 1) ^ (1 << int(a)) ^ (1 << int(b))
        marks.add(u - (1 << 64) if u >> 63 else u)
    df = spark.createDataFrame([(m,) for m in marks], "fingerprint long")
    got = {(x["a"], x["b"]) for x in simhash_dedup.links(df).collect()}
    own = sorted(marks)
    assert got == {(a, b) for i, a in enumerate(own) for b in own[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}


def test_pipeline_keeps_one_of_near_copies(spark, awkward):
    """The stage against all pairs: edits of 1 to 12 words, a chain, a common passage, repeated rows."""
    import corpus_pipeline

    r = np.random.default_rng(8)
    texts = [words(30, 400 + i, 30) + " " + words(40, 77) for i in range(12)]
    for i in range(40):
        base = words(int(r.integers(6, 300)), 500 + i, 5000).split()
        texts.append(" ".join(base))
        for n in (1, 3, 12):
            t = list(base)
            for at in r.integers(0, len(t), n):
                t[at] = f"x{at}"
            texts.append(" ".join(t))
    chain = words(200, 900, 5000).split()
    texts += [" ".join(chain[3 * i :] + [f"y{j}" for j in range(3 * i)]) for i in range(20)]
    df, _ = awkward
    both = df.union(docs(spark, texts, [int(x) for x in 1000 + r.permutation(len(texts))]))

    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    rows = [(x["doc_id"], shingles(x["text"])) for x in both.collect()]
    own = sorted({s for _, s in rows}, key=len)
    parent = list(range(len(own)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(own):
        for j in range(i):
            if own[j] and 5 * len(a & own[j]) >= 4 * len(a | own[j]):
                parent[root(i)] = root(j)
    at = {s: i for i, s in enumerate(own)}
    least: dict = {}
    for k, s in rows:
        if k is not None:
            g = root(at[s])
            least[g] = min(k, least.get(g, k))
    assert len(least) < len(own) - 60  # there are near copies
    got = [x["doc_id"] for x in corpus_pipeline.drop_near_duplicates(spark, both, "").collect()]
    assert sorted(k for k in got if k is not None) == sorted(least.values())
    assert got.count(None) == sum(k is None for k, _ in rows)
    assert corpus_pipeline.drop_near_duplicates(spark, docs(spark, []), "").isEmpty()


def test_common_shingles_are_counted_in_a_part_of_all_documents(spark, monkeypatch):
    """F1b: with a sample and a list that don't grow, shingles of many sets came first, and their groups grew with the corpus."""
    monkeypatch.setattr(shingle_dedup, "LOOK", 20)
    monkeypatch.setattr(shingle_dedup, "COMMON", 16)
    texts = [" ".join([f"passage{i % 30}word{j}" for j in range(30)] + [f"own{i}word{j}" for j in range(60)]) for i in range(3000)]
    rows = shingle_dedup._prefixes(docs(spark, texts).select("text"), "text")
    most = rows.groupBy("token").agg(F.countDistinct("node").alias("n")).agg(F.max("n")).first()[0]
    assert most == 1 and rows.select("node").distinct().count() == len(texts)


def test_near_copies_are_proposed_by_fingerprint(spark):
    """F8: equal fingerprints and those up to 2 bits apart, each set with one other."""
    marks = {1: 5, 2: 5, 3: 5 ^ 3 << 40, 4: -1, 5: 5 ^ 7 << 40, 6: 1 << 63 ^ -1 ^ -1 << 64}
    nodes = spark.createDataFrame([(n, m if m < 1 << 63 else m - (1 << 64)) for n, m in marks.items()], "node long, mark long")
    got = {(r["a"], r["b"]) for r in shingle_dedup._proposed(nodes).collect()}
    near = {(a, b) for a in marks for b in marks if a < b and ((marks[a] ^ marks[b]) & (1 << 64) - 1).bit_count() <= 2}
    assert got <= near and {(1, 2), (1, 3), (3, 5), (4, 6)} <= got


def test_pairs_are_ruled_out_without_their_sets(spark):
    """Counts never say that sets differ by more than they do, and rule out unlike pairs, whose whole sets then aren't moved."""
    r = np.random.default_rng(4)
    rows, pairs, similar, unlike = [], [], set(), set()
    for i in range(300):
        n = int(r.integers(1, 3000))
        x = r.integers(-(1 << 63), 1 << 63, n, dtype=np.int64)
        y = np.concatenate([x[: int(n * r.choice([0, 0.5, 0.85, 0.9, 1]))], r.integers(-(1 << 63), 1 << 63, int(r.integers(0, n // 5 + 1)), dtype=np.int64)])
        x, y = np.unique(x), np.unique(y)
        both = len(np.intersect1d(x, y))
        assert shingle_dedup.least_apart(shingle_dedup.sketch_of(x), shingle_dedup.sketch_of(y)) <= len(x) + len(y) - 2 * both
        rows += [(2 * i + k, simhash_dedup.simhash_of(own), len(own), shingle_dedup.sketch_of(own)) for k, own in enumerate((x, y))]
        pairs.append((2 * i, 2 * i + 1))
        if both and 5 * both >= 4 * (len(x) + len(y) - both):
            similar.add(pairs[-1])
        elif len(x) > 100 and 2 * both < len(x) + len(y) - both:
            unlike.add(pairs[-1])
    same = np.arange(300, dtype=np.int64) << 20  # all in one bucket: no counts, so nothing is ruled out
    assert shingle_dedup.sketch_of(same) == b"" and shingle_dedup.least_apart(b"", rows[0][3]) == 0
    nodes = spark.createDataFrame(rows, "node long, mark long, size long, sketch binary")
    got = {(x["a"], x["b"]) for x in shingle_dedup._likely(spark.createDataFrame(pairs, "a long, b long"), nodes).collect()}
    assert len(similar) > 50 and len(unlike) > 50
    assert similar <= got and not unlike & got


# ---- 7


def test_repeats_against_brute_force(spark, awkward):
    df, _ = awkward
    shared = words(70, 77)
    more = docs(spark, [words(30, i) + " " + shared + " " + words(9, i) for i in range(20)], list(range(200, 220)))
    both = df.union(more)
    rows = [(r["doc_id"], (r["text"] or "").encode().split()) for r in both.collect()]
    last = 1 << 62
    first: dict = {}
    for k, w in rows:
        for i in range(len(w) - 49):
            x = tuple(w[i : i + 50])
            first[x] = min(first.get(x, last), last if k is None else k)
    want = Counter()
    for k, w in rows:
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < (last if k is None else k):
                gone[i : i + 50] = [True] * 50
        want[k, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)] += 1
    got = substring_dedup.remove_repeats(both).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"].encode()) for r in got) == want
    assert all(sum(s["end"] - s["start"] for s in r["intervals"]) == r["n_removed"] for r in got)
    assert substring_dedup.remove_repeats(docs(spark, [])).isEmpty()


# ---- 8


def test_surrogates(spark):
    texts = [
        "Mail und.34@mail7.example.com or call +1 (487) 555-7209.",
        "Again UND.34@mail7.example.com, card 4111 1111 1111 1111 and 4736962573099581.",
        "Mr. John Smith met Mrs. Anna Smith; later Mr. Smith left. Frau Müller blieb.",
        'token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" from 152.143.123.131, then 152.143.123.131.',
        "IBAN DE89 3704 0044 0532 0130 00, ssn 078-05-1120, Госпожа Иванова.",
        "Nothing here, 12 apples. 3.5 percent, version 1.2.3",
        None,
        "",
    ]
    df = docs(spark, texts)
    got = {r["doc_id"]: r for r in pii_surrogates.replace(df).collect()}
    for value in ("34@mail7", "487) 555", "4111 1111", "4736962573099581", "Smith", "Anna", "Müller", "f3ef4d6b", "152.143", "DE89 3704", "078-05-1120", "Иванова"):
        assert not any(value.lower() in (r["text"] or "").lower() for r in got.values()), value
    a = re.search(r"\S+@\S+\.net", got[0]["text"])[0]
    assert a.lower() in got[1]["text"].lower()  # one address, one surrogate
    assert re.fullmatch(r"Mail [^\W\d]{3}\.\d\d@mail\d{9}\.example\.net or call \+1 \(\d{3}\) \d{3}-\d{4}\.", got[0]["text"])
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4})", got[1]["text"])[1].replace(" ", "")
    assert sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(card))) % 10 == 0
    first, second, third = re.fullmatch(r"Mr\. \w+ (\w+) met Mrs\. \w+na (\w+); later Mr\. (\w+) left\. Frau \w+ blieb\.", got[2]["text"]).groups()
    assert first == second == third
    x, y = re.search(r"from (\S+), then (\S+)\.", got[3]["text"]).groups()
    assert x == y and re.search(r'token = "[0-9a-f]{40}"', got[3]["text"])
    assert re.search(r"Госпожа [А-я]+ов\.", got[4]["text"])
    assert got[5]["text"] == texts[5] and got[5]["_n_entities"] == 0
    assert got[6]["text"] is None and got[7]["text"] == ""
    assert got[0]["_key"] == "x"
    assert pii_surrogates.replace(docs(spark, [])).isEmpty()


def test_secrets_of_any_length(spark):
    r = np.random.default_rng(4)
    runs = ["".join(r.choice(list("abcdefghijkXYZ0123456789_-"), n)) for n in (20, 256, 257, 342, 5000, 100_000)]
    named = "!ab" * 100
    texts = [f"Bearer {x}, end." for x in runs] + [f'password = "{named}" end.', "z" * 300 + " 1"]
    got = [r["text"] for r in pii_surrogates.replace(docs(spark, texts)).orderBy("doc_id").collect()]
    for x, t in zip(runs, got):
        assert x not in t and re.fullmatch(r"Bearer [A-Za-z0-9_-]{%d}, end\." % len(x), t)
    assert named not in got[-2] and len(got[-2]) == len(texts[-2])
    assert got[-1] == texts[-1]


def test_surrogates_stay_distinct(spark):
    # so many three-digit numbers that keyed digits must collide
    rows = spark.range(100, 420).selectExpr("'ssn' as kind", "cast(id as string) as canonical")
    got = pii_surrogates.surrogates(rows, "k").collect()
    fakes = [r["fake"] for r in got]
    assert len(set(fakes)) == 320 and max(r["attempt"] for r in got) > 0
    assert not set(fakes) & {r["canonical"] for r in got}


def test_surrogates_of_crowded_formats(spark):
    """More entities than their formats have surrogates."""
    hot = [f"{c}@one.example.com" for c in "abcdefghijklmnopqrstuvwxyz"]
    secrets = ["******", "------", "!?!?!?", *(f"{c}*****" for c in "abcdefghijklmnopqrstuvwxyz")]
    phones = [f"+{i} 2{i} 34" for i in range(1, 10)]
    texts = [f"Mail {x} now." for x in hot] + [f'password = "{x}" end' for x in secrets] + [f"Call {x}, please" for x in phones]
    got = [r["text"] for r in pii_surrogates.replace(docs(spark, texts)).orderBy("doc_id").collect()]
    assert len(set(got)) == len(texts) and not set(got) & set(texts)
    assert all(re.fullmatch(r"Mail [a-z]+@mail\d{9}\.example\.net now\.", t) for t in got[:26])
    assert not any(x in t for x in secrets[:3] for t in got)
    assert all(re.fullmatch(r"Call \+\d \d\d \d\d, please", t) for t in got[-9:])


def test_numbers_grow_when_all_are_taken(spark):
    rows = spark.range(10).selectExpr("'ssn' as kind", "cast(id as string) as canonical")
    got = pii_surrogates.surrogates(rows, "k").collect()
    assert len({r["fake"] for r in got}) == 10 and all(len(r["fake"]) > 1 for r in got)
    fit = lambda kind, m, fake: spark.sql("select " + pii_surrogates._fitted(f"'{kind}'", f"'{m}'", f"'{fake}'")).first()[0]
    assert fit("phone", "+49 (123) 456 7890", "0987654321") == "+49 (098) 765 4321"
    assert fit("phone", "+49 (123) 456 7890", "098765432177") == "+49 (098) 765 432177"
    assert fit("iban", "DE89 3704 0", "DE12345678") == "DE12 3456 78"


@pytest.mark.parametrize("limit", [1000, 0])
def test_exceptions_are_used(spark, monkeypatch, limit):
    """Names have few first surrogates here, so some are keyed anew; both ways
    of looking exceptions up give the same texts."""
    monkeypatch.setattr(pii_surrogates, "_name", lambda kind, canonical, gender, h, attempt: f"concat('n', substr(translate({h}, 'abcdef', '012345'), 1, 1 + {attempt}))")
    monkeypatch.setattr(pii_surrogates, "BROADCAST_LIMIT", limit)
    names = ["Adam", "Berta", "Carl", "Dora", "Emil", "Fritz", "Gustav", "Hans", "Ida", "Jakob", "Karl", "Ludwig", "Moritz"]
    got = pii_surrogates.replace(docs(spark, [f"Herr {n} kam. Herr {n} ging." for n in names])).collect()
    found = [re.fullmatch(r"Herr (\w+) kam\. Herr (\w+) ging\.", r["text"]).groups() for r in got]
    assert all(a == b for a, b in found) and len({a for a, _ in found}) == len(names)


def test_one_person_has_one_surrogate(spark):
    """Whatever the title, with or without one, and in every document."""
    texts = [
        "Mr. John Smith met Dr. John Smith. John Smith, or Smith, left; John's hat and Smiths stayed.",
        "Prof. John Smith wrote. Mrs. Anna-Lena O'Brien and Anna-Lena read.",
        "Dr. Kim Lee and Ms. Kim Lee. Mx. Kim Lee.",
        "John Smith without a title stays in a text that has none.",
        "Sir John F. Kennedy spoke. Mr. Jean Paul Belmondo, Jean, Paul and Belmondo.",
    ]
    got = [r["text"] for r in pii_surrogates.replace(docs(spark, texts)).orderBy("doc_id").collect()]
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Dr\. (\w+) (\w+)\. (\w+) (\w+), or (\w+), left; (\w+)'s hat and Smiths stayed\.", got[0])
    first, last = {m[i] for i in (1, 3, 5, 8)}, {m[i] for i in (2, 4, 6, 7)}
    assert len(first) == len(last) == 1 and first != last
    m = re.fullmatch(r"Prof\. (\w+) (\w+) wrote\. Mrs\. (\w+) (\w+) and (\w+) read\.", got[1])
    assert {m[1]} == first and {m[2]} == last and m[3] == m[5] and m[3].endswith("na")
    m = re.fullmatch(r"Dr\. (\w+) (\w+) and Ms\. (\w+) (\w+)\. Mx\. (\w+) (\w+)\.", got[2])
    assert m[1] == m[3] == m[5] and m[2] == m[4] == m[6] and m[1].endswith("na")
    assert got[3] == texts[3]
    m = re.fullmatch(r"Sir (\w+) F\. (\w+) spoke\. Mr\. (\w+) (\w+) (\w+), (\w+), (\w+) and (\w+)\.", got[4])
    assert {m[1]} == first and m.groups()[2:5] == m.groups()[5:8] and "Kennedy" not in got[4]


def test_a_corpus_of_known_entities(spark):
    """Nothing leaks, different entities stay different, equal ones equal."""
    r = np.random.default_rng(11)
    digits = lambda n: "".join(map(str, r.integers(0, 10, n)))
    letters = lambda n: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    entities = {
        "email": [f"{letters(3 + i)}.{digits(2)}@{letters(5)}{i % 4}.example.com" for i in range(30)] + ["x" * 90 + "@long.example.org"],
        "phone": [f"+1 ({2 + i % 8}{digits(2)}) {digits(3)}-{digits(4)}" for i in range(30)],
        "ssn": [f"{digits(3)}-{digits(2)}-{digits(4)}" for _ in range(30)],
        "ip": [f"{20 + i}.{r.integers(256)}.{r.integers(256)}.{r.integers(1, 255)}" for i in range(30)],
        "card": [f"4{digits(3)} {digits(4)} {digits(4)} {digits(4)}" for _ in range(30)],
        "secret": [f"{letters(10)}{digits(4)}{letters(10)}" for _ in range(30)],
        "person": [f"Mr. {letters(6).title()} {letters(8).title()}" for _ in range(30)],
    }
    plan, texts = [], []
    for i in range(120):
        own = [(k, v[int(r.integers(len(v)))]) for k, v in entities.items()]
        plan.append(own)
        texts.append(" | ".join(x for _, x in own))
    got = [x["text"].split(" | ") for x in pii_surrogates.replace(docs(spark, texts)).orderBy("doc_id").collect()]
    real = {(k, x) for own in plan for k, x in own}
    to: dict = {}
    for own, new in zip(plan, got):
        assert len(own) == len(new)
        for k, y in zip(own, new):
            assert to.setdefault(k, y) == y
    assert len({(k, y) for (k, _), y in to.items()}) == len(to) and not {(k, y) for (k, _), y in to.items()} & real
    shapes = {"phone": r"\+1 \(\d{3}\) \d{3}-\d{4}", "ssn": r"\d{3}-\d\d-\d{4}", "ip": r"\d+\.\d+\.\d+\.\d+", "card": r"4\d{3}( \d{4}){3}", "secret": r"[a-z]{10}\d{4}[a-z]{10}", "person": r"Mr\. [A-Z][a-z]+n [A-Z][a-z]+r"}
    assert all(re.fullmatch(shapes[k], y) for (k, _), y in to.items() if k in shapes)


def test_names_of_columns_may_clash(spark):
    df = spark.createDataFrame([(1, "Mr. Smith, a@b.com", "1", "2", "3", "4", "5")], "doc_id long, text string, _m string, _x string, _kinds string, _k string, _row string")
    row = pii_surrogates.replace(df).first()
    assert (row["_m"], row["_x"], row["_k"], row["_row"]) == ("1", "2", "4", "5") and row["_kinds"] == ["email", "surname"] and "Smith" not in row["text"]


# ---- 9

PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header>Site</header><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p>One <b>two</b>
 three<p>Four<form><input>Search this</form><p>Five<br>six &eacute;&#233;<ul><li>a1<li>b2</ul><div id="comments"><p>bad comment</p></div></article>
<aside>related</aside><footer>c</footer></body></html>"""


def test_main_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "v", None), (3, "w", ""), (4, None, "plain words only"), (5, "x", "<p>open <b>tags"), (6, "y", "<nav>only menus</nav>"), (1, "u", PAGE)], "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_extraction.extract(pages).collect()), key=repr)
    body = "A & B\nOne two three\nFour\nFive six éé\na1\nb2"
    assert got == sorted([(1, "u", body, len(body))] * 2 + [(2, "v", "", 0), (3, "w", "", 0), (4, None, "plain words only", 16), (5, "x", "open tags", 9), (6, "y", "", 0)], key=repr)
    assert html_extraction.extract(pages.limit(0)).isEmpty()


def test_region_is_the_maximum_subsequence():
    """The scan finds what trying all regions finds."""
    r = np.random.default_rng(7)
    for n in range(40):
        scores = r.integers(-5, 6, n).tolist()
        a, b = html_extraction.best_region(scores)
        assert sum(scores[a:b]) == max([0, *(sum(scores[i:j]) for i in range(n) for j in range(i + 1, n + 1))])


def test_menus_beside_a_body():
    w = {f"hint:{h}": -3.0 for h in html_extraction.HINTS} | {f"tag:{t}": -3.0 for t in html_extraction.BESIDE} | {f"open:{t}": -0.4 for t in html_extraction.BLOCK}
    page = "<div class=menu>x y z x y z</div><div>stray</div>" + "<table><tr><td></td></tr></table>" * 4 + "<div>" + "<p>real text goes on here</p>" * 5 + "</div>" + "<table><tr><td></td></tr></table>" * 4 + "<div>end</div>"
    assert html_extraction.main_text(page, w) == "\n".join(["real text goes on here"] * 5)


def test_names_of_content_are_no_hints(spark):
    """Classes that merely hold a listed word, in pages that hardly show them."""
    plain = "<html><body><nav>a b</nav><article><p>some words here</p></article><footer>c</footer></body></html>"
    pages = spark.createDataFrame([(i, "u", plain) for i in range(20)], "page_id long, url string, html string")
    weights = html_extraction.learn(pages)
    for inner, want in [
        ('<h1 class="entry-header">Title of it</h1><p>Text.</p>', "Title of it\nText."),
        ('<p class="read-more-text">Whole paragraph.</p>', "Whole paragraph."),
        ('<div class="search-results-body"><p>One two.</p><p>Three.</p></div>', "One two.\nThree."),
        ('<div class="post-body">A b c.</div><div class="post-comments"><p>bad</p></div>', "A b c."),
        ('<p>A b c.</p><div class="related-posts">bad</div><ul class="share-buttons"><li>bad</ul><div id=ad-1>bad</div>', "A b c."),
        ('<p>A b c.</p><p class="advert">bad</p><div class="sidebar left">bad</div><form class=x>bad</form>', "A b c."),
        ("<p>5 < 6 and a<b>c</b> &lt;d&gt; <br/> e</p><table><tr><td>x<td>y<tr><td>z</table>", "5 < 6 and ac <d> e\nx\ny\nz"),
    ]:
        page = f"<html><body><nav>menu</nav><article>{inner}</article><footer>end</footer></body></html>"
        assert html_extraction.main_text(page, weights) == want, inner


@pytest.mark.parametrize("piece", ["<div>", "<div class=ad>", '<a title="x>', "<b>", "</i>", "<p><b>", "<!-", "<li>x", "'<a \"", "<td></b>", "<b><div><i></b>"])
def test_broken_pages_take_linear_time(piece):
    import time

    began = time.process_time()
    html_extraction.main_text("<article>word " + piece * (1_000_000 // len(piece)), {"tag:article": 4.0, "hint:ad": -3.0})
    assert time.process_time() - began < 15  # a second or two; quadratic ones take hours


def test_pages_against_a_parser(spark):
    """All pages of the smallest table: what Python's parser finds in the one article."""
    import os
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.depth, self.lines = 0, [""]

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            self.lines.append("") if tag in html_extraction.BLOCK else None
            self.lines[-1] += " " if tag == "br" else ""

        def handle_endtag(self, tag):
            self.depth -= tag == "article"
            self.lines.append("") if tag in html_extraction.BLOCK else None

        def handle_data(self, data):
            self.lines[-1] += data if self.depth else ""

    pages = spark.read.parquet(f"{os.environ.get('TEST_SF_DIR', '/root/testdata/sf0.001')}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(pages).collect()}
    for r in pages.collect():
        parser = Article()
        parser.feed(r["html"])
        parser.close()
        assert got[r["page_id"]] == "\n".join(x for x in (" ".join(x.split()) for x in parser.lines) if x)


# ---- 10


def shingles(w, width):
    return Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def test_contamination_against_brute_force(spark, awkward):
    items = [words(40, 900 + i) for i in range(12)] + ["tiny item", "", None, words(25, 5)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    r = np.random.default_rng(4)
    texts = []
    for i in range(60):
        own = items[i % 12].split()
        for _ in range(i % 5):
            own[int(r.integers(len(own)))] = "other"
        texts.append(words(50, i) + " " + " ".join(own).upper() + ", " + words(50, i + 7))
    texts += ["a tiny item here", words(300, 3)]
    both = docs(spark, texts, list(range(100, 100 + len(texts)))).union(awkward[0])
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in decontamination.contaminated(both, bench).collect()}
    want = {}
    split = [(i, decontamination.words_of((t or "").encode())) for i, t in enumerate(items)]
    for d in both.collect():
        w = decontamination.words_of((d["text"] or "").encode())[:500]
        for i, own in split:
            if not own or not w:
                continue
            width = min(5, len(own))
            b = shingles(own, width)
            for s in range(max(1, len(w) - len(own) + 1)):
                a = shingles(w[s : s + len(own)], width)
                both_n = sum((a & b).values())
                if a and (sim := both_n / (sum(a.values()) + sum(b.values()) - both_n)) >= 0.8:
                    want[d["doc_id"], i] = max(want.get((d["doc_id"], i), 0), sim)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    kept = {x["doc_id"] for x in decontamination.drop_contaminated(both, bench).collect()}
    assert kept == {x["doc_id"] for x in both.collect()} - {k for k, _ in want}
    assert decontamination.contaminated(docs(spark, []), bench).isEmpty()


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    bench = spark.createDataFrame([(i, words(30, i)) for i in range(8)], "item_id long, text string")
    df = docs(spark, [words(20, 50) + " " + words(30, i) for i in range(8)])
    one = sorted(map(tuple, decontamination.contaminated(df, bench).collect()))
    monkeypatch.setattr(decontamination, "ITEM_BYTES", 200)
    assert sorted(map(tuple, decontamination.contaminated(df, bench).collect())) == one and len(one) == 8


def test_index_guarantees_its_radius():
    index = decontamination._Index([(1, words(40, 1).encode())], 5)
    own, marks, table = index.tables[40]
    r = np.random.default_rng(0)
    for _ in range(300):
        m = int(marks[0])
        for b in r.choice(64, decontamination.RADIUS, replace=False):
            m ^= 1 << int(b)
        blocks = np.array([m], "<u8").view(np.uint8)
        assert any(table[k, blocks[k], 0] for k in range(8))
