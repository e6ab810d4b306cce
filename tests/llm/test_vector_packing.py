"""Vector packing: pieces against the tokenizer's own ids, limits, and each
choice against a plain search over all waiting examples."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from strataflow.llm import vector_packing
from strataflow.llm.queries import queries
from strataflow.llm.vector_packing import Limits, Piece, Pool, cuts, pack, whole

SCHEMA = "doc_id long, text string, ids string, start long, _text string, prompt string"


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def table(spark, texts, keys=None, prompts=None):
    n = len(texts)
    return spark.createDataFrame(list(zip(keys or range(n), texts, ["x"] * n, [7] * n, ["y"] * n, prompts or [None] * n)), SCHEMA)


def holds(rows, limits, cut):
    """Sequences gapless and within the limits; gives them."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append(r)
        assert r["length"] > 0 and len(r["ids"]) == 4 * r["length"]
    for own in by.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        n = sum(r["length"] for r in own)
        assert n <= limits.tokens and len(own) <= limits.segments and sum(r["loss"] for r in own) <= limits.loss
        assert {r["padded"] for r in own} == {n if whole(n, limits.tokens) == n else limits.tokens}
        assert not cut or n in (limits.tokens, whole(n, limits.tokens))
    return by


AWKWARD = [None, "", "one", "word " * 3000, "one", " \n\t ", "é ü 日本 \U0001f600", "<|endoftext|> x <|endoftext|>", " " * 1_500_000, "word " * 3000, "a", None]


@pytest.mark.parametrize("limits", [Limits(), Limits(64, 5, 64, 4), Limits(50, 3, 20, 7)])
@pytest.mark.parametrize("cut", [True, False])
def test_every_id_once(spark, limits, cut):
    texts = AWKWARD + [" ".join(f"w{i * j}" for j in range(i % 97)) for i in range(300)]
    keys = [None, *range(1, len(texts))]
    keys[4] = 2  # equal rows
    t = tokenizer()
    rows = pack(table(spark, texts, keys), limits, cut=cut).collect()
    holds(rows, limits, cut)
    want, got = defaultdict(list), defaultdict(list)
    for k, x in zip(keys, texts):
        want[k].append([*t.encode(x or "", add_special_tokens=False).ids, 0])
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        got[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
        assert r["loss"] == r["length"]
    assert set(want) == set(got)
    for k, pieces in got.items():
        copies = len(want[k])
        assert sorted(i for _, ids, _ in pieces for i in ids) == sorted(i for w in want[k] for i in w)
        for start, ids, total in pieces:
            assert total == len(want[k][0]) and ids == want[k][0][start : start + len(ids)]
        covered = sorted(i for start, ids, _ in pieces for i in range(start, start + len(ids)))
        assert covered == sorted(list(range(len(want[k][0]))) * copies)


def test_prompts_bear_no_loss(spark):
    r = np.random.default_rng(3)
    said = [" ".join(["yes"] * int(n)) for n in r.integers(0, 300, 200)]
    asked = [None if i % 9 == 0 else " ".join(["why"] * int(n)) for i, n in enumerate(r.integers(0, 300, 200))]
    limits, t = Limits(256, 6, 100), tokenizer()
    rows = pack(table(spark, said, prompts=asked), limits, prompt="prompt").collect()
    holds(rows, limits, True)
    for i, (a, b) in enumerate(zip(asked, said)):
        own = [x for x in rows if x["doc_id"] == i]
        silent = len(t.encode(a or "", add_special_tokens=False).ids)
        assert sum(x["length"] for x in own) == silent + len(t.encode(b, add_special_tokens=False).ids) + 1
        for x in own:
            assert x["loss"] == max(0, x["start"] + x["length"] - max(silent, x["start"]))


def test_the_largest_dot_product_is_chosen():
    r = np.random.default_rng(5)
    limits = Limits(100, 4, 60)
    pool, plain = Pool(limits), []
    for i in range(300):
        n = int(r.integers(1, 100))
        for p in cuts(Piece(i, n, 0, np.zeros(n, np.uint32), int(r.integers(0, n + 1))), limits):
            pool.add(p)
            plain.append((len(p.ids), p.loss))
    while pool.n:
        got, room, segments = pool.sequence(False), [limits.tokens, limits.loss], limits.segments
        for p in got:
            demand = (len(p.ids), p.loss)
            mean = np.array(plain).sum(0) / np.array([limits.tokens, limits.loss])
            dots = {d: sum(m * d[j] / s * room[j] / s for j, (m, s) in enumerate(zip(mean, (limits.tokens, limits.loss)))) for d in plain if d[0] <= room[0] and d[1] <= room[1]}
            assert dots[demand] == pytest.approx(max(dots.values()))
            plain.remove(demand)
            room, segments = [room[0] - demand[0], room[1] - demand[1]], segments - 1
        assert not segments or not any(d[0] <= room[0] and d[1] <= room[1] for d in plain)
    assert not plain


def test_ids_of_every_class_of_character():
    """The ranks give the tokenizer's own ids, one probe a code point of the first planes."""
    t, encode = tokenizer(), vector_packing.encoder()
    for c in [*range(0, 0xD800, 7), *range(0xE000, 0x20000, 23)]:
        ch = chr(c)
        x = f"a{ch}1{ch} {ch}b{ch}{ch}  {ch}.{ch}'s{ch}"
        assert encode(x).tolist() == t.encode(x, add_special_tokens=False).ids


def test_of_nothing(spark):
    assert pack(table(spark, [])).isEmpty()
    assert [r["length"] for r in pack(table(spark, [None])).collect()] == [1]
    with pytest.raises(ValueError):
        Limits(tokens=0)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    t = tokenizer()
    rows = queries()["op13_vector_packing"](spark, sf).orderBy("doc_id", "start").collect()
    own = defaultdict(list)
    for r in rows:
        own[r["doc_id"]].append(r)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(own) == len(docs)
    for d in docs:
        ids, at = np.array([*t.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for r in own[d["doc_id"]]:
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    length, segments = defaultdict(int), defaultdict(set)
    for r in rows:
        length[r["sequence_id"]] += r["length"]
        segments[r["sequence_id"]] |= set(range(r["offset"], r["offset"] + r["length"]))
    assert all(segments[s] == set(range(n)) and n <= 1024 and n & (n - 1) == 0 for s, n in length.items())
