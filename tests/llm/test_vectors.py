"""Vector codes and hard negatives against brute force in Python's own whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from strataflow.llm import hard_negatives, integer_vectors, product_codes
from strataflow.llm.product_codes import Settings
from strataflow.llm.queries import queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, code string, _key string, n long, part long"


def table(spark, rows, split=3):
    return spark.createDataFrame([(k, v, l, "x", "y", 1, 2) for k, v, l in rows], SCHEMA).repartition(split)


def vectors(n, dim, seed=0, labels=4, spread=0.2):
    r = np.random.default_rng(seed)
    out = [(i, [float(np.float32(x)) for x in r.normal(0, spread, dim)], int(r.integers(0, labels))) for i in range(n)]
    for i in range(0, n - 1, 11):  # copies
        out[i + 1] = (i + 1, out[i][1], out[i + 1][2])
    return out


BAD = [(1000, None, 1), (1001, [0.1, None] * 4, 1), (1002, [float("nan")] * 8, 2), (1003, [float("inf"), *[0.0] * 7], None)]


def usable(rows, scale):
    good = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    return [(k, [math.floor(scale * x) for x in v], l) for k, v, l in good]


# ---- 12


def codes(rows, s=Settings()):
    """Codes, errors and codebooks, one vector and one entry at a time."""
    kept = usable(rows, s.scale)
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[: s.entries]
    size = len(kept[0][1]) // s.parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for _, v, _ in order] for p in range(s.parts)]

    def assigned(v, p):
        away = [sum((a - b) ** 2 for a, b in zip(cut(v, p), e)) for e in books[p]]
        return away.index(min(away)), min(away)

    for _ in range(s.rounds):
        new = []
        for p in range(s.parts):
            own: dict = {}
            for _, v, _ in kept:
                own.setdefault(assigned(v, p)[0], []).append(cut(v, p))
            new.append([[sum(c) // len(own[e]) for c in zip(*own[e])] if e in own else books[p][e] for e in range(len(books[p]))])
        books = new
    out = []
    for k, v, l in kept:
        got = [assigned(v, p) for p in range(s.parts)]
        out.append((k, l, "".join(f"{e:02x}" for e, _ in got), sum(d for _, d in got)))
    totals: dict = {}
    for _, l, _, d in out:
        totals[l] = totals.get(l, 0) + d
    text = ",".join(str(x) for b in books for e in b for x in e)
    return sorted(((k, l, c, d, totals[l]) for k, l, c, d in out), key=str), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("case", ["many", "few", "ties", "awkward"])
def test_codes(spark, case):
    s = Settings(entries=16) if case != "few" else Settings()
    rows = {
        "many": vectors(400, 16),
        "few": vectors(30, 8),
        "ties": [(i, [float(i % 3), 0.0, 0.0, -1.0], i % 2) for i in range(90)],  # one vector a third of all rows, equal entries
        "awkward": [*vectors(120, 8), *BAD, (7, [0.5] * 8, None), (7, [0.25] * 8, None), (None, [0.1] * 8, 1), (None, [0.2] * 8, None), (5, [3.0] * 8, 1), (5, [3.0] * 8, 1)],
    }[case]
    got, books = product_codes.compress(table(spark, rows), s)
    want, digest = codes(rows, s)
    assert product_codes.digest(books) == digest
    assert sorted(((r["vec_id"], r["label"], r["code"], r["error"], r["label_error"]) for r in got.collect()), key=str) == want


def test_codes_of_nothing_and_of_odd_lengths(spark):
    got, books = product_codes.compress(table(spark, []))
    assert got.isEmpty() and books.size == 0
    assert product_codes.compress(table(spark, BAD))[0].isEmpty()
    assert {r["code"] for r in product_codes.compress(table(spark, [(1, [], 1), (2, [], None)]))[0].collect()} == {"00000000"}
    for rows in ([(1, [1.0, 2.0], 1)], [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [1e30] * 4, 1)]):
        with pytest.raises(Exception, match="parts|lengths|large"):
            product_codes.compress(table(spark, rows, 1))[0].collect()


def test_codes_without_broadcast_labels(spark, monkeypatch):
    monkeypatch.setattr(product_codes, "BROADCAST_LABELS", 0)
    rows = [*vectors(60, 8), (7, [0.5] * 8, None)]
    got, _ = product_codes.compress(table(spark, rows), Settings(entries=8))
    assert sorted(((r["vec_id"], r["label"], r["code"], r["error"], r["label_error"]) for r in got.collect()), key=str) == codes(rows, Settings(entries=8))[0]


def test_blocks_number_every_row(spark):
    rows = vectors(3000, 4)
    got = integer_vectors.blocks(table(spark, rows), 10, key="vec_id", label="label", vector="embedding").collect()
    numbers = [b["first"] + i for b in got for i in range(b["n"])]
    assert len(numbers) == len(set(numbers)) == 3000 and max(b["n"] for b in got) <= integer_vectors.PER_BLOCK
    by = {k: x for b in got for k, x in zip(b["keys"], integer_vectors.numbers_of(b["data"], b["n"], b["dim"]).tolist())}
    assert by == {k: v for k, v, _ in usable(rows, 10)}


def test_codes_query(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    x = np.floor(1024 * np.array([v for _, v, _ in rows], np.float64)).astype(np.int64)
    books = [x[np.argsort([k for k, _, _ in rows])][:256, p * 16 : (p + 1) * 16] for p in range(4)]
    for step in range(5):
        which = []
        for p in range(4):
            part = x[:, p * 16 : (p + 1) * 16]
            away = ((part[:, None, :] - books[p][None]) ** 2).sum(2)
            which.append((away.argmin(1), away.min(1)))
            if step < 4:
                books[p] = np.array([part[which[p][0] == e].sum(0) // (which[p][0] == e).sum() if (which[p][0] == e).any() else books[p][e] for e in range(256)])
    digest = hashlib.sha256(",".join(str(n) for b in books for n in b.reshape(-1).tolist()).encode()).hexdigest()
    want = {k: ("".join(f"{which[p][0][i]:02x}" for p in range(4)), int(sum(which[p][1][i] for p in range(4)))) for i, (k, _, _) in enumerate(rows)}
    got = queries()["op12_vector_codes"](spark, SF).collect()
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == want and {r["codebooks_sha256"] for r in got} == {digest}
    for label in {r["label"] for r in got}:
        assert {r["label_error"] for r in got if r["label"] == label} == {sum(r["error"] for r in got if r["label"] == label)}


# ---- 11


def mined(rows, is_anchor, s):
    """Every pair's score, in Python's whole numbers; rows are told apart by place."""
    kept = [r for r in usable(rows, s.scale) if r[2] is not None]
    order = lambda k: (k is None, k or 0)
    out = []
    for i, (k, v, l) in enumerate(kept):
        if k is None or not is_anchor(k):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), order(q), q, m, j) for j, (q, w, m) in enumerate(kept)]
        same = sorted(x for x in scored if x[3] == l and x[4] != i)[: s.positives]
        rest = sorted(x for x in scored if x[3] != l)
        for p in same:
            fits = [x for x in rest if s.low * -p[0] <= 100 * -x[0] <= s.high * -p[0]][: s.negatives]
            out += [(k, p[2], r + 1, x[2], -p[0], -x[0]) for r, x in enumerate(fits)]
    return sorted(out, key=str)


def rows_of(df):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


@pytest.mark.parametrize("case", ["many", "cells", "hot", "wide", "ties", "awkward"])
def test_negatives(spark, case):
    s = hard_negatives.Settings()
    rows, step = vectors(700, 16, 1), 20
    if case == "cells":  # several blocks of anchors and stripes of rows
        s = hard_negatives.Settings(anchors=9, rows=100)
    elif case == "hot":  # one label has two thirds, one vector a third of all rows
        rows = [(k, rows[0][1] if k % 3 == 0 else v, 0 if k % 3 else l) for k, v, l in rows]
    elif case == "wide":  # components beyond 16 bits
        rows = [(k, [float(np.float32(3e4 * x)) for x in v], l) for k, v, l in rows]
    elif case == "ties":
        rows = [(i, [float(i % 2), 1.0, 0.5, 0.0], i % 3) for i in range(200)]
    elif case == "awkward":
        again = [(20, rows[20][1], rows[20][2]), (20, rows[21][1], 9), (40, [-0.5] * 16, 11), (None, rows[3][1], 1), (None, rows[4][1], 2), (60, rows[60][1], None), (41, rows[20][1], rows[20][2])]
        rows = [*vectors(150, 16, 2), *again, *[(k, v and v * 2, l) for k, v, l in BAD], (50, rows[20][1], 77)]
    got = rows_of(hard_negatives.mine(table(spark, rows, 5), F.col("vec_id") % step == 0, s))
    assert got == mined(rows, lambda k: k % step == 0, s) and got


@pytest.mark.parametrize("seed", range(4))
def test_survivors_are_the_pairs_within(seed):
    r = np.random.default_rng(seed)
    size = [40, 300, 5, 2**25][seed]
    a, x = r.integers(-size, size, (30, 12)), r.integers(-size // 2, size, (200, 12))
    full = a @ x.T
    floor, ceiling = np.percentile(full, 80, axis=1).astype(np.int64), np.percentile(full, 95, axis=1).astype(np.int64)
    alive = r.random(full.shape) < 0.8
    i, j, score = hard_negatives.survivors(a, x, int(x.min()), int(x.max()), alive.copy(), floor, ceiling)
    within = alive & (full >= floor[:, None]) & (full <= ceiling[:, None])
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(y.tolist() for y in np.nonzero(within)))) and (full[i, j] == score).all()
    i, j, score = hard_negatives.survivors(a, x, int(x.min()), int(x.max()), alive.copy(), np.full(30, -(1 << 62)), np.full(30, 1 << 62), 5)
    for k in range(30):
        best = np.sort(full[k][alive[k]])[-5]
        assert set(j[i == k].tolist()) >= set(np.flatnonzero(alive[k] & (full[k] >= best)).tolist())


def test_negatives_of_nothing(spark):
    for rows in ([], BAD, [(1, [1.0], 1)], [(20, [1.0], 1)], [(20, [1.0], 1), (21, [1.0], 1)], [(20, [], 1), (21, [], 1)]):
        assert hard_negatives.mine(table(spark, rows, 1), F.col("vec_id") % 20 == 0).isEmpty()
    for bad in ([(20, [1.0], 1), (2, [1.0, 2.0], 1)], [(20, [1e12, 1.0], 1)]):
        with pytest.raises(Exception, match="lengths|large"):
            hard_negatives.mine(table(spark, bad, 1), F.col("vec_id") % 20 == 0).collect()


def test_negatives_query(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rows = [(k, v, (l + 1) % 10 if k % 7 == 0 else l) for k, v, l in rows]
    assert rows_of(queries()["op11_hard_negatives"](spark, SF)) == mined(rows, lambda k: k % 100 == 0, hard_negatives.Settings())
