"""Filled polygons and point joins against plain even-odd counting."""

import numpy as np
import pytest

from strataflow.operators import polygons

RING = "k long, ring array<struct<x: double, y: double>>"


def odd(rings, x, y):
    n = 0
    for ring in rings:
        ring = [p for p in ring or [] if p[0] is not None and p[1] is not None]
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            n += (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return n % 2 == 1


def rough(n, seed, span=12.0, snap=None):
    """A polygon of random corners, crossing itself, with a hole."""
    r = np.random.default_rng(seed)
    at = r.uniform(-2, span, (n, 2))
    if snap:
        at = np.round(at / snap) * snap
    return [[tuple(map(float, p)) for p in at], [tuple(map(float, p)) for p in at[: n // 2] * 0.5]]


SHAPES = {
    1: rough(9, 1),
    2: rough(14, 2, snap=0.25),  # corners on centres and borders of cells
    3: [[(1.0, 1.0), (9.0, 1.0), (9.0, 9.0), (1.0, 9.0), (1.0, 1.0)], [(3.0, 3.0), (6.0, 3.0), (6.0, 6.0), (3.0, 6.0)]],  # closed, with a hole
    4: [[(1.0, 2.0), (5.0, 2.0), (3.0, 2.0)]],  # no extent
    5: [None, [], [(1.0, 1.0)], [(2.0, 2.0), (None, 5.0), (2.0, 8.0), (8.0, 8.0), (8.0, 2.0)]],
    6: [[(100.0, 100.0), (101.0, 100.0), (101.0, 101.0)]],  # off the grid
    None: [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]],
}


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(k, ring) for k, rings in SHAPES.items() for ring in rings]
    return polygons.edges(spark.createDataFrame(rows, RING), ["k"]).cache()


@pytest.mark.parametrize("size, rows, cols", [(0.5, 20, 24), (0.25, 41, 39), (1.3, 8, 9)])
def test_fill(lines, size, rows, cols):
    got = {(x["k"], x["r"], x["c"]) for x in polygons.fill(lines, ["k"], x0=0.0, y0=10.0, dx=size, dy=size, rows=rows, cols=cols).collect()}
    want = {(k, r, c) for k, rings in SHAPES.items() for r in range(rows) for c in range(cols) if odd(rings, 0.0 + (c + 0.5) * size, 10.0 - (r + 0.5) * size)}
    assert {x for x in want if x[0] is not None} == {x for x in got if x[0] is not None}
    assert {x[0] for x in got} >= {1, 2, 3, 5} and not {x[0] for x in got} & {4, 6}
    assert got == want


@pytest.mark.parametrize("tile", [1.0, 0.7, 50.0])
def test_locate(spark, lines, tile):
    r = np.random.default_rng(7)
    spots = [(i, float(x), float(y)) for i, (x, y) in enumerate(r.uniform(-1, 12, (300, 2)))] + [(900, 2.0, 2.0), (901, 4.5, 4.5), (902, None, 1.0)]
    spots += [(1000 + i, float(x), float(y)) for i, (x, y) in enumerate(np.round(r.uniform(0, 10, (100, 2)) * 4) / 4)]
    points = spark.createDataFrame(spots, "id long, x double, y double")
    got = sorted((x["id"], x["k"]) for x in polygons.locate(points, lines.where("k is not null"), ["k"], ["id"], tile).collect())
    assert got == sorted((i, k) for i, x, y in spots if x is not None for k, rings in SHAPES.items() if k is not None and odd(rings, x, y))


def test_of_nothing(spark, lines):
    none = lines.where("false")
    assert polygons.fill(none, ["k"], x0=0.0, y0=1.0, dx=1.0, dy=1.0, rows=1, cols=1).isEmpty()
    assert polygons.locate(spark.createDataFrame([(1, 1.0, 1.0)], "id long, x double, y double"), none, ["k"], ["id"]).isEmpty()


def test_long_bands_go_by_pieces_and_nothing_is_broadcast(spark, lines, capsys):
    """Estimates of exploded rows are too small: edges were broadcast whole."""
    spots = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.random.default_rng(3).uniform(-1, 12, (200, 2)))]
    points = spark.createDataFrame(spots + spots[:5], "id long, x double, y double")
    made = polygons.edges(spark.range(50).selectExpr("id as k", "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 9D, 'y', 0D), named_struct('x', 0D, 'y', 9D)) as ring"), ["k"])
    polygons.locate(points, made, ["k"], ["id"]).explain()
    assert "Broadcast" not in capsys.readouterr().out
    got = sorted((x["id"], x["k"]) for x in polygons.locate(points, lines.where("k is not null"), ["k"], ["id"], 4.0, 3).collect())
    assert got == sorted((i, k) for i, x, y in spots for k, rings in SHAPES.items() if k is not None and odd(rings, x, y))


def test_places_and_shapes_meet_once(spark, tmp_path, monkeypatch):
    """800 customers of one shape and 600 suppliers of one place: one pair is tested, not 480,000."""
    import duckdb

    import __spark_entry__

    duckdb.sql(f"copy (select 1 + range * 84448 as c_custkey from range(800) union all select null union all select 2) to '{tmp_path}/customer.parquet'")
    duckdb.sql(f"copy (select 4941 + range * 51968 as s_suppkey from range(600) union all select range from range(900)) to '{tmp_path}/supplier.parquet'")
    seen = []

    def locate(points, lines, keys, own, real=polygons.locate):
        seen.append((points.count(), lines.select(*keys).distinct().count()))
        return real(points, lines, keys, own)

    monkeypatch.setattr(polygons, "locate", locate)
    got = __spark_entry__.queries()["polygon_join"](spark, str(tmp_path)).collect()
    assert seen == [(901, 2)]
    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    rel = con.sql(__spark_entry__.oracle_sql()["polygon_join"])
    want = sorted(dict(zip(rel.columns, x))["k"] * 10**9 + dict(zip(rel.columns, x))["id"] for x in rel.fetchall())
    assert len(want) > 480_000 and sorted(x["k"] * 10**9 + x["id"] for x in got) == want


def test_many_alike_go_by_pieces(spark):
    rows = polygons.alike(spark.range(25).selectExpr("id", "id % 2 as a", "array(id % 2 + 0.5D) as b"), ["a", "b"], "id", "name", "all", 5).collect()
    assert sorted(i for x in rows for i in x["all"]) == list(range(25)) and {len(x["all"]) for x in rows} <= {5, 3, 2}
    assert all(x["name"] == min(x["all"]) and {i % 2 for i in x["all"]} == {x["a"]} for x in rows) and len(rows) == 6
