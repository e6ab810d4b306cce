"""Hand-computable cases and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.functions import formulas as M
from strataflow.operators import choices, drainage, grids, networks
from strataflow.sources import sinks


def grid(spark, n, z):
    rows = [(0, r, c, float(z(r, c))) for r in range(n) for c in range(n)]
    return spark.createDataFrame(rows, "district long, r long, c long, v double")


def as_array(df, value, n):
    out = np.full((n, n), np.nan)
    for x in df.collect():
        out[x["r"], x["c"]] = x[value] if x[value] is not None else np.nan
    return out


def test_slope_of_a_plane(spark):
    s = as_array(grids.slope_aspect(grid(spark, 12, lambda r, c: c), size=10.0), "slope", 12)
    assert np.allclose(s[2:-2, 2:-2], math.degrees(math.atan(0.1)))
    assert np.allclose(as_array(grids.slope_aspect(grid(spark, 8, lambda r, c: 42)), "slope", 8), 0)


def test_blur_matches_numpy(spark):
    rng = np.random.default_rng(1)
    z = rng.integers(0, 100, (9, 9))
    want = np.zeros((9, 9))
    p = np.pad(z, 2, mode="edge")
    for i in range(5):
        for j in range(5):
            want += p[i : i + 9, j : j + 9]
    got = as_array(grids.box_blur(grid(spark, 9, lambda r, c: z[r, c]), radius=2), "blur", 9)
    assert np.allclose(got, want / 25)


def test_distance_is_exact(spark):
    seeds = {(1, 1), (7, 3), (4, 8)}
    df = grid(spark, 10, lambda r, c: (r, c) in seeds).withColumn("s", F.col("v") == 1)
    got = as_array(grids.distance(df, "s"), "dist", 10)
    want = [[min(abs(r - a) + abs(c - b) for a, b in seeds) for c in range(10)] for r in range(10)]
    assert np.array_equal(got, want)


def test_receivers_run_down_a_plane(spark):
    got = {(x["r"], x["c"]): x["recv_r"] for x in grids.receivers(grid(spark, 12, lambda r, c: -2 * r)).collect()}
    assert all(got[r, c] == r + 1 for r in range(1, 10) for c in range(2, 10))


def test_depression_fills_to_its_spill(spark):
    def z(r, c):
        return 2 if (r, c) == (5, 5) else 6 if c == 5 and r < 5 else 10

    got = as_array(drainage.fill_depressions(grid(spark, 11, z)), "filled", 11)
    assert got[5, 5] == 6 and got[3, 1] == 10


def test_accumulation_conserves_weight(spark):
    flow = spark.createDataFrame([(i, None if i == 0 else i - 1 if i % 3 else i // 2, 1) for i in range(200)], "cell long, recv long, w long")
    got = {x["cell"]: x["accum"] for x in networks.accumulate(flow).collect()}
    assert got[0] == 200 and min(got.values()) == 1


def test_flood_fill_follows_a_winding_passage(spark):
    wall = {(r, c) for r in range(1, 9, 2) for c in range(9) if c != (8 if r % 4 == 1 else 0)}
    df = grid(spark, 9, lambda r, c: (r, c) in wall)
    got = {(x["r"], x["c"]) for x in networks.flood_fill(df, "v = 0", "r = 0 and c = 0").collect()}
    assert got == {(r, c) for r in range(9) for c in range(9)} - wall


def test_spaced_maxima(spark):
    df = grid(spark, 10, lambda r, c: r * 10 + c).withColumnRenamed("v", "score")
    got = choices.spaced_maxima(df, 4.0, 5).collect()
    assert (got[0]["r"], got[0]["c"]) == (9, 9)
    assert all((a["r"] - b["r"]) ** 2 + (a["c"] - b["c"]) ** 2 >= 16 for a in got for b in got if a["rank"] < b["rank"])


def test_allocation_keeps_to_capacity(spark):
    demand = spark.createDataFrame([(0, 1, 1, 100, 0, 0), (0, 2, 2, 100, 0, 1), (0, 3, 3, 10, 90, 90)], "district long, id long, turn long, people long, r0 long, c0 long")
    sites = spark.createDataFrame([(0, 7, 120, 1, 1), (0, 8, 30, 2, 2)], "district long, site long, room long, r1 long, c1 long")
    got = sorted((x["id"], x["site"] or 0, x["placed"]) for x in choices.nearest_with_room(demand, sites, 20.0).collect())
    assert got == [(1, 7, 100), (2, 0, 50), (2, 7, 20), (2, 8, 30), (3, 0, 10)]


@pytest.mark.parametrize("low,mid,high,cape,known,want", [(20, 10, 5, 200, True, "quiet"), (90, 90, 90, 300, True, "quiet"), (80, 20, 10, 3000, True, "building"), (80, 80, 80, 3000, True, "deep convection"), (60, 80, 99, 3000, True, "mature system"), (100, 100, 100, 0, False, "deep convection")])
def test_cloud_states(spark, low, mid, high, cape, known, want):
    assert spark.sql(f"select {M.cloud_state(str(low), str(mid), str(high), str(cape), str(known))}").first()[0] == want


@pytest.mark.parametrize("urgency,lead,want", [(70, 6, "ACT"), (70, 40, "PREPARE"), (45, 3, "PREPARE"), (30, 3, "WATCH"), (5, "NULL", "ROUTINE")])
def test_actions(spark, urgency, lead, want):
    assert spark.sql(f"select {M.action(str(urgency), str(lead))}").first()[0] == want


@pytest.mark.parametrize("rp,pop,hazard,want", [(5, 500, "flood", "relocate"), (25, 500, "flood", "protect"), (60, 500, "flood", "regulate"), ("NULL", 500, "flood", "monitor"), (25, 0, "flood", "regulate"), (60, 9, "erosion", "relocate")])
def test_strategies(spark, rp, pop, hazard, want):
    assert spark.sql(f"select {M.strategy(str(rp), str(pop), repr(hazard))}").first()[0] == want


def test_runoff_never_exceeds_rain(spark):
    df = spark.range(300).selectExpr("id as p").crossJoin(spark.range(40, 99, 7).withColumnRenamed("id", "cn"))
    assert df.where(f"{M.runoff('p', 'cn')} > p or {M.runoff('p', 'cn')} < 0").isEmpty()


def test_a_circle_ends_with_a_message(spark, monkeypatch):
    monkeypatch.setattr(networks, "ROUNDS", 3)
    flow = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (3, 1, 1)], "cell long, recv long, w long")
    with pytest.raises(ValueError, match="circle"):
        networks.accumulate(flow)
    with pytest.raises(ValueError, match="circle"):
        networks.outlet(flow, "cell = 99")


def test_png_holds_its_pixels(spark):
    """Read back chunk by chunk; a cell that is missing is transparent."""
    import zlib

    layer = grid(spark, 4, lambda r, c: r * 4 + c).where("v != 5").selectExpr("district", "r", "c", "cast(v * 15 as int) red", "cast(c as int) green", "7 as blue", "255 as alpha")
    data = bytes(sinks.png(layer).first()["png"])
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, found = 8, {}
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        found[data[at + 4 : at + 8]] = data[at + 8 : at + 8 + n]
        assert int.from_bytes(data[at + 8 + n : at + 12 + n], "big") == zlib.crc32(data[at + 4 : at + 8 + n])
        at += 12 + n
    assert list(found) == [b"IHDR", b"IDAT", b"IEND"] and found[b"IHDR"] == bytes((0, 0, 0, 4, 0, 0, 0, 4, 8, 6, 0, 0, 0))
    lines = zlib.decompress(found[b"IDAT"])
    for r in range(4):
        line = lines[r * 17 : r * 17 + 17]
        assert line[0] == 0
        assert [tuple(line[1 + 4 * c : 5 + 4 * c]) for c in range(4)] == [(0, 0, 0, 0) if r * 4 + c == 5 else ((r * 4 + c) * 15, c, 7, 255) for c in range(4)]


def test_board_adds_new_dates_only(spark, tmp_path):
    path = str(tmp_path / "board")
    rows = lambda *x: spark.createDataFrame(list(x), "date string, v long")
    sinks.board(rows(("2024-01-01", 1)), path)
    sinks.board(rows(("2024-01-01", 9), ("2024-01-02", 2)), path)
    assert sorted((str(x["date"]), x["v"]) for x in spark.read.json(path).collect()) == [("2024-01-01", 1), ("2024-01-02", 2)]


def test_board_dates_of_any_kind(spark, tmp_path):
    path = str(tmp_path / "board")
    rows = lambda *x: spark.createDataFrame(list(x), "date string, v long")
    first = rows(("2024-01-01 06:00", 1), (None, 2), ("a/b=c %", 3))
    for _ in range(3):
        sinks.board(first.unionByName(rows(("2024-01-02 18:30", 9))), path)
    got = spark.read.schema("v long, date string").json(path).collect()
    assert sorted(((x["date"], x["v"]) for x in got), key=str) == sorted([("2024-01-01 06:00", 1), (None, 2), ("a/b=c %", 3), ("2024-01-02 18:30", 9)], key=str)


def test_csv_export(spark, tmp_path):
    sinks.csv_export(spark.createDataFrame([(1, "a,b", None), (2, "c", "d")], "i long, x string, y string").coalesce(1), str(tmp_path / "c"))
    lines = next((tmp_path / "c").glob("*.csv")).read_text().splitlines()
    assert lines == ["i,x,y", '1,"a,b",', "2,c,d"]


def test_csv_units_row(spark, tmp_path):
    from strataflow.sources.tables import gauges_csv

    (tmp_path / "t.csv").write_text("SID,LAT,LON\n ,degrees_north,degrees_east\nA,12.5,80\nB,,81\n")
    assert [x["SID"] for x in gauges_csv(spark, str(tmp_path / "t.csv")).collect()] == ["A"]


def test_outlines(spark, tmp_path):
    from strataflow.sources.tables import outlines_json

    (tmp_path / "o.json").write_text('{"features": [{"properties": {"code": "A", "district_code": null}, "geometry": {"type": "Polygon", "coordinates": [[[1, 2], [3, 4], [5, 6], [1, 2]]]}}]}')
    assert len(outlines_json(spark, str(tmp_path / "o.json")).first()["ring"]) == 4
