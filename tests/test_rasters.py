"""Raster files: what is written reads back, boxes read only their blocks,
reprojection against numpy."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

from strataflow.sources import rasters


@pytest.fixture
def session(spark):
    rasters.register(spark)
    return spark


def cells(spark, *grids):
    rows = [(d, r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for d, z in enumerate(grids) for r in range(z.shape[0]) for c in range(z.shape[1])]
    return spark.createDataFrame(rows, "district long, r long, c long, v double")


def rough(shape, seed, holes=0.1):
    r = np.random.default_rng(seed)
    z = r.normal(0, 100, shape)
    z[r.random(shape) < holes] = np.nan
    return z


def test_what_is_written_reads_back(session, tmp_path):
    grids = [rough((70, 45), 1), rough((20, 33), 2), np.full((3, 3), 5.0)]
    done = rasters.write(cells(session, *grids), f"file:{tmp_path}/a", x0="100 * district", y0="50 - district", dx=0.25, dy=0.5, side=32, block=16).collect()
    assert sum(x["cells"] for x in done) == sum((~np.isnan(z)).sum() for z in grids) and len(done) == 6 + 2 + 1
    got = {(x["x"], x["y"]): x["value"] for x in session.read.format("raster").load(f"file:{tmp_path}/a").collect()}
    want = {(100 * d + (c + 0.5) * 0.25, 50 - d - (r + 0.5) * 0.5): z[r, c] for d, z in enumerate(grids) for r, c in zip(*np.nonzero(~np.isnan(z)))}
    assert got == want
    again = rasters.write(cells(session, *grids), f"file:{tmp_path}/a", x0="100 * district", y0="50 - district", dx=0.25, dy=0.5, side=32, block=16)
    assert again.count() == 9 and session.read.format("raster").load(str(tmp_path / "a")).count() == len(want)


def test_a_box_reads_only_its_blocks(session, tmp_path):
    rasters.write(cells(session, rough((64, 64), 3, 0)), f"{tmp_path}/a", x0="0", y0="64", dx=1, dy=1, side=64, block=16).collect()
    reader = rasters.RasterReader({"path": f"{tmp_path}/a"})
    filters = [GreaterThan(("x",), 20.0), LessThanOrEqual(("x",), 40.0), EqualTo(("y",), 60.5), EqualTo(("value",), 1.0)]
    assert list(reader.pushFilters(filters)) == filters and reader.box == [20.0, 60.5, 40.0, 60.5]
    blocks = reader.partitions()
    assert sorted((b.row, b.col) for b in blocks) == [(0, 16), (0, 32)]
    df = session.read.format("raster").load(f"{tmp_path}/a")
    assert df.rdd.getNumPartitions() == 16
    some = df.where("x > 20 and x <= 40 and y = 60.5")
    assert some.rdd.getNumPartitions() == 2 and some.count() == 20
    assert session.read.format("raster").option("bbox", "0,0,15,15").load(f"{tmp_path}/a").rdd.getNumPartitions() == 1
    assert df.where("x > 1000").isEmpty()


def tiff(z, order, kind, form, bits, compression, predictor, nothing=None, rows=2):
    """A file in strips of ``rows``, by hand."""
    body, at, sizes = b"", [], []
    for r in range(0, z.shape[0], rows):
        part = z[r : r + rows].astype(order + kind)
        if predictor == 2:
            part = np.diff(part, axis=1, prepend=part[:, :1] * 0).astype(order + kind)
        part = part.tobytes()
        part = zlib.compress(part) if compression != 1 else part
        at.append(8 + len(body))
        sizes.append(len(part))
        body += part
    fields = [(256, "H", [z.shape[1]]), (257, "H", [z.shape[0]]), (258, "H", [bits]), (259, "H", [compression]), (273, "I", at), (277, "H", [1]), (278, "H", [rows]), (279, "I", sizes), (317, "H", [predictor]), (339, "H", [form]), (33550, "d", [2.0, 3.0, 0.0]), (33922, "d", [1.0, 1.0, 0.0, 100.0, 50.0, 0.0])]
    if nothing is not None:
        fields.append((42113, "s", nothing))
    codes, directory, rows_, more = {"H": 3, "I": 4, "d": 12, "s": 2}, 8 + len(body), b"", b""
    beyond = directory + 2 + 12 * len(fields) + 4
    for field, k, values in fields:
        data = values if k == "s" else struct.pack(order + k * len(values), *values)
        head = struct.pack(order + "HHI", field, codes[k], len(values))
        if len(data) <= 4:
            rows_ += head + data.ljust(4, b"\0")
        else:
            rows_ += head + struct.pack(order + "I", beyond + len(more))
            more += data
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, directory) + body + struct.pack(order + "H", len(fields)) + rows_ + bytes(4) + more


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("kind, form, bits, compression, predictor", [("i2", 2, 16, 1, 1), ("u1", 1, 8, 8, 2), ("f4", 3, 32, 32946, 1), ("i4", 2, 32, 8, 2)])
def test_strips_of_other_kinds(session, tmp_path, order, kind, form, bits, compression, predictor):
    z = np.random.default_rng(1).integers(0, 100, (5, 7))
    (tmp_path / "a.tif").write_bytes(tiff(z, order, kind, form, bits, compression, predictor, b"42\0"))
    got = {(x["row"], x["col"]): (x["x"], x["y"], x["value"]) for x in session.read.format("raster").load(f"{tmp_path}/a.tif").collect()}
    # the tie point says that cell corner (1, 1) is at (100, 50)
    assert got == {(r, c): (98 + (c + 0.5) * 2, 53 - (r + 0.5) * 3, float(z[r, c])) for r in range(5) for c in range(7) if z[r, c] != 42}


def test_files_that_arent_read(tmp_path):
    (tmp_path / "a.tif").write_bytes(b"no raster at all")
    (tmp_path / "b.tif").write_bytes(tiff(np.ones((2, 2)), "<", "f4", 3, 32, 5, 1))
    for name in "ab":
        with pytest.raises(ValueError):
            rasters.read_header(str(tmp_path / f"{name}.tif"))


def test_reprojection_matches_numpy(session):
    z = rough((12, 15), 5)
    raster = cells(session, z).where("v is not null").selectExpr("(c + 0.5D) * 0.5D as x", "10 - (r + 0.5D) * 0.25D as y", "v as value", "'b' as file")
    over = session.createDataFrame([(0.25, 9.875, 1e6, "c"), (0.75, 9.875, -5.0, "a")], "x double, y double, value double, file string")  # another file's cells
    z[0, 1] = -5.0
    z[0, 0] = 1e6 if np.isnan(z[0, 0]) else z[0, 0]
    r = np.random.default_rng(6)
    spots = [(k, float(x), float(y)) for k, (x, y) in enumerate(zip(r.uniform(-0.5, 8, 200), r.uniform(6.5, 10.5, 200)))] + [(900, 0.25, 9.875), (901, 3.25, 8.125), (902, 500.0, 1.0)]
    got = {x["k"]: x["value"] for x in rasters.bilinear(raster.unionByName(over), session.createDataFrame(spots, "k long, x double, y double"), 0.5, 0.25, ["k"]).collect()}
    assert len(got) == len(spots)
    for k, x, y in spots:
        fc, fr = x / 0.5 - 0.5, (10 - y) / 0.25 - 0.5
        total = weight = 0.0
        for a in (int(np.floor(fr)), int(np.floor(fr)) + 1):
            for b in (int(np.floor(fc)), int(np.floor(fc)) + 1):
                w = (1 - abs(fr - a)) * (1 - abs(fc - b))
                if 0 <= a < 12 and 0 <= b < 15 and not np.isnan(z[a, b]) and w > 1e-12:
                    total, weight = total + w * z[a, b], weight + w
        assert got[k] == (pytest.approx(total / weight) if weight else None)
    assert rasters.bilinear(raster.where("false"), session.createDataFrame(spots, "k long, x double, y double"), 0.5, 0.25, ["k"]).where("value is not null").isEmpty()


def test_many_small_files_and_blocks_go_by_runs(session, tmp_path):
    """A block a task was 144,400 tasks for 1 GB of tables."""
    z = rough((40, 40), 8)
    rasters.write(cells(session, z), f"{tmp_path}/a", x0="0", y0="40", dx=1, dy=1, side=2, block=16).collect()
    df = session.read.format("raster").load(f"{tmp_path}/a")
    assert len(list((tmp_path / "a").iterdir())) > 300 and df.rdd.getNumPartitions() < 200
    got = {(x["y"], x["x"]): x["value"] for x in df.collect()}
    assert got == {(40 - (r + 0.5), c + 0.5): z[r, c] for r, c in zip(*np.nonzero(~np.isnan(z)))}
    box = df.where("x > 10 and x <= 20 and y = 30.5")
    assert {(x["y"], x["x"]) for x in box.collect()} == {p for p in got if p[0] == 30.5 and 10 < p[1] <= 20}
    rasters.write(cells(session, z), f"{tmp_path}/b", x0="0", y0="40", dx=1, dy=1, side=64, block=2).collect()
    one = session.read.format("raster").load(f"{tmp_path}/b")
    assert one.rdd.getNumPartitions() < 200 and {(x["y"], x["x"]): x["value"] for x in one.collect()} == got


def test_targets_meet_cells_by_tiles(session, monkeypatch):
    """Each cell and target is shuffled once, not four rows a target; crowded tiles go in slices."""
    z = rough((30, 30), 9, 0.3)
    raster = cells(session, z).selectExpr("(c - 15 + 0.5D) * 0.5D as x", "(15 - r - 0.5D) * 0.25D as y", "v as value", "'b' as file").withColumn("g", F.lit(1))
    r = np.random.default_rng(4)
    spots = [(1 if k % 10 else None, k, float(x), float(y)) for k, (x, y) in enumerate(zip(r.uniform(-8, 8, 300), r.uniform(-4, 4, 300)))] + [(1, 900, None, 1.0), (2, 901, 1.0, 1.0)]
    target = session.createDataFrame(spots, "g long, k long, x double, y double")
    run = lambda: {(x["g"], x["k"]): x["value"] for x in rasters.bilinear(raster, target, 0.5, 0.25, ["g", "k"], ["g"]).collect()}
    whole = run()
    assert len(whole) == 301 and whole[2, 901] is None and all(v is None for (g, _), v in whole.items() if g is None)
    for g, k, x, y in spots[:300]:
        fc, fr, total, weight = x / 0.5 + 14.5, 14.5 - y / 0.25, 0.0, 0.0
        for a in (int(np.floor(fr)), int(np.floor(fr)) + 1):
            for b in (int(np.floor(fc)), int(np.floor(fc)) + 1):
                if g and 0 <= a < 30 and 0 <= b < 30 and not np.isnan(z[a, b]):
                    w = (1 - abs(fr - a)) * (1 - abs(fc - b))
                    total, weight = total + w * z[a, b], weight + w
        assert whole[g, k] == (pytest.approx(total / weight) if weight else None)
    monkeypatch.setattr(rasters, "TILE", 4)
    monkeypatch.setattr(rasters, "TARGETS", 3)
    sliced = run()
    assert sliced.keys() == whole.keys() and all(v is None and sliced[k] is None or v == pytest.approx(sliced[k]) for k, v in whole.items())
    plan = rasters.bilinear(raster, target, 0.5, 0.25, ["g", "k"], ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan
