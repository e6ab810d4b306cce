"""Raster files as a data source, and bilinear reprojection.

``spark.read.format("raster")`` gives a row a cell of all GeoTIFF files below a
path.  One block of a file, as the file stores it, is one partition, or a run
of blocks where there are many; of many files the small ones are dealt out
whole, and the tasks read their headers.  Bounds on ``x`` and ``y`` are pushed
into the source, so blocks outside them aren't read.  Single bands, stored
plainly or deflated, in strips or blocks.  Paths are what ``pyarrow.fs`` opens:
local, hdfs, s3, gs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

# The format's field numbers and kinds.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PREDICTOR, BLOCK_WIDTH, BLOCK_HEIGHT, BLOCK_AT, BLOCK_BYTES, SAMPLE_FORMAT, SCALE, TIE, NO_DATA = 317, 322, 323, 324, 325, 339, 33550, 33922, 42113
KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
PLAIN, DEFLATED = 1, (8, 32946)
PARTS, PART, BATCH = 64, 1 << 25, 1 << 16  # blocks or files before runs are made, the bytes of a run at most, the cells of a batch
SCHEMA = "file string, row long, col long, x double, y double, value double"


def _open(path: str):
    from pyarrow import fs

    files, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return files, inside


def _listed(path: str) -> list[tuple[str, int]]:
    """The files and their sizes."""
    from pyarrow import fs

    files, inside = _open(path)
    if (info := files.get_file_info(inside)).type == fs.FileType.File:
        return [(path, info.size)]
    head = path[: len(path) - len(inside)] if path.endswith(inside) else "file:"
    found = files.get_file_info(fs.FileSelector(inside, recursive=True))
    return sorted((head + x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.lower().endswith((".tif", ".tiff")))


def read_header(path: str) -> dict:
    """A file's fields by number, and its byte order.  Reads the first
    directory and what it points to, no cells."""
    files, inside = _open(path)
    with files.open_input_file(inside) as f:

        def at(offset: int, size: int) -> bytes:
            f.seek(offset)
            return f.read(size)

        head = at(0, 8)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order is None or struct.unpack(order + "H", head[2:4])[0] != 42:
            raise ValueError(f"{path} is no raster file")
        start = struct.unpack(order + "I", head[4:])[0]
        n = struct.unpack(order + "H", at(start, 2))[0]
        entries, out = at(start + 2, 12 * n), {"order": order}
        for i in range(n):
            field, kind, count = struct.unpack_from(order + "HHI", entries, 12 * i)
            if kind not in KINDS:
                continue
            form = f"{order}{count}s" if kind == 2 else order + KINDS[kind] * count
            size = struct.calcsize(form)
            body = entries[12 * i + 8 : 12 * i + 8 + size] if size <= 4 else at(struct.unpack_from(order + "I", entries, 12 * i + 8)[0], size)
            out[field] = struct.unpack(form, body)
    if SCALE not in out or TIE not in out:
        raise ValueError(f"{path} doesn't say where its cells are")
    if out.get(SAMPLES, (1,))[0] != 1 or out.get(COMPRESSION, (1,))[0] not in (PLAIN, *DEFLATED) or out.get(PREDICTOR, (1,))[0] not in (1, 2):
        raise ValueError(f"{path} has several bands, or a compression that isn't read")
    return out


class Block(InputPartition):
    """A stored block: its place in the file and where its cells are."""

    def __init__(self, file: str, header: dict, offset: int, size: int, row: int, col: int, high: int, wide: int, stride: int):
        self.file, self.offset, self.size, self.row, self.col, self.high, self.wide, self.stride = file, offset, size, row, col, high, wide, stride
        form = {1: "u", 2: "i", 3: "f"}[header.get(SAMPLE_FORMAT, (1,))[0]]
        self.kind = f"{header['order']}{form}{header[BITS][0] // 8}"
        self.deflated = header.get(COMPRESSION, (1,))[0] in DEFLATED
        self.differences = header.get(PREDICTOR, (1,))[0] == 2
        (self.dx, self.dy), (i, j, _, x, y) = header[SCALE][:2], header[TIE][:5]
        self.x0, self.y0 = x - i * self.dx, y + j * self.dy
        text = b"".join(header.get(NO_DATA, ())).strip(b"\0 ")
        self.nothing = float(text) if text else None

    def within(self, box: tuple[float, float, float, float]) -> bool:
        """Whether a cell's centre may be inside ``x0, y0, x1, y1``."""
        left, top = self.x0 + (self.col + 0.5) * self.dx, self.y0 - (self.row + 0.5) * self.dy
        return left <= box[2] and left + (self.wide - 1) * self.dx >= box[0] and top >= box[1] and top - (self.high - 1) * self.dy <= box[3]

    def read(self, f):
        """Its cells as an array of doubles, from its open file; NaN where there is nothing."""
        import numpy as np

        f.seek(self.offset)
        body = f.read(self.size)
        cells = np.frombuffer(zlib.decompress(body) if self.deflated else body, self.kind)
        cells = cells[: len(cells) // self.stride * self.stride].reshape(-1, self.stride)[: self.high]
        if self.differences:
            cells = np.cumsum(cells, axis=1, dtype=cells.dtype)
        cells = cells[:, : self.wide].astype(float)
        return cells if self.nothing is None else np.where(cells == self.nothing, np.nan, cells)


def blocks_of(path: str) -> list[Block]:
    header = read_header(path)
    width, height = header[WIDTH][0], header[HEIGHT][0]
    if BLOCK_AT in header:
        wide, high, at, sizes = header[BLOCK_WIDTH][0], header[BLOCK_HEIGHT][0], header[BLOCK_AT], header[BLOCK_BYTES]
    else:
        wide, high, at, sizes = width, header.get(STRIP_ROWS, (height,))[0], header[STRIP_AT], header[STRIP_BYTES]
    across = -(-width // wide)
    out = []
    for k, (offset, size) in enumerate(zip(at, sizes)):
        row, col = k // across * high, k % across * wide
        if size:  # a block of size 0 was never written
            out.append(Block(path, header, offset, size, row, col, min(high, height - row), min(wide, width - col), wide))
    return out


class Run(InputPartition):
    """Several blocks, or whole files, whose headers its task reads."""

    def __init__(self, items: list):
        self.items = items


def runs(items: list, sizes: list[int]) -> list[Run]:
    """The items in order in about ``PARTS`` runs of even size, or in more where these were above ``PART`` bytes."""
    most, out, held = min(PART, sum(sizes) / PARTS), [], 0
    for item, size in zip(items, sizes):
        if not out or held + size > most:
            out.append(Run([]))
            held = 0
        out[-1].items.append(item)
        held += size
    return out


class RasterReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.box = [float(x) for x in options.get("bbox", "-inf,-inf,inf,inf").split(",")]

    def pushFilters(self, filters) -> Iterator:
        """Bounds on x and y narrow the box; Spark applies all filters itself, too."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in ("x", "y") and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.value is not None:
                low, high = ("x", "y").index(name), ("x", "y").index(name) + 2
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.box[low] = max(self.box[low], float(f.value))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.box[high] = min(self.box[high], float(f.value))
            yield f

    def blocks(self, path: str) -> list[Block]:
        return [b for b in blocks_of(path) if b.within(tuple(self.box))]

    def partitions(self):
        files = _listed(self.path)
        whole = [x for x in files if x[1] <= PART] if len(files) > PARTS else []
        rest = sorted({x for x, _ in files} - {x for x, _ in whole})
        with ThreadPoolExecutor(16) as pool:
            found = [b for blocks in pool.map(self.blocks, rest) for b in blocks]
        if len(found) > PARTS:
            found = runs(found, [b.size for b in found])
        if whole:
            found += runs(*map(list, zip(*whole)))
        return found or [InputPartition(None)]

    def read(self, part):
        import numpy as np
        import pyarrow as pa

        items = part.items if isinstance(part, Run) else [part] if isinstance(part, Block) else []

        def batch():
            columns = [np.concatenate(x) for x in zip(*held)]
            names = pa.concat_arrays([pa.repeat(pa.scalar(file, pa.string()), n) for file, n in zip(named, map(len, next(zip(*held))))])
            return pa.record_batch([names, *map(pa.array, columns)], ["file", "row", "col", "x", "y", "value"])

        held, named, n = [], [], 0
        for path, blocks in groupby(items, lambda x: x.file if isinstance(x, Block) else x):
            blocks = [b for x in blocks for b in ([x] if isinstance(x, Block) else self.blocks(x))]
            if not blocks:
                continue
            files, inside = _open(path)
            with files.open_input_file(inside) as f:
                for block in blocks:
                    cells = block.read(f)
                    r, c = np.nonzero(~np.isnan(cells))
                    row, col = r + block.row, c + block.col
                    held.append((row, col, block.x0 + (col + 0.5) * block.dx, block.y0 - (row + 0.5) * block.dy, cells[r, c]))
                    named.append(path)
                    n += len(r)
                    if n >= BATCH:
                        yield batch()
                        held, named, n = [], [], 0
        if n:
            yield batch()


class RasterSource(DataSource):
    """Options: ``path``, a file or folder; ``bbox``, "x0,y0,x1,y1"."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes ``raster`` known to the session and lets it take filters."""
    spark.dataSource.register(RasterSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def encode(cells, x0: float, y0: float, dx: float, dy: float, block: int = 64) -> bytes:
    """A GeoTIFF file of an array of doubles, deflated in blocks, NaN for nothing."""
    import numpy as np

    high, wide = cells.shape
    down, across = -(-high // block), -(-wide // block)
    padded = np.full((down * block, across * block), np.nan, "<f8")
    padded[:high, :wide] = cells
    bodies = [zlib.compress(padded[i * block : (i + 1) * block, j * block : (j + 1) * block].tobytes()) for i in range(down) for j in range(across)]
    starts = [8 + sum(map(len, bodies[:k])) for k in range(len(bodies))]
    fields = [
        (WIDTH, 4, (wide,)), (HEIGHT, 4, (high,)), (BITS, 3, (64,)), (COMPRESSION, 3, (8,)), (PHOTOMETRIC, 3, (1,)), (SAMPLES, 3, (1,)), (BLOCK_WIDTH, 4, (block,)), (BLOCK_HEIGHT, 4, (block,)),
        (BLOCK_AT, 4, starts), (BLOCK_BYTES, 4, [len(b) for b in bodies]), (SAMPLE_FORMAT, 3, (3,)), (SCALE, 12, (dx, dy, 0.0)), (TIE, 12, (0.0, 0.0, 0.0, x0, y0, 0.0)), (NO_DATA, 2, b"nan\0"),
    ]
    directory = 8 + sum(map(len, bodies))
    beyond, rows, more = directory + 2 + 12 * len(fields) + 4, b"", b""
    for field, kind, values in fields:
        body = values if kind == 2 else struct.pack("<" + KINDS[kind] * len(values), *values)
        if len(body) > 4:
            rows += struct.pack("<HHII", field, kind, len(values), beyond + len(more))
            more += body
        else:
            rows += struct.pack("<HHI", field, kind, len(values)) + body.ljust(4, b"\0")
    return b"II" + struct.pack("<HI", 42, directory) + b"".join(bodies) + struct.pack("<H", len(fields)) + rows + struct.pack("<I", 0) + more


def write(cells: DataFrame, path: str, *, x0: str, y0: str, dx: float, dy: float, value: str = "v", side: int = 512, block: int = 64) -> DataFrame:
    """One GeoTIFF file a square of ``side`` cells of each district; gives
    ``file, cells``, what was written.

    ``x0`` and ``y0`` are expressions over ``district`` for the upper left
    corner of its grid.  Cells that aren't there, and nulls, are nothing.  A
    file is written beside its place and then moved there, so a task that is
    run again replaces it whole.
    """

    def save(table):
        import numpy as np
        import pyarrow as pa

        first = {k: table[k][0].as_py() for k in ("district", "tr", "tc", "x0", "y0")}
        r, c = table["r"].to_numpy() - first["tr"] * side, table["c"].to_numpy() - first["tc"] * side
        out = np.full((int(r.max()) + 1, int(c.max()) + 1), np.nan)
        out[r, c] = table["v"].to_numpy(zero_copy_only=False)
        body = encode(out, first["x0"] + first["tc"] * side * dx, first["y0"] - first["tr"] * side * dy, dx, dy, block)
        name = f"{path}/{first['district']}-{first['tr']}-{first['tc']}"
        files, inside = _open(f"{name}.tif")
        files.create_dir(inside.rpartition("/")[0])
        aside = f"{inside}.{np.random.default_rng().integers(1 << 60)}.part"
        with files.open_output_stream(aside) as f:
            f.write(body)
        files.move(aside, inside)
        return pa.table({"file": pa.array([f"{name}.tif"]), "cells": pa.array([int((~np.isnan(out)).sum())], pa.int64())})

    placed = cells.select("district", "r", "c", F.col(value).cast("double").alias("v"), F.expr(x0).cast("double").alias("x0"), F.expr(y0).cast("double").alias("y0"))
    squares = placed.withColumn("tr", F.floor(F.col("r") / side)).withColumn("tc", F.floor(F.col("c") / side))
    return squares.groupBy("district", "tr", "tc").applyInArrow(save, "file string, cells long")


TILE, TARGETS = 128, 1 << 18  # rows and columns of the lattice that meet at once, and their targets at most


def bilinear(raster: DataFrame, target: DataFrame, dx: float, dy: float, keys: list[str], within: list[str] = []) -> DataFrame:
    """``keys, value``: each target from the four cells around its ``x, y``,
    weighted by nearness.

    ``raster``: x, y (cells' centres on one lattice of spacing ``dx, dy`` with a
    corner at 0, 0), value, file; where files overlap the first by name counts.
    Columns ``within``, of the keys and of ``raster``, part the grids: a target
    takes only cells of its own, whatever else lies over them.
    Cells without a value give their weight to the others; a target without
    any has a null.  Cells and targets meet by tiles of the lattice, a cell on
    a border in each tile beside it, the targets of a crowded tile in slices;
    neither side is held whole anywhere.
    """
    spot = lambda at, size: F.col(at) / F.lit(size) - 0.5  # noqa: E731  of a cell's centre: a whole number
    # a centre found by rounding is one, not a hair beside it
    exact = lambda e: F.when(F.abs(e - F.round(e)) < 1e-9, F.round(e)).otherwise(e)
    tile = lambda e: F.floor(e / TILE).cast("long")
    parts = [f"_p{k}" for k in range(len(within))]
    by = [*parts, "_ti", "_tj"]
    at = target.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], *[F.col(w).alias(p) for p, w in zip(parts, within)], exact(spot("x", dx)).alias("_x"), exact(spot("y", dy)).alias("_y"))
    at = at.where("_x is not null and _y is not null").withColumns({"_ti": tile(F.floor("_x")), "_tj": tile(F.floor("_y"))})
    same = [F.col(k).eqNullSafe(F.col(f"_c{k}")) for k in by]
    crowded = at.groupBy(*by).count().where(F.col("count") > TARGETS).select(*[F.col(k).alias(f"_c{k}") for k in by], F.ceil(F.col("count") / TARGETS).alias("_slices"))
    sliced = lambda df: df.join(F.broadcast(crowded), same, "left").withColumn("_n", F.coalesce("_slices", F.lit(1)))  # noqa: E731  a row a crowded tile
    own = [f"_k{n}" for n in range(len(keys))]
    spots = sliced(at).select(*own, *by, F.pmod(F.xxhash64(*own), "_n").alias("_s"), "_x", "_y")
    cells = raster.where("file is not null").select(*[F.col(w).alias(p) for p, w in zip(parts, within)], F.round(spot("x", dx)).cast("long").alias("_i"), F.round(spot("y", dy)).cast("long").alias("_j"), F.col("value").cast("double").alias("_v"), F.col("file").alias("_f"))
    cells = cells.dropna(subset=[*parts, "_i", "_j"])
    near = lambda e: F.explode(F.array_distinct(F.array(tile(F.col(e) - 1), tile(F.col(e)))))
    cells = sliced(cells.withColumn("_ti", near("_i")).withColumn("_tj", near("_j"))).withColumn("_s", F.explode(F.expr("sequence(0L, _n - 1)"))).select(*by, "_s", "_i", "_j", "_v", "_f")

    def weigh(cells, spots):
        import numpy as np
        import pyarrow as pa

        value, there = np.zeros((TILE + 1, TILE + 1)), np.zeros((TILE + 1, TILE + 1), bool)
        if cells.num_rows:
            i, j = (cells[k].to_numpy() - cells[t][0].as_py() * TILE for k, t in (("_i", "_ti"), ("_j", "_tj")))
            names = cells["_f"].combine_chunks().dictionary_encode()
            rank = np.argsort(np.argsort(np.array([x.encode() for x in names.dictionary.to_pylist()], object)))
            last = np.argsort(-rank[names.indices.to_numpy()], kind="stable")  # the first by name is written last
            value[i[last], j[last]] = cells["_v"].to_numpy(zero_copy_only=False)[last]
            there[i[last], j[last]] = ~cells["_v"].is_null().to_numpy(zero_copy_only=False)[last]
        x, y = (spots[k].to_numpy() for k in ("_x", "_y"))
        real = np.isfinite(x) & np.isfinite(y)
        total, weight = np.zeros(len(x)), np.zeros(len(x))
        fi, fj = np.floor(x[real]), np.floor(y[real])
        if real.any():
            i, j = ((f - spots[t][0].as_py() * TILE).astype(int) for f, t in ((fi, "_ti"), (fj, "_tj")))
            for a in (0, 1):
                for b in (0, 1):
                    w = (1 - np.abs(x[real] - fi - a)) * (1 - np.abs(y[real] - fj - b))
                    ok = (w > 0) & there[i + a, j + b]
                    total[real] += np.where(ok, w * value[i + a, j + b], 0)
                    weight[real] += np.where(ok, w, 0)
        return spots.select(own).append_column("_t", pa.array(total)).append_column("_w", pa.array(weight))

    kinds = ", ".join(f"{k} {spots.schema[k].dataType.simpleString()}" for k in own)
    got = cells.groupBy(*by, "_s").cogroup(spots.groupBy(*by, "_s")).applyInArrow(weigh, f"{kinds}, _t double, _w double")
    sums = got.groupBy(*own).agg(F.sum("_t").alias("_t"), F.sum("_w").alias("_w"))
    return sums.select(*[F.col(o).alias(k) for o, k in zip(own, keys)], F.when(F.col("_w") > 0, F.col("_t") / F.col("_w")).alias("value"))
