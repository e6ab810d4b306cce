"""Polygons of any number of rings: filled over a grid, and joined to points.

A polygon is its edges, rows of a table; inside is where a ray crosses an odd
number of them, so holes are rings like others.  An edge is on a line where one
of its ends is above the line and the other isn't.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def edges(rings: DataFrame, keys: Sequence[str], ring: str = "ring") -> DataFrame:
    """``keys, x1, y1, x2, y2`` of rings, arrays of ``struct<x, y>``.

    A ring may end at its first point or not.  Points that lack a coordinate
    are passed over; null rings and rings of no extent add nothing.  Edges
    along a line of the grid never cross one and are left out.
    """
    points = F.filter(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    closed = rings.select(*keys, points.alias("_p")).where("size(_p) > 1").withColumn("_q", F.concat(F.slice("_p", 2, F.size("_p")), F.slice("_p", 1, 1)))
    pairs = closed.select(*keys, F.explode(F.arrays_zip("_p", "_q")).alias("_e"))
    real = lambda c: F.col(c).cast("double")
    return pairs.select(*keys, real("_e._p.x").alias("x1"), real("_e._p.y").alias("y1"), real("_e._q.x").alias("x2"), real("_e._q.y").alias("y2")).where("y1 != y2")


def alike(rows: DataFrame, by: Sequence[str], key: str, out: str, members: str, piece: int = 1024) -> DataFrame:
    """``by, out, members``: rows of equal ``by`` as one, with the list of
    their keys, and ``out``, the least of these, as its name; more than
    ``piece`` keys go by several rows.  What is asked of a shape or a place
    then is asked once, however many rows have it.
    """
    same = W.partitionBy(F.xxhash64(*by), *by).orderBy(key)
    numbered = rows.select(*by, key, F.floor((F.row_number().over(same) - 1) / piece).alias("_piece"))
    return numbered.groupBy(*by, "_piece").agg(F.min(key).alias(out), F.collect_list(key).alias(members)).drop("_piece")


def _at(y: str) -> str:
    """Where an edge crosses the line at ``y``."""
    return f"(x2 - x1) * ({y} - y1) / (y2 - y1) + x1"


def fill(lines: DataFrame, keys: Sequence[str], *, x0: float, y0: float, dx: float, dy: float, rows: int, cols: int) -> DataFrame:
    """``keys, r, c``: the cells whose centre is inside each polygon.

    Row 0 is at the top, its upper left corner at ``x0, y0``.  Each edge gives
    its crossings with the rows it spans; along a row of one polygon, crossings
    in order are in turn the begin and the end of cells inside.  The work is
    the crossings and the cells that come out; no cell meets an edge.
    """
    centre_y, centre_x = f"({y0}D - (r + 0.5D) * {dy}D)", f"({x0}D + (c + 0.5D) * {dx}D)"
    # whole numbers by rounding, one more on each side, and then the exact comparison
    top, end = f"cast(greatest(0, floor(({y0}D - greatest(y1, y2)) / {dy}D) - 1) as bigint)", f"cast(least({rows - 1}, ceil(({y0}D - least(y1, y2)) / {dy}D) + 1) as bigint)"
    spans = lines.selectExpr(*keys, "x1", "y1", "x2", "y2", f"{top} as _a", f"{end} as _b").where("_a <= _b")
    on = spans.withColumn("r", F.explode(F.sequence("_a", "_b"))).where(f"(y1 > {centre_y}) != (y2 > {centre_y})")
    crossed = on.selectExpr(*keys, "r", f"{_at(centre_y)} as _x")
    along = W.partitionBy(*keys, "r").orderBy("_x")
    turns = crossed.select(*keys, "r", "_x", F.lead("_x").over(along).alias("_end"), F.row_number().over(along).alias("_n")).where("_n % 2 = 1 and _end > _x")
    first, last = f"cast(greatest(0, floor((_x - {x0}D) / {dx}D) - 1) as bigint)", f"cast(least({cols - 1}, ceil((_end - {x0}D) / {dx}D) + 1) as bigint)"
    cells = turns.selectExpr("*", f"{first} as _a", f"{last} as _b").where("_a <= _b").withColumn("c", F.explode(F.sequence("_a", "_b")))
    return cells.where(f"{centre_x} >= _x and {centre_x} < _end").select(*keys, "r", "c")


def locate(points: DataFrame, lines: DataFrame, keys: Sequence[str], own: Sequence[str], tile: float = 1.0, piece: int = 1024) -> DataFrame:
    """``own, keys``: the polygons that each point ``x, y`` is in.

    A polygon's edges are gathered by bands of height ``tile``, in arrays of
    ``piece`` edges at most, and a point meets the bands whose bounds share its
    tile: one equi-join that shuffles, whatever the sizes; neither edges nor
    pairs are broadcast.  Only bands of several pieces are added up after it.
    ``own`` names the points; a point given twice counts once.
    """
    of = lambda e: F.floor(F.expr(e) / F.lit(tile)).cast("long")
    band = W.partitionBy(*keys, "_j")
    banded = lines.withColumn("_j", F.explode(F.sequence(of("least(y1, y2)"), of("greatest(y1, y2)"))))
    number = F.floor((F.row_number().over(band.orderBy("x1", "y1", "x2", "y2")) - 1) / piece)
    bounds = [F.min(F.least("x1", "x2")).over(band).alias("_l"), F.max(F.greatest("x1", "x2")).over(band).alias("_r"), (F.count("*").over(band) > piece).alias("_many")]
    cut = banded.select(*keys, "_j", F.struct("x1", "y1", "x2", "y2").alias("_e"), *bounds, number.alias("_piece"))
    pieces = cut.groupBy(*keys, "_j", "_l", "_r", "_many", "_piece").agg(F.collect_list("_e").alias("_edges"))
    tiled = pieces.withColumn("_i", F.explode(F.sequence(of("_l"), of("_r"))))
    spots = points.select(*own, F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y")).distinct().withColumn("_i", of("_x")).withColumn("_j", of("_y"))
    # estimates of exploded rows are far too small, and would have them broadcast
    near = lambda few: spots.join(tiled.where(few).hint("merge"), ["_i", "_j"]).where("_x >= _l and _x <= _r")
    n = F.expr("size(filter(_edges, e -> (e.y1 > _y) != (e.y2 > _y) and _x < (e.x2 - e.x1) * (_y - e.y1) / (e.y2 - e.y1) + e.x1))")
    whole = near("not _many").where(n % 2 == 1).select(*own, *keys)
    added = near("_many").groupBy(*own, *keys, "_x", "_y").agg(F.sum(n).alias("_n")).where("_n % 2 = 1").select(*own, *keys)
    return whole.unionByName(added)
