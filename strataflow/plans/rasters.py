"""Queries over raster files and between lattices."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.shared import shared_dir
from ..sources import rasters
from ..sources import tables as T
from .build import oracle, query

# a district's grid begins at (2 * district, 40) and has cells of 1/128 degree: binary fractions, exact in any engine
STEP = 1 / 128


def written(spark, sf):
    """The terrain as raster files in the shared folder, but for cells of exactly 7."""
    path = f"{shared_dir(spark)}/rasters-{uuid.uuid4().hex}"
    cells = T.terrain(spark, sf).withColumn("v", F.expr("case when v <> 7 then v end"))
    rasters.write(cells, path, x0="2 * district", y0="40", dx=STEP, dy=STEP, side=64, block=16).write.format("noop").mode("overwrite").save()
    rasters.register(spark)
    return spark.read.format("raster").load(path)


@query(oracle(f"SELECT 2 * district + (c + 0.5) * {STEP}e0 AS x, 40 - (r + 0.5) * {STEP}e0 AS y, v AS value FROM terrain WHERE v <> 7 AND 2 * district + (c + 0.5) * {STEP}e0 BETWEEN 3.9 AND 12.05 AND 40 - (r + 0.5) * {STEP}e0 >= 39.875", "terrain"))
def raster_scan(spark, sf):
    """What raster files hold inside a box; the box prunes their blocks."""
    return written(spark, sf).where("x >= 3.9D and x <= 12.05D and y >= 39.875D").select("x", "y", "value")


@query(oracle(f""", k AS (SELECT {T.SIDE_SQL} AS n), t AS (SELECT district, r, c, 2 * district + (c + 0.75e0) * 5 / 512e0 AS x, 40 - (r + 0.75e0) * 5 / 512e0 AS y FROM terrain, k WHERE r < n * 4 // 5 AND c < n * 4 // 5),
 p AS (SELECT *, (x - 2 * district) * 128 - 0.5e0 AS fc, (40 - y) * 128 - 0.5e0 AS fr FROM t), q AS (SELECT *, a, b, (1 - abs(fr - floor(fr) - a)) * (1 - abs(fc - floor(fc) - b)) AS w FROM p CROSS JOIN range(2) i(a) CROSS JOIN range(2) j(b))
 SELECT q.district, q.r, q.c, round(sum(w * s.v) / sum(w) FILTER (s.v IS NOT NULL), 6) AS value FROM q LEFT JOIN terrain s ON s.district = q.district AND s.r = floor(fr) + a AND s.c = floor(fc) + b AND s.v <> 7 WHERE w > 0 GROUP BY 1, 2, 3""", "terrain"))
def raster_reproject(spark, sf):
    """The files' cells on another lattice, bilinear; grids wider than two
    degrees lie over their neighbours, and each counts only for its own district."""
    side = T.side(spark, sf)
    n = side * 4 // 5
    target = T.places(spark, side).where(f"r < {n} and c < {n}").selectExpr("district", "r", "c", "2 * district + (c + 0.75D) * 5 / 512D as x", "40 - (r + 0.75D) * 5 / 512D as y")
    of = written(spark, sf).withColumn("district", F.substring_index(F.substring_index("file", "/", -1), "-", 1).cast("long"))
    return rasters.bilinear(of, target, STEP, STEP, ["district", "r", "c"], ["district"]).select("district", "r", "c", F.round("value", 6).alias("value"))
