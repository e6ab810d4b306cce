"""Queries over outlines and lines, all made from the tables' rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import polygons
from ..operators.shared import ROWS, cut
from ..sources import tables as T
from .build import oracle, query

# Each customer has an outline of eight corners at its place, and a hole of half
# its size; all coordinates are binary fractions, exact in any engine.
CORNERS = ((0, 16), (11, 11), (16, 0), (11, -11), (0, -16), (-11, -11), (-16, 0), (-11, 11))
REACH = "(1 + (k * 7 + {i} * 5) % 13)"
X, Y = "(68 + k * 53 % 232 / 8e0)", "(8 + k * 37 % 224 / 8e0)"


def corner(i: int, part: int) -> tuple[str, str]:
    a, b = CORNERS[i % 8]
    reach = REACH.format(i=i % 8)
    return f"({X} + {a} * {reach} / {128 * part}e0)", f"({Y} + {b} * {reach} / {128 * part}e0)"


EDGES = "e AS (" + " UNION ALL ".join(f"SELECT k, {corner(i, part)[0]} AS x1, {corner(i, part)[1]} AS y1, {corner(i + 1, part)[0]} AS x2, {corner(i + 1, part)[1]} AS y2 FROM customer_keys" for part in (1, 2) for i in range(8)) + ")"
KEYS = "customer_keys AS (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer)"


def shapes(spark, sf):
    """``k, rings``: a customer's two rings."""
    ring = lambda part: "array(" + ", ".join(f"named_struct('x', {corner(i, part)[0]}, 'y', {corner(i, part)[1]})" for i in range(8)) + ")"
    keys = T.table(spark, sf, "customer").selectExpr("cast(c_custkey as bigint) as k")
    # a small file is read by one task, but makes many corners
    dealt = keys.repartition(max(2 * spark.sparkContext.defaultParallelism, -(-keys.count() // ROWS)), "k")
    return dealt.select("k", F.expr(f"array({ring(1)}, {ring(2)})").alias("rings"))


def outlines(spark, sf):
    """``k, ring``: two rings a customer."""
    return shapes(spark, sf).select("k", F.explode("rings").alias("ring"))


BOX = "b AS (SELECT k, min(least(x1, x2)) AS l, max(greatest(x1, x2)) AS r, min(least(y1, y2)) AS b, max(greatest(y1, y2)) AS t FROM e GROUP BY 1)"


def inside(per: int) -> str:
    """The cells of a grid of ``per`` cells a degree inside each outline: those of its box, tried one by one."""
    lines = f"rr AS (SELECT k, l, r AS e, unnest(range(greatest(0, CAST(floor((36 - t) * {per}) AS BIGINT) - 1), least({28 * per}, CAST(ceil((36 - b) * {per}) AS BIGINT) + 1))) AS r FROM b)"
    cells = f"g AS (SELECT k, r, unnest(range(greatest(0, CAST(floor((l - 68) * {per}) AS BIGINT) - 1), least({29 * per}, CAST(ceil((e - 68) * {per}) AS BIGINT) + 1))) AS c FROM rr)"
    return f"WITH {KEYS}, {EDGES}, {BOX}, {lines}, {cells}, p AS (SELECT k, r, c, 68 + (c + 0.5e0) / {per}e0 AS x, 36 - (r + 0.5e0) / {per}e0 AS y FROM g), i AS (SELECT k, r, c, x, y FROM p JOIN e USING (k) WHERE {ODD} GROUP BY ALL HAVING count(*) % 2 = 1)"


ODD = "(y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1"


@query(f"{inside(16)} SELECT k, r, c FROM i")
def fill_polygons(spark, sf):
    """The cells of one grid inside each outline and outside its hole."""
    return polygons.fill(polygons.edges(outlines(spark, sf), ["k"]), ["k"], x0=68.0, y0=36.0, dx=0.0625, dy=0.0625, rows=448, cols=464)


@query(f"WITH {KEYS}, {EDGES}, {BOX}, s AS (SELECT CAST(s_suppkey AS BIGINT) AS id, 68 + s_suppkey * 97 % 1856 / 64e0 AS x, 8 + s_suppkey * 61 % 1792 / 64e0 AS y FROM supplier) SELECT id, k FROM s JOIN b ON x BETWEEN l AND r AND y BETWEEN b AND t JOIN e USING (k) WHERE {ODD} GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def polygon_join(spark, sf):
    """The outlines that each supplier's place is in.

    Places meet shapes, each once, and the pairs of those become rows: the
    result's size grows with the product of both tables, the search doesn't.
    """
    places = T.table(spark, sf, "supplier").selectExpr("cast(s_suppkey as bigint) as id", "68 + s_suppkey * 97 % 1856 / 64e0 as x", "8 + s_suppkey * 61 % 1792 / 64e0 as y")
    spots, kinds = polygons.alike(places, ["x", "y"], "id", "place", "ids"), cut(polygons.alike(shapes(spark, sf), ["rings"], "k", "shape", "ks"))
    lines = polygons.edges(kinds.select("shape", F.explode("rings").alias("ring")), ["shape"])
    pairs = polygons.locate(spots.select("place", "x", "y"), lines, ["shape"], ["place"])
    found = pairs.join(spots.select("place", "ids"), "place").join(kinds.select("shape", "ks"), "shape")
    return found.select(F.explode("ids").alias("id"), "ks").select("id", F.explode("ks").alias("k"))


@query(f"{inside(2)} SELECT k, y AS lat, x AS lon, row_number() OVER (PARTITION BY k ORDER BY y, x) AS id FROM i")
def tessellate(spark, sf):
    """The half-degree lattice inside each outline, numbered there."""
    inside = polygons.fill(polygons.edges(outlines(spark, sf), ["k"]), ["k"], x0=68.0, y0=36.0, dx=0.5, dy=0.5, rows=56, cols=58)
    spots = inside.selectExpr("k", "36 - (r + 0.5D) / 2 as lat", "68 + (c + 0.5D) / 2 as lon")
    return spots.withColumn("id", F.row_number().over(W.partitionBy("k").orderBy("lat", "lon")).cast("long"))


@query(f"WITH {KEYS}, p AS (SELECT k, unnest([1, 2]) AS part FROM customer_keys) SELECT k, CAST(8 AS BIGINT) AS points, CASE part WHEN 1 THEN {corner(0, 1)[1]} ELSE {corner(0, 2)[1]} END AS lat FROM p")
def geojson_explode(spark, sf):
    """Features parsed from their JSON text, one row a ring."""
    feature = F.to_json(F.struct(F.struct(F.lit("Polygon").alias("type"), F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))).alias("coordinates")).alias("geometry")))
    text = outlines(spark, sf).groupBy("k").agg(F.collect_list("ring").alias("rings")).select("k", feature.alias("feature"))  # two rings a customer
    shape = F.from_json("feature", "geometry struct<type: string, coordinates: array<array<array<double>>>>")
    return text.select("k", F.explode(shape["geometry"]["coordinates"]).alias("ring")).select("k", F.size("ring").cast("long").alias("points"), F.col("ring")[0][1].alias("lat"))


@query("SELECT CAST(c_custkey AS BIGINT) AS k, greatest(c_custkey % 5 + 3, c_nationkey % 7 + 3) AS n FROM customer")
def ring_largest_part(spark, sf):
    """The longest ring of several parts."""
    parts = T.table(spark, sf, "customer").selectExpr("cast(c_custkey as bigint) as k", "array(sequence(1L, c_custkey % 5 + 3), sequence(1L, c_nationkey % 7 + 3)) as parts")
    return parts.select("k", F.expr("array_max(transform(parts, p -> struct(cast(size(p) as bigint) as n, p))).n").alias("n"))


WAYS = "CAST(s_nationkey AS BIGINT) AS district, s_suppkey * 3 % 40 AS ra, s_suppkey * 7 % 40 AS ca, (s_suppkey * 5 + 20) % 40 AS rb, (s_suppkey * 11 + 9) % 40 AS cb"


@query(f"WITH s AS (SELECT {WAYS} FROM supplier) SELECT DISTINCT district, CAST(round_even(ra + (rb - ra) * t / 80e0, 0) AS BIGINT) AS r, CAST(round_even(ca + (cb - ca) * t / 80e0, 0) AS BIGINT) AS c FROM s CROSS JOIN (SELECT range AS t FROM range(81))")
def rasterize_lines(spark, sf):
    """Cells that a nation's ways pass through, each way sampled finer than a cell."""
    s = T.table(spark, sf, "supplier").selectExpr(*[x for x in WAYS.split(", ")]).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(80))))
    return s.selectExpr("district", "cast(bround(ra + (rb - ra) * t / 80D, 0) as bigint) as r", "cast(bround(ca + (cb - ca) * t / 80D, 0) as bigint) as c").distinct()


@query(oracle(", e AS (SELECT district, min(v) AS lo, max(v) AS hi FROM cells GROUP BY 1) SELECT district, range AS step, round(lo + (hi - lo) * range / 5e0, 6) AS value, CAST(floor(255 * range / 5e0) AS BIGINT) AS shade FROM e CROSS JOIN range(6)", "cells"))
def legend(spark, sf):
    """Six steps of each layer's ramp, with the values they stand for."""
    ends = T.cells(spark, sf).groupBy("district").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(5)).cast("array<long>")))
    return ends.selectExpr("district", "step", "round(lo + (hi - lo) * step / 5D, 6) as value", "cast(floor(255 * step / 5D) as bigint) as shade")


COARSE = "k AS (SELECT district, r // 5 AS br, c // 5 AS bc, avg(v) AS m FROM cells GROUP BY 1, 2, 3), t AS (SELECT district, r, c, greatest(0, least(7, (r + 0.5e0) / 5 - 0.5e0)) AS y, greatest(0, least(7, (c + 0.5e0) / 5 - 0.5e0)) AS x FROM cells)"


@query(oracle(f", {COARSE}, q AS (SELECT t.*, a.range AS a, b.range AS b, (1 - abs(y - floor(y) - a.range)) * (1 - abs(x - floor(x) - b.range)) AS w FROM t CROSS JOIN range(2) a CROSS JOIN range(2) b) SELECT q.district, r, c, round(sum(w * m), 6) AS v FROM q JOIN k ON k.district = q.district AND br = least(7, floor(y) + a) AND bc = least(7, floor(x) + b) GROUP BY 1, 2, 3", "cells"))
def bilinear(spark, sf):
    """A coarse layer on the fine grid: each cell from the four blocks around it, by weight."""
    cells = T.cells(spark, sf)
    coarse = cells.groupBy("district", F.floor(F.col("r") / 5).alias("br"), F.floor(F.col("c") / 5).alias("bc")).agg(F.avg("v").alias("m"))
    at = cells.selectExpr("district", "r", "c", "greatest(0D, least(7D, (r + 0.5D) / 5 - 0.5D)) as y", "greatest(0D, least(7D, (c + 0.5D) / 5 - 0.5D)) as x")
    four = at.withColumn("k", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])))
    placed = four.selectExpr("district", "r", "c", "least(7, floor(y) + k.a) as br", "least(7, floor(x) + k.b) as bc", "(1 - abs(y - floor(y) - k.a)) * (1 - abs(x - floor(x) - k.b)) as w")
    return placed.join(coarse, ["district", "br", "bc"]).groupBy("district", "r", "c").agg(F.round(F.sum(F.col("w") * F.col("m")), 6).alias("v"))
