"""Queries over grids and drainage networks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import formulas as M
from ..operators import choices, networks, radar
from ..operators import grids as G
from ..sources import tables as T
from .build import oracle, query

# neighbours with the rim repeated, as a self-join on clamped offsets
PAD = "SELECT a.district, a.r, a.c, a.v, i AS i, j AS j, b.v AS n FROM cells a CROSS JOIN (SELECT range - {k} AS i FROM range({w})) CROSS JOIN (SELECT range - {k} AS j FROM range({w})) JOIN cells b ON b.district = a.district AND b.r = greatest(0, least(39, a.r + i)) AND b.c = greatest(0, least(39, a.c + j))"


def pad(k: int) -> str:
    return PAD.format(k=k, w=2 * k + 1)


@query(oracle(f"SELECT district, r, c, round(avg(n), 6) AS blur FROM ({pad(2)}) GROUP BY 1, 2, 3", "cells"))
def box_blur(spark, sf):
    return G.box_blur(T.cells(spark, sf), radius=2).select("district", "r", "c", F.round("blur", 6).alias("blur"))


@query(oracle(f"SELECT district, r, c, max(n) - min(n) AS relief FROM ({pad(5)}) GROUP BY 1, 2, 3", "cells"))
def relief(spark, sf):
    return G.extent(T.cells(spark, sf)).select("district", "r", "c", "relief")


def z(i: int, j: int) -> str:
    return f"sum(n) FILTER (i = {i} AND j = {j})"


HORN = f"SELECT district, r, c, max(v) AS v, (({z(-1, 1)} + 2 * {z(0, 1)} + {z(1, 1)}) - ({z(-1, -1)} + 2 * {z(0, -1)} + {z(1, -1)})) / 240e0 AS gx, (({z(1, -1)} + 2 * {z(1, 0)} + {z(1, 1)}) - ({z(-1, -1)} + 2 * {z(-1, 0)} + {z(-1, 1)})) / 240e0 AS gy FROM ({pad(1)}) GROUP BY 1, 2, 3"


@query(oracle(f"SELECT district, r, c, round(degrees(atan(sqrt(gx * gx + gy * gy))), 5) AS slope, round((degrees(atan2(gy, 0e0 - gx)) + 360) % 360, 5) AS aspect FROM ({HORN})", "cells"))
def slope_aspect(spark, sf):
    return G.slope_aspect(T.cells(spark, sf)).select("district", "r", "c", F.round("slope", 5).alias("slope"), F.round("aspect", 5).alias("aspect"))


@query(oracle(f"SELECT district, r, c, round((sum(n) FILTER (abs(i) + abs(j) = 1) - 4 * max(v)) / 900e0 * 10000, 5) + 0.0 AS curvature FROM ({pad(1)}) GROUP BY 1, 2, 3", "cells"))
def curvature(spark, sf):
    return G.curvature(T.cells(spark, sf)).select("district", "r", "c", (F.round("curvature", 5) + 0.0).alias("curvature"))


@query(oracle(f"SELECT district, r, c, round(avg(CASE WHEN n > 180 THEN 1e0 ELSE 0e0 END) * 33.333333, 5) AS density FROM ({pad(3)}) GROUP BY 1, 2, 3", "cells"))
def drainage_density(spark, sf):
    cells = T.cells(spark, sf).withColumn("stream", (F.col("v") > 180).cast("double"))
    return G.box_blur(cells, "stream", radius=3).select("district", "r", "c", F.round(F.col("blur") * 33.333333, 5).alias("density"))


@query(oracle(f"SELECT district, r, c FROM ({pad(1)}) WHERE abs(i) + abs(j) <= 1 GROUP BY 1, 2, 3 HAVING NOT max(v) < 60 AND bool_or(n < 60)", "cells"))
def shoreline(spark, sf):
    cells = T.cells(spark, sf).withColumn("sea", F.col("v") < 60)
    return G.shoreline(cells, "sea").where("shore").select("district", "r", "c")


@query(oracle("SELECT a.district, a.r, a.c, CASE WHEN min(abs(a.r - b.r) + abs(a.c - b.c)) <= 6 THEN min(abs(a.r - b.r) + abs(a.c - b.c)) END AS dist FROM cells a LEFT JOIN cells b ON b.district = a.district AND b.v > 260 GROUP BY 1, 2, 3", "cells"))
def distance_l1(spark, sf):
    return G.distance(T.cells(spark, sf).withColumn("seed", F.col("v") > 260), "seed", 6).select("district", "r", "c", "dist")


DROPS = "SELECT a.district, a.r, a.c, b.r AS recv_r, b.c AS recv_c, (a.v - b.v) / CASE WHEN i = 0 OR j = 0 THEN 1e0 ELSE sqrt(2e0) END AS fall, d FROM cells a CROSS JOIN (SELECT * FROM (VALUES " + ", ".join(f"({i}, {j}, {n})" for n, (i, j) in enumerate(G.DIRECTIONS)) + ") t(i, j, d)) JOIN cells b ON b.district = a.district AND b.r = a.r + i AND b.c = a.c + j"


@query(oracle(f"SELECT district, r, c FROM ({DROPS}) GROUP BY 1, 2, 3 HAVING max(fall) <= 0", "cells"))
def d8_pits(spark, sf):
    return G.receivers(T.cells(spark, sf)).where("recv_r is null").select("district", "r", "c")


@query(oracle(f"SELECT district, r, c, recv_r, recv_c FROM (SELECT *, row_number() OVER (PARTITION BY district, r, c ORDER BY fall DESC, d) AS n FROM ({DROPS}) WHERE fall > 0) WHERE n = 1", "cells"))
def d8_receiver(spark, sf):
    return G.receivers(T.cells(spark, sf)).where("recv_r is not null").select("district", "r", "c", "recv_r", "recv_c")


@query(oracle(f", m AS (SELECT district, r, c, max(v) AS v, avg(n) AS mean, avg(n * n) - avg(n) * avg(n) AS var FROM ({pad(1)}) GROUP BY 1, 2, 3) SELECT district, r, c, round(mean + greatest(var, 0) / (greatest(var, 0) + 400e0) * (v - mean) + 1e-9, 5) AS filtered FROM m", "cells"))
def lee_filter(spark, sf):
    """Speckle filter: local mean, kept detail by local variance."""
    cells = T.cells(spark, sf).withColumn("sq", F.col("v") * F.col("v"))
    df = G.box_blur(G.box_blur(cells, "v", out="mean"), "sq", out="msq").withColumn("var", F.greatest(F.col("msq") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    return df.select("district", "r", "c", F.round(F.expr("mean + var / (var + 400D) * (v - mean) + 1e-9D"), 5).alias("filtered"))


@query(oracle("SELECT district, r, c, round((v - min(v) OVER w) / greatest(max(v) OVER w - min(v) OVER w, 1e-9), 6) AS norm FROM cells WINDOW w AS (PARTITION BY district)", "cells"))
def normalize(spark, sf):
    return G.normalised(T.cells(spark, sf), "v").select("district", "r", "c", F.round("norm", 6).alias("norm"))


@query(oracle(", s AS (SELECT id, round(CASE WHEN max(v) FILTER (r = r0 AND c = c0) > 0 THEN sum(v) / max(v) FILTER (r = r0 AND c = c0) ELSE 0 END, 6) AS score, s.district FROM settlements s JOIN cells USING (district) GROUP BY id, s.district) SELECT district, id, score, row_number() OVER (PARTITION BY district ORDER BY score DESC, id) AS rank FROM s", "cells", "settlements"))
def rank_zones(spark, sf):
    cells = T.cells(spark, sf)
    total = cells.groupBy("district").agg(F.sum("v").alias("total"))
    s = T.settlements(spark, sf).join(cells.selectExpr("district", "r as r0", "c as c0", "v"), ["district", "r0", "c0"]).join(F.broadcast(total), "district")  # a row a district
    s = s.withColumn("score", F.round(F.when(F.col("v") > 0, F.col("total") / F.col("v")).otherwise(0.0), 6))
    return s.select("district", "id", "score", F.row_number().over(W.partitionBy("district").orderBy(F.desc("score"), "id")).cast("long").alias("rank"))


CN = "CASE WHEN v > 300 THEN 98e0 WHEN v % 53 > 40 THEN 58e0 WHEN (v % 89) / 89e0 > 0.6 THEN 90e0 WHEN v >= q THEN 78e0 ELSE 66e0 END"


@query(oracle(f", k AS (SELECT district, r, c, {CN} AS v FROM (SELECT *, quantile_cont(v, 0.4) OVER (PARTITION BY district) AS q FROM cells)) SELECT district, r, c, round(avg(n), 6) AS cn FROM ({pad(1).replace('cells', 'k')}) GROUP BY 1, 2, 3", "cells"))
def curve_number(spark, sf):
    """Land classes by a cut of the layer itself, overridden in order, blurred."""
    cells = T.cells(spark, sf)
    cut = cells.groupBy("district").agg(F.percentile("v", 0.4).alias("q"))
    kinds = cells.join(F.broadcast(cut), "district").withColumn("cn", F.expr(CN))  # a row a district
    return G.box_blur(kinds, "cn").select("district", "r", "c", F.round("blur", 6).alias("cn"))


@query(oracle("SELECT district, r, c FROM cells WHERE v > greatest(12, floor(40 * 40 * 0.0035))", "cells"))
def stream_extract(spark, sf):
    return T.cells(spark, sf).where("v > greatest(12, floor(40 * 40 * 0.0035D))").select("district", "r", "c")


@query(oracle(f"SELECT district, r, c, round(greatest(0, least(1, cos(radians(48e0)) * cos(atan(sqrt(gx * gx + gy * gy))) + sin(radians(48e0)) * sin(atan(sqrt(gx * gx + gy * gy))) * cos(radians(315e0 - (degrees(atan2(gy, 0e0 - gx)) + 360) % 360)))), 5) AS shade FROM ({HORN})", "cells"))
def hillshade(spark, sf):
    """Light from azimuth 315, altitude 42."""
    s = G.slope_aspect(T.cells(spark, sf))
    return s.select("district", "r", "c", F.round(F.expr("greatest(0D, least(1D, cos(radians(48D)) * cos(radians(slope)) + sin(radians(48D)) * sin(radians(slope)) * cos(radians(315D - aspect))))"), 5).alias("shade"))




@query(oracle(", q AS (SELECT district, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM cells GROUP BY 1) SELECT district, r, c, round(CASE WHEN v < 30 THEN 0 ELSE 0.34e0 * s + 0.30e0 * (1 - s) + 0.21e0 * ((v % 89) / 89e0) + 0.15e0 * ((v % 97) / 97e0) END, 6) AS susceptibility FROM (SELECT *, greatest(0, least(1, (v - lo) / greatest(hi - lo, 1e-9))) AS s FROM cells JOIN q USING (district))", "cells"))
def waterlog_overlay(spark, sf):
    cells = T.cells(spark, sf)
    q = cells.groupBy("district").agg(F.percentile("v", 0.02).alias("lo"), F.percentile("v", 0.98).alias("hi"))
    s = cells.join(F.broadcast(q), "district").withColumn("s", F.expr("greatest(0D, least(1D, (v - lo) / greatest(hi - lo, 1e-9D)))"))  # a row a district
    return s.select("district", "r", "c", F.round(F.expr("case when v < 30 then 0 else 0.34D * s + 0.30D * (1 - s) + 0.21D * ((v % 89) / 89D) + 0.15D * ((v % 97) / 97D) end"), 6).alias("susceptibility"))


@query(oracle(", e AS (SELECT district, r, c, rp, v * f / 200 AS depth FROM cells CROSS JOIN (SELECT * FROM (VALUES (10e0, 0.8e0), (30e0, 1.2e0), (100e0, 2e0)) t(rp, f))) SELECT district, r, c, rp, depth >= 1 AS flood, depth % 0.5 >= 0.4 AND depth >= 0.5 AS landslide, round(CASE WHEN depth >= 1 THEN least(depth / 3, 1) ELSE 0 END, 6) AS intensity FROM e", "cells"))
def hazard_layers(spark, sf):
    events = spark.createDataFrame([(10.0, 0.8), (30.0, 1.2), (100.0, 2.0)], "rp double, f double")
    e = T.cells(spark, sf).crossJoin(F.broadcast(events)).withColumn("depth", F.expr("v * f / 200"))
    return e.selectExpr("district", "r", "c", "rp", "depth >= 1 as flood", "depth % 0.5D >= 0.4D and depth >= 0.5D as landslide", "round(case when depth >= 1 then least(depth / 3, 1) else 0 end, 6) as intensity")


HITS = "SELECT district, r, c, rp, hazard, CASE hazard WHEN 0 THEN depth >= 1 WHEN 1 THEN v % 53 > 45 AND depth >= 0.5 ELSE v % 89 > 80 AND depth >= 0.3 END AS hit, CASE hazard WHEN 0 THEN least(depth / 3, 1) WHEN 1 THEN (v % 53) / 53 ELSE (v % 89) / 89 END AS intensity FROM (SELECT district, r, c, v, rp, v * f / 200 AS depth FROM cells CROSS JOIN (SELECT * FROM (VALUES (10e0, 0.8e0), (30e0, 1.2e0), (100e0, 2e0)) t(rp, f))) CROSS JOIN (SELECT range AS hazard FROM range(3))"
UNSUIT = M.unsuitability("rp", "intensity", "kinds").replace("0.72 *", "0.72e0 *").replace("0.28 *", "0.28e0 *").replace("0.12 *", "0.12e0 *").replace("100.0", "100e0")


def red_zone(spark, sf):
    """Cells where a hazard makes the ground unfit to live on, with the
    shortest return period, the hazard that dominates then, and a score."""
    events = spark.createDataFrame([(10.0, 0.8), (30.0, 1.2), (100.0, 2.0)], "rp double, f double")
    kinds = F.array(
        F.struct(F.lit(0).alias("hazard"), (F.col("depth") >= 1).alias("hit"), F.expr("least(depth / 3, 1D)").alias("intensity")),
        F.struct(F.lit(1).alias("hazard"), F.expr("v % 53 > 45 and depth >= 0.5D").alias("hit"), F.expr("(v % 53) / 53").alias("intensity")),
        F.struct(F.lit(2).alias("hazard"), F.expr("v % 89 > 80 and depth >= 0.3D").alias("hit"), F.expr("(v % 89) / 89").alias("intensity")),
    )
    hits = T.cells(spark, sf).crossJoin(F.broadcast(events)).withColumn("depth", F.expr("v * f / 200")).select("district", "r", "c", "v", "rp", F.explode(kinds).alias("k")).where("k.hit")
    per = hits.groupBy("district", "r", "c").agg(
        F.min(F.struct("rp", (-F.col("k.intensity")).alias("i"), "k.hazard")).alias("b"), F.count_distinct("k.hazard").alias("kinds"), F.first("v").alias("v")
    )
    return per.select("district", "r", "c", "v", "b.rp", F.col("b.hazard").alias("dominant"), (-F.col("b.i")).alias("intensity"), "kinds")


RED = f"SELECT district, r, c, rp, hazard AS dominant, intensity, kinds FROM (SELECT *, row_number() OVER (PARTITION BY district, r, c ORDER BY rp, intensity DESC, hazard) AS n FROM (SELECT h.*, k.kinds FROM ({HITS}) h JOIN (SELECT district, r, c, count(DISTINCT hazard) AS kinds FROM ({HITS}) WHERE hit GROUP BY 1, 2, 3) k USING (district, r, c) WHERE hit)) WHERE n = 1"


@query(oracle(f"SELECT district, r, c, rp, dominant, kinds, round({UNSUIT}, 5) AS unsuitability FROM ({RED})", "cells"))
def redzone_build(spark, sf):
    return red_zone(spark, sf).select("district", "r", "c", "rp", F.col("dominant").cast("long").alias("dominant"), "kinds", F.round(F.expr(UNSUIT), 5).alias("unsuitability"))


@query(oracle(f", red AS ({RED}), near AS (SELECT s.district, id, v, rp, dominant FROM settlements s JOIN cells x ON x.district = s.district AND x.r BETWEEN r0 - 4 AND r0 + 4 AND x.c BETWEEN c0 - 4 AND c0 + 4 LEFT JOIN red ON red.district = x.district AND red.r = x.r AND red.c = x.c), p AS (SELECT district, id, sum(v) AS pop, coalesce(sum(v) FILTER (rp IS NOT NULL), 0) AS exposed, coalesce(sum(v) FILTER (rp <= 10), 0) AS e10, coalesce(sum(v) FILTER (rp <= 30), 0) AS e30, min(rp) AS first FROM near GROUP BY 1, 2), q AS (SELECT *, CASE WHEN e10 >= 0.25e0 * pop AND e10 > 0 THEN 10e0 WHEN e30 >= 0.25e0 * pop AND e30 > 0 THEN 30e0 WHEN exposed >= 0.25e0 * pop AND exposed > 0 THEN 100e0 WHEN exposed > 0 THEN 4 * first END AS material FROM p), t AS (SELECT *, round(100 * (0.34e0 * exposed / greatest(max(exposed) OVER (PARTITION BY district), 1e-9) + 0.42e0 * exposed / greatest(pop, 1e-9) + 0.24e0 * CASE WHEN material <= 10 THEN 1 ELSE 0 END), 4) AS priority FROM q) SELECT district, id, pop, exposed, material, coalesce(priority, 0) AS priority, row_number() OVER (PARTITION BY district ORDER BY coalesce(priority, 0) DESC, id) AS rank FROM t", "cells", "settlements"))
def habitation_priority(spark, sf):
    """Settlements by how much of what stands around them is red ground; the
    governing period is the shortest that exposes a quarter."""
    red = red_zone(spark, sf).select("district", "r", "c", "rp")
    near = G.around(T.settlements(spark, sf), T.cells(spark, sf), 4).join(red, ["district", "r", "c"], "left")

    def upto(limit):
        return F.coalesce(F.sum(F.when(F.col("rp") <= limit, F.col("v"))), F.lit(0.0))

    p = near.groupBy("district", "id").agg(F.sum("v").alias("pop"), upto(1e9).alias("exposed"), upto(10).alias("e10"), upto(30).alias("e30"), F.min("rp").alias("first"))
    q = p.withColumn("material", F.expr("case when e10 >= 0.25D * pop and e10 > 0 then 10D when e30 >= 0.25D * pop and e30 > 0 then 30D when exposed >= 0.25D * pop and exposed > 0 then 100D when exposed > 0 then 4 * first end"))
    d = W.partitionBy("district")
    priority = F.round(100 * (0.34 * F.col("exposed") / F.greatest(F.max("exposed").over(d), F.lit(1e-9)) + 0.42 * F.col("exposed") / F.greatest("pop", F.lit(1e-9)) + 0.24 * F.when(F.col("material") <= 10, 1).otherwise(0)), 4)
    t = q.withColumn("priority", F.coalesce(priority, F.lit(0.0)))
    return t.select("district", "id", "pop", "exposed", "material", "priority", F.row_number().over(d.orderBy(F.desc("priority"), "id")).cast("long").alias("rank"))


@query(oracle(f", red AS ({RED}), w AS (SELECT a.district, a.r, a.c, min(abs(a.r - b.r) + abs(a.c - b.c)) AS water FROM cells a JOIN cells b ON b.district = a.district AND b.v > 260 GROUP BY 1, 2, 3) SELECT district, r, c, round(0.26e0 * (1 - v / 400) + 0.22e0 * exp(-pow((water - 4) / 6e0, 2)) + 0.52e0 * ((v % 89) / 89e0), 5) AS suitability FROM cells LEFT JOIN w USING (district, r, c) ANTI JOIN red USING (district, r, c) WHERE v BETWEEN 20 AND 250", "cells"))
def site_suitability(spark, sf):
    """Ground outside every red cell, scored; water is best at four cells."""
    far = G.distance(T.cells(spark, sf).withColumn("seed", F.col("v") > 260), "seed").where("v between 20 and 250")
    safe = far.join(red_zone(spark, sf).select("district", "r", "c"), ["district", "r", "c"], "left_anti")
    return safe.select("district", "r", "c", F.round(F.expr("0.26D * (1 - v / 400) + 0.22D * exp(-pow((dist - 4) / 6D, 2)) + 0.52D * ((v % 89) / 89D)"), 5).alias("suitability"))


@query(oracle(", e AS (SELECT l_suppkey % 4 AS district, l_partkey % 40 AS r, l_orderkey % 40 AS c, sum(l_quantity) FILTER (year(l_shipdate) <= 1998) AS before, sum(l_quantity) AS after FROM lineitem GROUP BY 1, 2, 3) SELECT district, count(*) AS cells, sum(after - coalesce(before, 0)) AS built FROM e WHERE after - coalesce(before, 0) >= 40 AND after > 150 GROUP BY 1", "cells"))
def encroachment(spark, sf):
    """What was built on red ground between two epochs."""
    e = T.table(spark, sf, "lineitem").groupBy(F.expr("l_suppkey % 4").alias("district"), F.expr("l_partkey % 40").alias("r"), F.expr("l_orderkey % 40").alias("c")).agg(
        F.coalesce(F.sum(F.when(F.year("l_shipdate") <= 1998, F.col("l_quantity"))), F.lit(0.0)).alias("before"), F.sum("l_quantity").alias("after")
    )
    return e.where("after - before >= 40 and after > 150").groupBy("district").agg(F.count("*").alias("cells"), F.sum(F.expr("after - before")).alias("built"))


@query(oracle(f", red AS ({RED}) SELECT r, c, v, rp, dominant FROM cells LEFT JOIN red USING (district, r, c) WHERE district = 2 AND r = 17 AND c = 23", "cells"))
def explain_cell(spark, sf):
    """One cell's record over all layers: a look-up."""
    one = T.cells(spark, sf).where("district = 2 and r = 17 and c = 23")
    red = red_zone(spark, sf).where("district = 2 and r = 17 and c = 23").select("district", "r", "c", "rp", F.col("dominant").cast("long").alias("dominant"))
    return one.join(red, ["district", "r", "c"], "left").select("r", "c", "v", "rp", "dominant")


@query(oracle(", s AS (SELECT range AS i, range * 0.7e0 AS x0, 39 - range * 0.4e0 AS x1 FROM range(12)), p AS (SELECT DISTINCT i, round_even(2 + (35 - 2) * t / 40e0, 0) AS r, round_even(x0 + (x1 - x0) * t / 40e0, 0) AS c FROM s CROSS JOIN (SELECT range AS t FROM range(41))) SELECT i, count(*) AS n, max(v) AS worst FROM p JOIN cells ON district = i % 4 AND cells.r = p.r AND cells.c = p.c GROUP BY 1", "cells"))
def route_probe(spark, sf):
    """The worst cell along straight lines."""
    lines = spark.range(12).selectExpr("id as i", "id * 0.7D as x0", "39 - id * 0.4D as x1").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(40))))
    p = lines.selectExpr("i", "i % 4 as district", "cast(bround(2 + (35 - 2) * t / 40D, 0) as bigint) as r", "cast(bround(x0 + (x1 - x0) * t / 40D, 0) as bigint) as c").distinct()
    return p.join(T.cells(spark, sf), ["district", "r", "c"]).groupBy("i").agg(F.count("*").alias("n"), F.max("v").alias("worst"))




@query(oracle(", ok AS (SELECT district, r, c FROM cells WHERE v < 190), f AS (SELECT district, r, c FROM ok WHERE r = 0 UNION SELECT o.district, o.r, o.c FROM f JOIN ok o ON o.district = f.district AND abs(o.r - f.r) + abs(o.c - f.c) = 1) SELECT DISTINCT district, r, c FROM f", "cells", recursive=True))
def flood_fill(spark, sf):
    """What water from the northern rim can reach over four neighbours."""
    return networks.flood_fill(T.cells(spark, sf), "v < 190", "r = 0")


@query(oracle(", ok AS (SELECT district, r, c FROM cells WHERE v % 97 < 55), f AS (SELECT district, r, c FROM ok WHERE r BETWEEN 19 AND 21 AND c BETWEEN 19 AND 21 UNION SELECT o.district, o.r, o.c FROM f JOIN ok o ON o.district = f.district AND greatest(abs(o.r - f.r), abs(o.c - f.c)) = 1) SELECT DISTINCT district, r, c FROM f", "cells", recursive=True))
def road_reach(spark, sf):
    """What stays reachable from a centre over eight neighbours."""
    return networks.flood_fill(T.cells(spark, sf), "v % 97 < 55", "r between 19 and 21 and c between 19 and 21", diagonal=True)


@query()
def spaced_maxima(spark, sf):
    """Up to eight best cells of each district, at least six apart."""
    return choices.spaced_maxima(T.cells(spark, sf).withColumnRenamed("v", "score").where("score > 150"), 6.0, 8)


@query()
def allocate_reloc(spark, sf):
    demand = T.settlements(spark, sf).selectExpr("district", "id", "id * 7 % 25 as turn", "400 + id * 37 % 300 as people", "r0", "c0")
    sites = T.cells(spark, sf).where("v % 59 = 7").selectExpr("district", "r * 40 + c as site", "cast(v as bigint) + 50 as room", "r as r1", "c as c1")
    return choices.nearest_with_room(demand, sites, 25.0)


@query()
def allocate_shelter(spark, sf):
    """As many as find room, dry shelters only, nearest first."""
    demand = T.settlements(spark, sf).selectExpr("district", "id", "id as turn", "300 as people", "r0", "c0")
    sites = T.cells(spark, sf).where("v % 67 = 3 and v / 200 < 0.3").selectExpr("district", "r * 40 + c as site", "100 as room", "r as r1", "c as c1")
    return choices.nearest_with_room(demand, sites, 60.0, most=25)


@query("SELECT id, n FROM (SELECT CAST(n_nationkey AS BIGINT) AS id, n_nationkey * 3 % 7 AS share FROM nation) JOIN (SELECT range AS n FROM range(7)) ON n < share")
def place_facilities(spark, sf):
    """Each place's share of facilities, one row each."""
    return T.settlements(spark, sf).selectExpr("id", "id * 3 % 7 as share").where("share > 0").withColumn("n", F.explode(F.expr("sequence(0L, share - 1)"))).select("id", "n")


def rating(h: str) -> str:
    """The discharge at a depth, numbers as doubles in both engines."""
    return M.conveyance(h, "width", "0.045e0", "3.2e0", "1100.0e0").replace("5.0 / 3.0", "5e0 / 3e0").replace("0.0)", "0e0)")


STAGE = f"""WITH RECURSIVE g AS ({T.CELLS}), s AS (SELECT district, r, c, 5e0 + v * 8 AS q, 20e0 + v % 97 AS width, 0e0 AS lo, 30e0 AS hi, 0 AS i FROM g
 UNION ALL SELECT district, r, c, q, width, CASE WHEN {rating('((lo + hi) / 2)')} < q THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {rating('((lo + hi) / 2)')} < q THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM s WHERE i < 22)
 SELECT district, r, c, round((lo + hi) / 2, 3) AS depth FROM s WHERE i = 22"""


@query(STAGE)
def stage_bisect(spark, sf):
    """Depth that carries a discharge, by 22 halvings of 0 to 30 m inside one expression."""
    cells = T.cells(spark, sf).selectExpr("district", "r", "c", "5e0 + v * 8 as q", "20e0 + v % 97 as width")
    halves = f"aggregate(sequence(1, 22), named_struct('lo', 0e0, 'hi', 30e0), (a, i) -> if({rating('((a.lo + a.hi) / 2)')} < q, named_struct('lo', (a.lo + a.hi) / 2, 'hi', a.hi), named_struct('lo', a.lo, 'hi', (a.lo + a.hi) / 2)), a -> (a.lo + a.hi) / 2)"
    return cells.select("district", "r", "c", F.round(F.expr(halves), 3).alias("depth"))


NEWTON = "{t} - (2 * {t} + sin(2 * {t}) - pi() * sin(radians(lat))) / (2 + 2 * cos(2 * {t}))"
RADIUS_KM = M.EARTH_KM
MOLLWEIDE = f"""WITH RECURSIVE p AS ({T.POINTS}), s AS (SELECT k, lat, lon, radians(lat) AS t, 0 AS i FROM p UNION ALL SELECT k, lat, lon, {NEWTON.format(t='t')}, i + 1 FROM s WHERE i < 60)
 SELECT k, round(CAST({RADIUS_KM} AS DOUBLE) * 2 * sqrt(2e0) / pi() * radians(lon) * cos(t), 4) + 0.0 AS x, round(CAST({RADIUS_KM} AS DOUBLE) * sqrt(2e0) * sin(t), 4) + 0.0 AS y FROM s WHERE i = 60"""


@query(MOLLWEIDE)
def mollweide(spark, sf):
    """The equal-area projection in km, its angle by 60 Newton steps in one expression."""
    p = T.points(spark, sf).withColumn("t", F.expr(f"aggregate(sequence(1, 60), radians(lat), (t, i) -> {NEWTON.format(t='t')})"))
    return p.selectExpr("k", f"round({RADIUS_KM}D * 2 * sqrt(2e0) / pi() * radians(lon) * cos(t), 4) + 0e0 as x", f"round({RADIUS_KM}D * sqrt(2e0) * sin(t), 4) + 0e0 as y")




SHAPES = {
    "convective": "exp(-0.5e0 * pow((t - 33.6e0) / 8.64e0, 2))",
    "orographic": "(0.55e0 + 0.45e0 * pow(sin(2 * pi() * t / 40.32e0), 2)) * (exp(-0.5e0 * pow((t - 43.2e0) / 31.68e0, 2)) + 0.35e0)",
    "depression": "exp(-0.5e0 * pow((t - 28.8e0) / 15.36e0, 2)) + 0.85e0 * exp(-0.5e0 * pow((t - 63.36e0) / 19.2e0, 2))",
}


@query(oracle(", h AS (SELECT range AS t FROM range(96)), w AS (" + " UNION ALL ".join(f"SELECT '{n}' AS shape, t, {e} AS w FROM h" for n, e in SHAPES.items()) + "), d AS (SELECT district, avg(v) AS depth FROM cells GROUP BY 1) SELECT district, shape, t, round(w / sum(w) OVER (PARTITION BY district, shape), 9) AS share, round(depth * w / sum(w) OVER (PARTITION BY district, shape), 6) AS mm FROM d CROSS JOIN w", "cells"))
def hyetograph(spark, sf):
    """Each district's mean depth over the storm shapes' 96 hours; shares sum to one."""
    t = spark.range(96).withColumnRenamed("id", "t").select("t", *[F.expr(e).alias(n) for n, e in SHAPES.items()]).unpivot(["t"], list(SHAPES), "shape", "w")
    shares = t.withColumn("p", F.col("w") / F.sum("w").over(W.partitionBy("shape")))
    depth = T.cells(spark, sf).groupBy("district").agg(F.avg("v").alias("depth"))
    return depth.crossJoin(F.broadcast(shares)).select("district", "shape", "t", F.round("p", 9).alias("share"), F.round(F.col("depth") * F.col("p"), 6).alias("mm"))  # 288 rows


def scene(spark, sf):
    """A radar scene over each grid, before and after the wettest ground went
    under, with what the detection holds it against."""
    cells = T.cells(spark, sf).withColumn("z", F.col("v") / 40)
    high = cells.groupBy("district").agg(F.percentile("v", 0.7).alias("high"))
    ground = G.slope_aspect(cells, "z").join(high, "district")  # a row a district
    return ground.selectExpr("district", "r", "c", "slope", "v % 60 as hand", "v % 31 = 0 as stream", "v < 40 as sea", "-8D - (v % 7) / 5 - if(v % 31 = 0, 9, 0) as before", "if(v > high, -19D - (v % 5) / 4, -8D - (v % 7) / 5) as after")


@query()
def sar_detect(spark, sf):
    """Flood and permanent water in each scene, and how far its cut is to be trusted."""
    return radar.detect(scene(spark, sf)).where("flood or permanent")
