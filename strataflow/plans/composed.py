"""Queries that put several operators together."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bands as B
from ..functions import formulas as M
from ..operators import grids as G
from ..sources import tables as T
from .build import oracle, query
from .raster import pad


@query(oracle("SELECT r, c, v FROM cells WHERE district = 2", "cells"))
def scan_cells(spark, sf):
    return T.cells(spark, sf).where("district = 2").select("r", "c", "v")




STORM = "exp(-0.5e0 * pow((t - 33.6e0) / 8.64e0, 2))"


@query(oracle(f", s AS (SELECT range AS t, {STORM} AS w FROM range(96)) SELECT district, t, round(avg(v) * 2 * w / (SELECT sum(w) FROM s), 5) AS mm FROM cells CROSS JOIN s GROUP BY district, t, w", "cells"))
def design_storm(spark, sf):
    """A district's design depth over a convective storm's hours."""
    depth = T.cells(spark, sf).groupBy("district").agg((F.avg("v") * 2).alias("depth"))
    shape = spark.range(96).selectExpr("id as t", f"{STORM.replace('t -', 'id -')} as w")
    share = shape.withColumn("share", F.col("w") / F.sum("w").over(W.partitionBy(F.lit(0))))  # 96 rows
    return depth.crossJoin(F.broadcast(share)).select("district", "t", F.round(F.col("depth") * F.col("share"), 5).alias("mm"))


TEHD = f"({M.slope_rating('v % 53')} + {M.relief_rating('v')} + {M.land_rating('(v % 89) / 89e0', '(v % 97) / 97e0', 'v % 53')} + 2.0)"


@query(oracle(f", k AS (SELECT district, r, c, CAST(least({TEHD}, 10.0) AS DOUBLE) AS v FROM cells), b AS (SELECT district, r, c, round(avg(n), 6) AS total FROM ({pad(1).replace('cells', 'k')}) GROUP BY 1, 2, 3) SELECT district, r, c, CASE WHEN v % 53 < 5 THEN 0 ELSE total END AS total, {B.below('CASE WHEN v % 53 < 5 THEN 0 ELSE total END', B.HAZARD_ZONE)} AS zone FROM b JOIN cells USING (district, r, c)", "cells"))
def lhef_total(spark, sf):
    """The six ratings summed (two of them neutral), blurred, none on gentle ground."""
    rated = T.cells(spark, sf).withColumn("rating", F.expr(f"cast(least({TEHD}, 10.0) as double)"))
    total = G.box_blur(rated, "rating").withColumn("total", F.expr("case when v % 53 < 5 then 0D else round(blur, 6) end"))
    return total.select("district", "r", "c", "total", F.expr(B.below("total", B.HAZARD_ZONE)).alias("zone"))


@query(oracle(f", w AS (SELECT point, h, cloud, round(sum(mm) OVER (p ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 4) AS past, round(coalesce(sum(mm) OVER (p ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING), 0), 4) AS ahead FROM hourly WINDOW p AS (PARTITION BY point ORDER BY h)) SELECT point, h, {B.reached('greatest(past, ahead)', B.RAIN_24H)} AS band, CASE WHEN cloud >= 90 THEN 'saturated' WHEN cloud >= 75 THEN 'wet' WHEN cloud >= 50 THEN 'moist' ELSE 'dry' END AS soil FROM w", "hourly"))
def watch_reads(spark, sf):
    p = W.partitionBy("point").orderBy("h")
    w = T.hourly(spark, sf).select("point", "h", "cloud", F.round(F.sum("mm").over(p.rowsBetween(-23, 0)), 4).alias("past"), F.round(F.coalesce(F.sum("mm").over(p.rowsBetween(1, 24)), F.lit(0.0)), 4).alias("ahead"))
    return w.select("point", "h", F.expr(B.reached("greatest(past, ahead)", B.RAIN_24H)).alias("band"), F.expr("case when cloud >= 90 then 'saturated' when cloud >= 75 then 'wet' when cloud >= 50 then 'moist' else 'dry' end").alias("soil"))


@query()
def rdp(spark, sf):
    """Rings thinned to what deviates by more than a tolerance."""

    def thin(pdf):
        import numpy as np

        xy = pdf.sort_values("n")[["x", "y"]].to_numpy()
        keep, spans = np.zeros(len(xy), bool), [(0, len(xy) - 1)]
        keep[[0, -1]] = True
        while spans:
            a, b = spans.pop()
            if b - a < 2:
                continue
            d = xy[b] - xy[a]
            rel = xy[a + 1 : b] - xy[a]
            off = np.abs(d[0] * rel[:, 1] - d[1] * rel[:, 0]) / max(np.hypot(*d), 1e-12) if d.any() else np.hypot(*rel.T)
            i = int(off.argmax())
            if off[i] > 0.6:
                keep[a + 1 + i] = True
                spans += [(a, a + 1 + i), (a + 1 + i, b)]
        return pdf.sort_values("n")[keep]

    rings = T.points(spark, sf).selectExpr("nation", "k as n", "lon as x", "lat as y")
    return rings.groupBy("nation").applyInPandas(thin, "nation long, n long, x double, y double")
