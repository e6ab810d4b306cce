"""Queries over hourly records."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import formulas as M
from ..sources import tables as T
from .build import oracle, query

def hours():
    """A point's hours in order (made when asked for: windows need a session)."""
    return W.partitionBy("point").orderBy("h")


@query(oracle(", s AS (SELECT point, h, mm, sum(mm) OVER (PARTITION BY point ORDER BY h) AS total FROM hourly), x AS (SELECT point, h, round(total / (h + 1) - 14.82 * pow(greatest(h + 1, 0.167), -0.39), 3) AS excess FROM s) SELECT point, excess, h FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY excess DESC, h) AS n FROM x) WHERE n = 1", "hourly"))
def rainfall_trigger(spark, sf):
    """Where mean intensity since the start most exceeds the landslide threshold."""
    s = T.hourly(spark, sf).withColumn("total", F.sum("mm").over(hours())).withColumn("excess", F.round(F.expr(f"total / (h + 1) - {M.caine('(h + 1.0D)')}"), 3))
    return s.groupBy("point").agg(F.max(F.struct("excess", (-F.col("h")).alias("n"))).alias("b")).select("point", "b.excess", (-F.col("b.n")).alias("h"))


def _double(sql: str) -> str:
    import re

    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", sql)


RUNOFF = _double(M.runoff("total", "75.0"))


@query(oracle(f", s AS (SELECT point, h, sum(mm) OVER (PARTITION BY point, h // 96 ORDER BY h) AS total FROM hourly), q AS (SELECT point, h, {RUNOFF} AS q FROM s) SELECT point, h, round(q - coalesce(lag(q) OVER (PARTITION BY point, h // 96 ORDER BY h), 0), 4) + 0.0 AS runoff FROM q", "hourly"))
def runoff_hourly(spark, sf):
    """Runoff of the total so far, differenced, event by event of 96 hours."""
    event = W.partitionBy("point", F.expr("h div 96")).orderBy("h")
    q = T.hourly(spark, sf).withColumn("total", F.sum("mm").over(event)).withColumn("q", F.expr(RUNOFF))
    return q.select("point", "h", (F.round(F.col("q") - F.coalesce(F.lag("q").over(event), F.lit(0.0)), 4) + 0.0).alias("runoff"))


@query(oracle(", d AS (SELECT point, h // 24 AS day, sum(mm) AS mm FROM hourly GROUP BY 1, 2) SELECT a.point, a.day, round(sum(b.mm * pow(0.87e0, a.day - b.day)) + 1e-9, 5) AS api FROM d a JOIN d b ON b.point = a.point AND b.day BETWEEN a.day - 6 AND a.day GROUP BY 1, 2", "hourly"))
def antecedent_index(spark, sf):
    """Rain of the last seven days, older days weighing 0.87 of the next."""
    d = T.hourly(spark, sf).groupBy("point", F.expr("h div 24").alias("day")).agg(F.sum("mm").alias("mm"))
    w = W.partitionBy("point").orderBy("day").rowsBetween(-6, 0)
    return d.withColumn("last", F.collect_list("mm").over(w)).select("point", "day", F.round(F.expr("aggregate(last, 0D, (a, x) -> a * 0.87D + x) + 1e-9D"), 5).alias("api"))


@query(oracle("SELECT point, h, round(sum(mm) OVER (p ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 4) AS past24, round(sum(mm) OVER (p ROWS BETWEEN 71 PRECEDING AND CURRENT ROW), 4) AS past72, round(coalesce(sum(mm) OVER (p ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING), 0), 4) AS next24, round(coalesce(max(mm) OVER (p ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING), 0), 4) AS peak FROM hourly WINDOW p AS (PARTITION BY point ORDER BY h)", "hourly"))
def rain_windows(spark, sf):
    ahead = hours().rowsBetween(1, 24)
    return T.hourly(spark, sf).select(
        "point", "h", F.round(F.sum("mm").over(hours().rowsBetween(-23, 0)), 4).alias("past24"), F.round(F.sum("mm").over(hours().rowsBetween(-71, 0)), 4).alias("past72"),
        F.round(F.coalesce(F.sum("mm").over(ahead), F.lit(0.0)), 4).alias("next24"), F.round(F.coalesce(F.max("mm").over(ahead), F.lit(0.0)), 4).alias("peak"),
    )


@query(oracle("SELECT point, h, round(avg(cloud) OVER (p ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) - avg(cloud) OVER (p ROWS BETWEEN 12 PRECEDING AND 7 PRECEDING), 6) + 0.0 AS deepening FROM hourly WINDOW p AS (PARTITION BY point ORDER BY h)", "hourly"))
def deepening(spark, sf):
    """Mean of the last six hours over that of the six before."""
    return T.hourly(spark, sf).select("point", "h", (F.round(F.avg("cloud").over(hours().rowsBetween(-6, -1)) - F.avg("cloud").over(hours().rowsBetween(-12, -7)), 6) + 0.0).alias("deepening"))


@query(oracle("SELECT n.point, arg_max(f.h, f.cloud * 1000 - f.h) - 200 AS hours, max(f.cloud) AS top FROM hourly n JOIN hourly f ON f.point = n.point AND f.h BETWEEN 201 AND 248 AND f.cloud > n.cloud WHERE n.h = 200 GROUP BY 1", "hourly"))
def hours_to_peak(spark, sf):
    """The first hour of the highest state of the next 48, if above now."""
    now = T.hourly(spark, sf).where("h between 200 and 248").withColumn("now", F.max(F.when(F.col("h") == 200, F.col("cloud"))).over(W.partitionBy("point")))
    up = now.where("h > 200 and cloud > now")
    return up.groupBy("point").agg(F.max_by("h", F.struct("cloud", -F.col("h"))).alias("h"), F.max("cloud").alias("top")).select("point", (F.col("h") - 200).alias("hours"), "top")


@query(oracle(", u AS (SELECT range + 1 AS t, pow(range + 1, 2) * exp(-(range + 1) / 3e0) AS g FROM range(48)), n AS (SELECT t, g / sum(g) OVER () AS g FROM u) SELECT point, h, round(sum(mm * g), 4) AS q FROM (SELECT a.point, a.h, b.mm, g FROM hourly a JOIN n ON t <= a.h + 1 JOIN hourly b ON b.point = a.point AND b.h = a.h - t + 1) GROUP BY 1, 2", "hourly"))
def uh_convolve(spark, sf):
    """Rain through a gamma unit hydrograph of 48 hours: the hours of a window
    as an array, weighted by the ordinates, so no row is joined with others."""
    u = "transform(sequence(1, 48), t -> pow(t, 2) * exp(-t / 3D))"
    last = T.hourly(spark, sf).withColumn("past", F.reverse(F.collect_list("mm").over(hours().rowsBetween(-47, 0)))).withColumn("u", F.expr(u))
    weighted = "aggregate(zip_with(past, slice(u, 1, size(past)), (a, b) -> a * b), 0D, (s, x) -> s + x) / aggregate(u, 0D, (s, x) -> s + x)"
    return last.select("point", "h", F.round(F.expr(weighted), 4).alias("q"))


@query("WITH u AS (SELECT CAST(n_nationkey AS BIGINT) AS nation, range + 1 AS t, pow(range + 1, 2) * exp(-(range + 1) / (2 + n_nationkey % 5 / 2e0)) AS g FROM nation CROSS JOIN range(48)) SELECT nation, t, round(g / sum(g) OVER (PARTITION BY nation), 9) AS u FROM u")
def unit_hydrograph(spark, sf):
    """The ordinates of each catchment, whose time to peak is its own (shape 3)."""
    u = T.table(spark, sf, "nation").selectExpr("cast(n_nationkey as bigint) as nation", "transform(sequence(1, 48), t -> pow(t, 2) * exp(-t / (2 + n_nationkey % 5 / 2D))) as u")
    return u.select("nation", F.posexplode("u").alias("i", "g"), F.expr("aggregate(u, 0D, (s, x) -> s + x)").alias("s")).select("nation", (F.col("i") + 1).cast("long").alias("t"), F.round(F.col("g") / F.col("s"), 9).alias("u"))


@query(oracle("SELECT point, round(sum(mm), 4) AS wettest FROM (SELECT point, mm, row_number() OVER (PARTITION BY point ORDER BY mm DESC, h) AS n FROM hourly) WHERE n <= 24 GROUP BY 1", "hourly"))
def topk_sum(spark, sf):
    """The 24 wettest hours, which is what the figure is."""
    w = W.partitionBy("point").orderBy(F.desc("mm"), "h")
    return T.hourly(spark, sf).withColumn("n", F.row_number().over(w)).where("n <= 24").groupBy("point").agg(F.round(F.sum("mm"), 4).alias("wettest"))




@query(oracle(", r AS (SELECT point, h, cloud, sum(mm) OVER (PARTITION BY point ORDER BY h ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) AS ahead FROM hourly), b AS (SELECT point, h, cloud, round(100 * (0.7e0 * least(coalesce(ahead, 0) / 204.5e0, 1) + 0.3e0 * cloud / 100), 4) AS base FROM r WHERE h % 24 = 0) SELECT point, h, base, row_number() OVER (PARTITION BY h ORDER BY base DESC, point) AS rank FROM b WHERE base >= 18", "hourly"))
def watch_board(spark, sf):
    """Daily boards: a cheap score first, and only what passes the gate is ranked."""
    r = T.hourly(spark, sf).withColumn("ahead", F.sum("mm").over(hours().rowsBetween(1, 24))).where("h % 24 = 0")
    b = r.withColumn("base", F.round(F.expr("100 * (0.7D * least(coalesce(ahead, 0) / 204.5D, 1) + 0.3D * cloud / 100)"), 4)).where("base >= 18")
    return b.select("point", "h", "base", F.row_number().over(W.partitionBy("h").orderBy(F.desc("base"), "point")).cast("long").alias("rank"))


@query(oracle(", g AS (SELECT point, h, mm, h - row_number() OVER (PARTITION BY point ORDER BY h) AS spell FROM hourly WHERE mm > 0) SELECT point, min(h) AS first, count(*) AS hours, round(sum(mm), 4) AS mm FROM g GROUP BY point, spell", "hourly"))
def wet_spells(spark, sf):
    """Runs of wet hours: gaps and islands."""
    g = T.hourly(spark, sf).where("mm > 0").withColumn("spell", F.col("h") - F.row_number().over(hours()))
    return g.groupBy("point", "spell").agg(F.min("h").alias("first"), F.count("*").alias("hours"), F.round(F.sum("mm"), 4).alias("mm")).drop("spell")
