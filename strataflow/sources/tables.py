"""Readers, and the deterministic layers that the queries run on.

A grid is a long cell table ``(district, r, c, v)``, a weather record an hourly
table ``(point, h, mm, cloud)``; both are derived from the input tables with
whole-number arithmetic, so any engine gets the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import spread

SIDE = 40
DISTRICTS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``district, r, c, v``: every cell of four grids; v sums quantities."""
    per = SIDE * SIDE
    full = spark.range(DISTRICTS * per).select(
        F.expr(f"id div {per}").alias("district"), F.expr(f"(id % {per}) div {SIDE}").alias("r"), F.expr(f"id % {SIDE}").alias("c")
    )
    sums = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.expr(f"l_suppkey % {DISTRICTS}").alias("district"), F.expr(f"l_partkey % {SIDE}").alias("r"), F.expr(f"l_orderkey % {SIDE}").alias("c"))
        .agg(F.sum("l_quantity").alias("v"))
    )
    return full.join(sums, ["district", "r", "c"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


CELLS = f"""SELECT district, r, c, coalesce(v, 0.0) AS v
 FROM (SELECT range AS district FROM range({DISTRICTS})) CROSS JOIN (SELECT range AS r FROM range({SIDE})) CROSS JOIN (SELECT range AS c FROM range({SIDE}))
 LEFT JOIN (SELECT l_suppkey % {DISTRICTS} AS district, l_partkey % {SIDE} AS r, l_orderkey % {SIDE} AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3) USING (district, r, c)"""


def settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``district, id, name, r0, c0``: the nations as places on the grids."""
    k = "n_nationkey"
    return table(spark, sf_dir, "nation").selectExpr(
        f"cast({k} % {DISTRICTS} as bigint) as district", f"cast({k} as bigint) as id", "n_name as name", f"cast({k} * 17 % {SIDE} as bigint) as r0", f"cast({k} * 29 % {SIDE} as bigint) as c0"
    )


SETTLEMENTS = f"SELECT CAST(n_nationkey % {DISTRICTS} AS BIGINT) AS district, CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_nationkey * 17 % {SIDE} AS BIGINT) AS r0, CAST(n_nationkey * 29 % {SIDE} AS BIGINT) AS c0 FROM nation"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``k, nation, pop, lat, lon``: customers as places on a lattice."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as k", "cast(c_nationkey as bigint) as nation", "cast(greatest(floor(c_acctbal), 0) as bigint) as pop", "8 + (c_custkey * 37 % 2800) / 100.0D as lat", "68 + (c_custkey * 53 % 2900) / 100.0D as lon"
    )


POINTS = "SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS nation, CAST(greatest(floor(c_acctbal), 0) AS BIGINT) AS pop, 8 + (c_custkey * 37 % 2800) / CAST(100 AS DOUBLE) AS lat, 68 + (c_custkey * 53 % 2900) / CAST(100 AS DOUBLE) AS lon FROM customer"


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``point, h, mm, cloud``: a dense hourly record by event type; mm sums
    values (by hundredths, so the order of addition doesn't show), cloud is the
    number of events, as percent.  It runs from the first hour of 2024, or of an
    earlier event, to the last event's."""
    got = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("point"), F.expr("cast(timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts) as bigint)").alias("h"))
        .agg(F.sum(F.expr("cast(round(value * 100) as bigint)")).alias("hundredths"), F.count("*").alias("n"))
    )
    # a row an hour of the calendar, whatever the number of events
    ends = got.agg(F.least(F.min("h"), F.lit(0)).alias("lo"), F.max("h").alias("hi")).where("hi is not null")
    spine = got.select("point").distinct().crossJoin(F.broadcast(ends.select(F.explode(F.sequence("lo", F.greatest("lo", "hi"))).alias("h"))))
    return spine.join(got, ["point", "h"], "left").selectExpr("point", "h", "coalesce(hundredths, 0) / 1000.0D as mm", "least(coalesce(n, 0) * 7, 100) as cloud")


HOURLY = f"""SELECT point, h, coalesce(hundredths, 0) / CAST(1000 AS DOUBLE) AS mm, least(coalesce(n, 0) * 7, 100) AS cloud
 FROM (SELECT DISTINCT event_type AS point FROM events) CROSS JOIN (SELECT unnest(range(lo, greatest(lo, hi) + 1)) AS h FROM (SELECT least(min(h), 0) AS lo, max(h) AS hi FROM (SELECT date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS h FROM events)))
 LEFT JOIN (SELECT event_type AS point, date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS h, sum(CAST(round(value * 100) AS BIGINT)) AS hundredths, count(*) AS n FROM events GROUP BY 1, 2) USING (point, h)"""


REGIONS = 25


def side(spark: SparkSession, sf_dir: str) -> int:
    """Rows and columns of a ``terrain`` grid: about a cell an item, 24 at least."""
    return max(24, int((table(spark, sf_dir, "lineitem").count() / REGIONS) ** 0.5))


def places(spark: SparkSession, n: int) -> DataFrame:
    """``district, r, c``: every cell of 25 grids of ``n`` rows and columns."""
    return spark.range(REGIONS * n * n).select(F.expr(f"id div {n * n}").alias("district"), F.expr(f"(id % {n * n}) div {n}").alias("r"), F.expr(f"id % {n}").alias("c"))


def terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``district, r, c, v``: 25 square grids that grow with ``lineitem``; v sums quantities."""
    n = side(spark, sf_dir)
    full = places(spark, n)
    place, rows = ["district", "r", "c"], REGIONS * n * n
    items = table(spark, sf_dir, "lineitem").select(F.expr(f"l_suppkey % {REGIONS}").alias("district"), F.expr(f"l_partkey % {n}").alias("r"), F.expr(f"l_orderkey % {n}").alias("c"), "l_quantity")
    sums = spread(items, rows, *place).groupBy(*place).agg(F.sum("l_quantity").cast("double").alias("v"))
    return spread(full, rows, *place).join(sums, place, "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


SIDE_SQL = f"(SELECT greatest(24, CAST(floor(sqrt(count(*) / {REGIONS}e0)) AS BIGINT)) FROM lineitem)"
TERRAIN = f"""SELECT district, r, c, CAST(coalesce(v, 0.0) AS DOUBLE) AS v
 FROM (SELECT range AS district FROM range({REGIONS})) CROSS JOIN (SELECT unnest(range({SIDE_SQL})) AS r) CROSS JOIN (SELECT unnest(range({SIDE_SQL})) AS c)
 LEFT JOIN (SELECT l_suppkey % {REGIONS} AS district, l_partkey % {SIDE_SQL} AS r, l_orderkey % {SIDE_SQL} AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3) USING (district, r, c)"""


def gauges_csv(spark: SparkSession, path: str) -> DataFrame:
    """A track or gauge file with a header and a units row: rows whose
    latitude is no number are passed over."""
    raw = spark.read.option("header", True).csv(path)
    return raw.where(F.expr("try_cast(LAT as double)").isNotNull())


def outlines_json(spark: SparkSession, path: str) -> DataFrame:
    """``code, ring``: the longest ring of each feature of a GeoJSON file."""
    features = spark.read.option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    shape = "case when f.geometry.type = 'Polygon' then array(from_json(to_json(f.geometry.coordinates), 'array<array<array<double>>>')) else from_json(to_json(f.geometry.coordinates), 'array<array<array<array<double>>>>') end"
    parts = features.select(F.coalesce("f.properties.code", "f.properties.district_code").alias("code"), F.expr(shape).alias("parts"))
    return parts.select("code", F.expr("array_max(transform(parts, p -> struct(size(p[0]) as n, p[0] as ring))).ring").alias("ring"))
