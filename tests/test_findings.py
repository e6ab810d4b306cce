"""Queries on tables made for them, against their SQL."""

import duckdb

import __spark_entry__
from strataflow.sources import rasters


def same(spark, name, sf, *tables):
    """The query's rows and its SQL's, over Parquet files below ``sf``."""
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, str(sf))
    rel = con.sql(__spark_entry__.oracle_sql()[name])
    at = [rel.columns.index(c) for c in df.columns]
    got, want = sorted(map(tuple, df.collect()), key=repr), sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
    assert got == want
    return got


def test_of_equal_tiles_the_first_in_the_file_counts(spark, tmp_path):
    rows = "select 1 as l_partkey, 5 as l_orderkey, 2 as l_linenumber, 40e0 as l_quantity union all select 1, 5, 2, 30e0 union all select 1, 5, 2, 35e0 union all select 2, 1, 1, null union all select 2, 7, 1, 9e0 union all select 3, 1, 1, null"
    duckdb.sql(f"copy ({rows}) to '{tmp_path}/lineitem.parquet'")
    assert same(spark, "mosaic_first", tmp_path, "lineitem") == [(1, 40.0), (2, 9.0), (3, None)]


def test_a_targets_cells_are_of_its_own_grid(spark):
    rows = [(d, 0.5 * (c + 0.5), -0.5 * (r + 0.5), float(100 * d + 10 * r + c), f"{d}") for d in (0, 1) for r in range(4) for c in range(4)]
    grids = spark.createDataFrame(rows, "district long, x double, y double, value double, file string")
    spots = spark.createDataFrame([(d, 0, 0.75, -1.25) for d in (0, 1)] + [(2, 0, 0.75, -1.25)], "district long, k long, x double, y double")
    got = rasters.bilinear(grids, spots, 0.5, 0.5, ["district", "k"], ["district"]).collect()
    assert {x["district"]: x["value"] for x in got} == {0: 21.0, 1: 121.0, 2: None}


def test_times_count_to_the_nearest_second(spark, tmp_path):
    times = ["2024-01-01 05:59:59.499999", "2024-01-01 05:59:59.5", "2024-01-01 05:59:58.5", "2024-01-01 11:59:59.9", "2024-01-01 12:00:00.5"]
    rows = " union all ".join(f"select cast({k} as bigint) as event_id, timestamp '{t}' as ts, cast(1 as bigint) as user_id, 'a' as event_type, 1e0 as value, '' as props" for k, t in enumerate(times))
    duckdb.sql(f"copy ({rows}) to '{tmp_path}/events.parquet'")
    got = {x[0]: x[2] for x in same(spark, "sliding_24h", tmp_path, "events")}
    assert got["2024-01-01 12"] == 2 and got["2024-01-01 06"] == 3 and got["2024-01-01 00"] == 5


def test_places_meet_places_however_many_rows_lie_there(spark, tmp_path):
    """600 customers and 400 stations at one place each: one pair, not 240,000."""
    duckdb.sql(f"copy (select range * 81200 as c_custkey, 1 as c_nationkey, 1e0 as c_acctbal from range(600)) to '{tmp_path}/customer.parquet'")
    duckdb.sql(f"copy (select 5 + range * 81200 as s_suppkey from range(400) union all select 0) to '{tmp_path}/supplier.parquet'")
    got = same(spark, "nearest_within", tmp_path, "customer", "supplier")
    assert len(got) == 600 and {x[1:] for x in got} == {(0, 0.0)}
    df = __spark_entry__.queries()["nearest_within"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "min(s" in plan and plan.count("Aggregate") >= 3  # stations and points by place, then the nearest
