"""Every query against its SQL oracle on the smallest tables."""

import os

import duckdb
import pytest

from strataflow.plans.catalogue import oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(columns).collect()]
    if name not in oracle_sql():
        assert rows
        return
    rel = duck.sql(oracle_sql()[name])
    at = [rel.columns.index(c) for c in columns]
    assert sorted(rel.columns) == columns
    assert plain(rows) == plain([tuple(r[i] for i in at) for r in rel.fetchall()])
