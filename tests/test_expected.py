"""Every query that plain SQL can express, against DuckDB at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
import tools_check

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in tools_check.TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_sql_keys_are_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    status, rows, _, detail = tools_check.compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert status in ("ok", "rows-only"), detail
