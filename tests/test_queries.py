"""Every registered freight query against its SQL, run by DuckDB on the same files."""

import datetime
import decimal
import math

import duckdb
import pytest

from haulspark.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, decimal.Decimal):
        return repr(float(value))
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return None if value is None else str(value)


def in_order(rows):
    return sorted((tuple(plain(v) for v in row) for row in rows), key=lambda row: [(v is None, v or "") for v in row])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_is_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = in_order(df.select(*columns).collect())
    if name in ORACLE_SQL:
        assert rows == in_order(duck.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall())
    else:
        assert rows


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
