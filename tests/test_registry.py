"""Every registered query of the library against DuckDB on the smallest given tables."""

import datetime
import decimal
import math
import os
import re

import duckdb
import pytest

from quarrylens.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        path = f"{FOLDER}/{table}.parquet"
        path = path if os.path.isfile(path) else f"{path}/*.parquet"
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return connection


def cell(value):
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@needs_tables
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert got == rows_of(names, result.fetchall())


@needs_tables
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    assert frame.columns and len(frame.limit(1000).collect()) > 0


@needs_tables
def test_entry(spark):
    import __spark_entry__ as entry

    found = entry.entry(spark)
    assert found.columns == ["section", "item", "metric", "value"] and found.count() > 20


def test_names_and_sql_agree():
    assert set(SQL) <= set(QUERIES)
    assert not [n for n in QUERIES if re.match(r"op\d+_", n)]
