"""Every registered query against its DuckDB SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from chronolex import registry


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.fixture(scope="session")
def duck(smoke_dir):
    connection = duckdb.connect()
    for name in os.listdir(smoke_dir):
        connection.sql(f"create view {name.split('.')[0]} as select * from '{smoke_dir}/{name}'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, smoke_dir, duck, name):
    got = registry.QUERIES[name](spark, smoke_dir)
    want = duck.sql(registry.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(plain(r[want.columns.index(c)]) for c in columns) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql_runs(spark, smoke_dir, name):
    assert registry.QUERIES[name](spark, smoke_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
