"""Training-data queries against their DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from chronolex.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, smoke_dir, name):
    connection = duckdb.connect()
    for file in os.listdir(smoke_dir):
        connection.sql(f"create view {file.split('.')[0]} as select * from '{smoke_dir}/{file}'")
    got, want = QUERIES[name](spark, smoke_dir), connection.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall())
