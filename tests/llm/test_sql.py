"""The operators' queries over the smallest tables against their DuckDB SQL."""

import glob
import os

import duckdb
import pytest

from axisframe.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    frame = queries.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    cursor = duck.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=str)
    assert len(want) > 10 and sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str) == want
