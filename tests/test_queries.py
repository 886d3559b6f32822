"""Every imaging query with SQL against DuckDB on the smallest test data."""

import glob
import os

import pandas as pd
import pytest

from obliqua import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return connection


def rows(frame):
    columns = sorted(frame.columns)
    plain = lambda v: tuple(v) if hasattr(v, "__len__") and not isinstance(v, str) else None if pd.isna(v) else v
    return sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, FOLDER).toPandas(), duck.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.astype(object)) == rows(want.astype(object))


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert queries.queries()[name](spark, FOLDER).count() > 0
