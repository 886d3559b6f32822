"""The jobs as registered queries, against DuckDB on the smallest test data."""

import pytest

from jobs import common, queries
from tests.test_queries import FOLDER, duck, pytestmark, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_job_equals_its_sql(spark, duck, tmp_path, monkeypatch, name):  # noqa: F811
    monkeypatch.setattr(queries, "new_folder", lambda session, job: f"{tmp_path}/{job}")
    before = spark.conf.getAll
    got, want = queries.queries()[name](spark, FOLDER).toPandas(), duck.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.astype(object)) == rows(want.astype(object))
    assert [p.name for p in tmp_path.iterdir()] == [name.split("_")[0]] and spark.conf.getAll == before


def test_folders_are_new(spark):
    assert len({common.new_folder(spark, "job") for _ in range(3)}) == 3
