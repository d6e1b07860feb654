"""Every registered query with SQL, at the smallest scale, against DuckDB; whole results."""

from pathlib import Path

import pytest

from tests.oracle import compare, connect
from wayweft.plans.catalog import all_queries

FOLDER = "/root/testdata/sf0.001"
QUERIES = all_queries()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    run, sql = QUERIES[name]
    if sql is None:
        assert run(spark, FOLDER).count() > 0
    else:
        assert compare(run(spark, FOLDER), con, sql) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
