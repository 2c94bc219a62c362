"""Every registered query beside its SQL on the smallest tables."""

import os

import pytest

from suite import CATALOGUE
from suite.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@needs_tables
@pytest.mark.parametrize("name", [n for n, (_, sql) in CATALOGUE.items() if sql])
def test_query_equals_sql(spark, con, name):
    fn, sql = CATALOGUE[name]
    assert difference(fn(spark, FOLDER).toPandas(), con.execute(sql).df()) is None


@needs_tables
def test_entry(spark, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setenv("ENTRY_SF_DIR", FOLDER)
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) < set(entry.queries())
