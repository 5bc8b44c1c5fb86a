"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import pytest

from oracle import compare
from quillspark import catalog

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, name):
    compare(spark, DATA, catalog.REGISTRY[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.REGISTRY) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.REGISTRY[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
