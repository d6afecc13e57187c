"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.run import difference

SF_DIR = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns == ["path", "relation", "depth"]


@pytest.mark.parametrize("name", list(queries()))
def test_query_equals_sql(spark, name):
    assert difference(spark, SF_DIR, queries()[name], oracle_sql().get(name)) in (None, "both sides are empty")
