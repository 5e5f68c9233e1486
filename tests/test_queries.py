"""Every query with SQL against DuckDB on the same Parquet."""

import pytest

import __spark_entry__ as entry
from oracle import differences
from cliploom.plans import registry


def test_every_query_has_sql():
    assert registry.queries().keys() == registry.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_equals_sql(spark, sf_dir, name):
    assert differences(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], sf_dir) == ""


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_entry_has_every_core_query():
    assert registry.queries().keys() <= entry.queries().keys()
