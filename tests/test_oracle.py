"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import difference

import __spark_entry__ as entry
from offerloom.plans.all_queries import ORACLES as SQL
from offerloom.plans.all_queries import QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, sf, oracle):
    if name in SQL:
        assert difference(QUERIES[name](spark, sf), oracle, SQL[name]) is None
    else:
        assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_and_tables():
    assert set(SQL) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
