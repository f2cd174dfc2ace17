"""Every query of the core against its SQL on the smallest tables."""

import pytest
from oracle import by_spark, by_sql

from inkstone.plans import files, models, reference, training

MODULES = (reference, files, models, training)
QUERIES = {name: q for m in MODULES for name, q in m.queries().items()}
SQL = {name: sql for m in MODULES for name, sql in m.oracle_sql().items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, small, name):
    assert by_spark(QUERIES[name](spark, small)) == by_sql(SQL[name], small)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
