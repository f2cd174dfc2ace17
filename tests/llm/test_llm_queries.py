"""The subpackage's queries on the smallest tables, against SQL where there is some."""

import pytest
from oracle import by_spark, by_sql

from inkstone.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, small, name):
    assert by_spark(Q.queries()[name](spark, small)) == by_sql(Q.oracle_sql()[name], small)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_runs(spark, small, name):
    assert Q.queries()[name](spark, small).count() > 0
