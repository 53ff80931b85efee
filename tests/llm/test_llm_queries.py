"""Queries that SQL can state, against it."""

import pytest
from conftest import rows_of

from corpusloom.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", list(SQL))
def test_against_sql(spark, sf, oracle, name):
    df = queries.queries()[name](spark, sf)
    columns, rows = oracle(sf, SQL[name])
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(columns, rows) == rows_of(df.columns, df.collect())


def test_each_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries()) == list(range(1, 11))
