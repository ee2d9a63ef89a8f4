"""The registered queries: against SQL where there is SQL."""

from __future__ import annotations

import pytest
from compare import connect, same

from tidewater.llm import queries

SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, con, name):
    same(queries.queries()[name](spark, sf), SQL[name], con)


def test_an_entry_for_each_operator():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]
