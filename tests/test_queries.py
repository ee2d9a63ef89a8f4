"""Every query of the catalogue runs; those with SQL give what DuckDB gives."""

from __future__ import annotations

import pytest
from compare import connect, same

from tidewater.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, con, name):
    df = catalog.queries()[name](spark, sf)
    if name in SQL:
        same(df, SQL[name], con)
    else:
        assert df.columns and df.count() > 0


def test_entry_contract(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
