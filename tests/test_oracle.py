"""Every query against the same query in DuckDB; those that SQL can't express must run and keep their schema."""

from __future__ import annotations

import pytest
from conftest import DATA, duck_rows, rows

from tallystone.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = rows(df, columns)
    if name in SQL:
        assert sorted(duck.sql(SQL[name]).columns) == columns
        assert got == duck_rows(duck, SQL[name], columns)
    else:
        assert got


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert "coverage" in df.columns


def test_every_sql_has_a_query():
    assert set(SQL) <= set(registry.queries())
