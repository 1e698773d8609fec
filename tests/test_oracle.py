"""Every core query with a SQL twin, against DuckDB on the smallest tables; the others must run and give rows."""

import pytest
from compare import same

from sfumato.queries import core

QUERIES, SQL = core.queries(), core.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, duck, name):
    same(QUERIES[name](spark, data), duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, data, name):
    assert QUERIES[name](spark, data).head(1)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["target_t", "yhat"]
    assert set(core.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
