"""Every registered query with a SQL twin gives the twin's rows."""

from __future__ import annotations

import pytest
from conftest import compare
from tallyworks import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(name, spark, sf, duck):
    compare(catalog.queries()[name](spark, sf), catalog.oracle_sql()[name], duck)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
