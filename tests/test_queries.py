"""Every query of the catalog against its SQL on the smallest tables."""

import pytest

from tidemill import catalog


def test_all_have_sql_or_a_test():
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"sliding_ranking", "paired_bootstrap", "stream_circuit_breaker"}


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(name, same):
    same(catalog.QUERIES[name], catalog.SQL[name])


def test_entry_imports():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(catalog.SQL) <= set(e.oracle_sql())
