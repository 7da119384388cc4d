"""Every query that SQL can say gives the rows of its SQL; the others run and give rows."""

import pytest

from oracle import same
from tessella.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    if name in registry.SQL:
        same(spark, registry.QUERIES[name], registry.SQL[name], FOLDER)
    else:
        assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_sql_names_are_queries():
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
