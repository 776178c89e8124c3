"""Every registered query against its SQL, on the smallest tables."""

import pytest
from compare import SF, duck, same

from turnwise.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    found = registry.QUERIES[name](spark, SF).toPandas()
    assert len(found.columns)
    if name in registry.ORACLES:
        same(found, duck().execute(registry.ORACLES[name]).df())


def test_entry_has_every_query(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
