"""Every registered query against its SQL at the smallest scale."""

import pytest
from check import compare, oracle_connection

from voxmart.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.load()


@pytest.fixture(scope="module")
def duck():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert compare(df, duck, ORACLES[name]) == []
    else:
        assert df.count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["day", "category", "mentions", "avg_score", "z_score", "anomaly"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
