import pytest
from parity import assert_parity, connect

from salesflow.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, con, sf_dir, name):
    assert_parity(spark, con, QUERIES[name], ORACLE_SQL[name], sf_dir)


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
