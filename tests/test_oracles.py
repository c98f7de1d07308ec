import pytest
from conftest import SF

from compare import connect, same
from tracewell.registry import oracle_sql, queries

ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, con, name):
    same(queries()[name](spark, SF), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries()) - set(ORACLES)))
def test_runs(spark, name):
    assert queries()[name](spark, SF).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
