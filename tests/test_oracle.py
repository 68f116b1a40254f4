import pytest

import __spark_entry__ as entry
from orbweave.plans import catalog
from tests.oracle import connect, same

Q, O = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(O))
def test_matches_sql(spark, sf, con, name):
    same(Q[name](spark, sf), con, O[name])


@pytest.mark.parametrize("name", sorted(set(Q) - set(O)))
def test_runs(spark, sf, name):
    df = Q[name](spark, sf)
    assert df.columns
    df.collect()


def test_entry(spark):
    assert entry.entry(spark).count() == 500


def test_registry_is_complete():
    assert set(O) <= set(Q)
    assert set(catalog.operators()) == set(Q)
