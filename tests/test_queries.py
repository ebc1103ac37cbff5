"""Every query of the catalog against its SQL."""

import pytest

from lodestone import catalog
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, con, name):
    assert not difference(catalog.QUERIES[name](spark, SF), con, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).collect() is not None


def test_flagship(spark):
    assert catalog.QUERIES[catalog.FLAGSHIP](spark, SF).columns
