import pytest

import bindings
from tests.oracle import connect, difference


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(bindings.QUERIES))
def test_query_equals_sql(spark, con, sf, name):
    assert difference(spark, con, sf, name) is None


def test_every_query_has_sql():
    assert sorted(bindings.QUERIES) == sorted(bindings.SQL)
