import pytest

from tests.conftest import SF_DIR
from tests.oracle_check import compare, connect

import __spark_entry__ as contract
from linkweave.catalog.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    return connect(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, con, name):
    got = compare(spark, con, contract.queries()[name], contract.oracle_sql()[name], SF_DIR)
    assert isinstance(got, int), got


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_query_has_a_twin():
    assert set(QUERIES) <= set(contract.queries()) and set(QUERIES) <= set(contract.oracle_sql())
