import pytest

from linkweave.llm.queries import ORACLE, QUERIES
from tests.conftest import SF_DIR
from tests.oracle_check import compare, connect


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    return connect(SF_DIR)


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_its_sql(spark, con, name):
    got = compare(spark, con, QUERIES[name], ORACLE[name], SF_DIR)
    assert isinstance(got, int), got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_has_a_row_per_document(spark, name):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert QUERIES[name](spark, SF_DIR).count() == documents
