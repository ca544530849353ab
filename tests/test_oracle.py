import pytest
from oracle_compare import connect, differences

from cellspan.plans import oracle, queries

SF = "/root/testdata/sf0.01"
SQL, QUERIES = oracle.oracle_sql(), queries.queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, spark, con):
    assert differences(QUERIES[name](spark, SF), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(name, spark):
    assert QUERIES[name](spark, SF).count() > 0
