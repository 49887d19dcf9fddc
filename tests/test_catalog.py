import pytest
from oracle import database, differences

from evidra.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con():
    return database()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, con, name):
    assert differences(spark, con, name, QUERIES[name], ORACLE_SQL[name]) == ([], [])
