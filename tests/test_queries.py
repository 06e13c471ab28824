import pytest

import check_oracle
from quillon.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check_oracle.duck(SMALL)


def test_every_other_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL) | set(catalog.WITHOUT_SQL)


@pytest.mark.parametrize("name", catalog.WITHOUT_SQL)
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, con, name):
    assert check_oracle.difference(spark, con, name, SMALL) == ""
