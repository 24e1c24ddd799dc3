"""Every registered query against its SQL on the smallest given tables."""

import pytest

from compare import connect, differences
from wayscore.plans.catalog import QUERIES
from wayscore.plans.oracle import ORACLE_SQL as SQL

@pytest.fixture(scope="module")
def db(given):
    return connect(given)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, given, db, name):
    assert differences(QUERIES[name](spark, given), db, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, given, name):
    assert QUERIES[name](spark, given).count() > 0
