"""Every query with SQL is compared, row by row, on the smallest tables."""

import pytest

from caregauge.plans.catalog import all_queries
from caregauge.plans.oracle import all_sql
from tools.check import compare, connect

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def connection():
    return connect(SF_SMALL)


def test_sql_belongs_to_queries():
    assert set(all_sql()) <= set(all_queries())


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query_equals_sql(spark, connection, name):
    outcome = compare(spark, connection, SF_SMALL, name)
    assert outcome.startswith("ok"), outcome
