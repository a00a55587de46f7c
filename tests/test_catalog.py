"""Every registered query against its SQL, over whole tables at the smallest scale."""

import pytest
from compare import compare, oracle_connection

from __spark_entry__ import entry, oracle_sql, queries
from kickpool.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)


def test_all_queries_are_registered():
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert compare(queries()[name](spark, SF), con, oracle_sql()[name]) == ""


def test_entry(spark):
    assert entry(spark).count() > 0
