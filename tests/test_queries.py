"""Every registered query against its SQL, over whole tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import connect, difference
from rinseframe.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def database():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))  # those of the training data are in tests/llm
def test_query(spark, database, name):
    result = queries()[name](spark, SF)
    if name not in oracle_sql():
        assert result.count() >= 0
        return
    assert difference(database, oracle_sql()[name], result) is None


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
