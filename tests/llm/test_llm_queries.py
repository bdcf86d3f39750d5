"""The training-data queries against their SQL over whole tables."""

import os

import pytest

from compare import connect, difference
from rinseframe.llm.oracle import ORACLE
from rinseframe.llm.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    assert difference(connect(SF), ORACLE[name], QUERIES[name](spark, SF)) is None


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)
