"""Every check query with a SQL counterpart, compared whole at the smallest scale."""

import pytest

from corpusgraph.plans import all_oracles, all_queries
from compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_matches_sql(spark, con, name):
    ok, message, _, _ = compare(spark, con, all_queries()[name], all_oracles()[name], SF)
    assert ok, message
