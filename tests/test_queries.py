"""Every named query of the library itself against its SQL."""

from __future__ import annotations

import pytest

from casemill.plans.catalog import ORACLE_SQL, QUERIES
from tests.comparing import assert_same, duck


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(name, spark, small, con):
    assert_same(QUERIES[name](spark, small).toPandas(), con.execute(ORACLE_SQL[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_repeatable(name, spark, small):
    first, second = (sorted(map(str, QUERIES[name](spark, small).collect())) for _ in range(2))
    assert first and first == second
