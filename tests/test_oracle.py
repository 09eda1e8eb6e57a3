"""Every registered query with SQL, against that SQL."""

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import connect, differences

# Queries of optional subpackages have tests of their own; the stored feature book needs a full training.
SQL = {n: s for n, s in oracle_sql().items() if not re.match(r"op\d+_|pipeline|stored_feature_book", n)}


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, folder, con, name, written_plans):
    written_plans.clear()
    result = queries()[name](spark, folder)
    assert written_plans == []
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert differences(result, con, SQL[name]) == ""


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(queries())
