"""Registered queries against their SQL, and the plain rules of registering."""

import pytest

from compare import connect, differences
from pdengine.llm.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, folder, name):
    assert differences(QUERIES[name](spark, folder), connect(folder), SQL[name]) == ""


def test_one_query_per_operator():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(SQL) <= set(QUERIES)
