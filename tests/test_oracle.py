"""Every registered query against its SQL on the smallest tables."""

import pytest

from check_oracle import compare
from synthframe.plans.catalogue import all_oracles, all_queries
from .conftest import SMALL


def without_python_and_cross_joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert word not in plan, word


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, con, name):
    problem, rows, kind = compare(spark, con, SMALL, name, inspect=without_python_and_cross_joins)
    assert problem is None
    assert rows >= 0
    assert kind == "sql"


def test_every_query_has_an_oracle():
    assert set(all_oracles()) == set(all_queries())
