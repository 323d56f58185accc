"""Every registered query against its SQL on the smallest data set, and plan shape."""

import os

import pytest

from tests.harness import connect, difference
from veilframe.plans import QUERIES, SQL
from veilframe.plans.base import SECRET

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert difference(spark, con, SF, name) is None


def test_sql_names_registered_queries():
    assert set(SQL) <= set(QUERIES)


# All but the queries on the ledger fold, the one operator that uses Python on executors.
PYTHON_FREE = [
    n for n in QUERIES
    if not n.startswith(("dp_answer_log", "ledger", "audit", "all_budgets", "budget", "user_list", "system", "status", "query", "queries",
                         "team_roster", "erase"))
]


@pytest.mark.parametrize("name", PYTHON_FREE)
def test_rows_never_pass_through_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "PythonUDF" not in plan and "MapInPandas" not in plan


def plan_text(df):
    return df._jdf.queryExecution().toString()


# one side is a one-row aggregate
NESTED_LOOPS: set[str] = set()

STREAMS = {"ledger_stream", "privatize_stream", "audit_window_counts"}


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in STREAMS])
def test_plan_shape(spark, name):
    """No unbounded cross join, no window over ungrouped rows, no secret in a printed plan."""
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    # a nested loop is only met with a side of one row, or of one row per partition or policy
    for line in plan.splitlines():
        if "BroadcastNestedLoopJoin" in line:
            assert name in NESTED_LOOPS, line
    assert SECRET not in plan_text(df)
