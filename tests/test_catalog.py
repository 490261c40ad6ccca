"""Every registered query: its plan, and its rows against its SQL twin."""

import re

import pytest

import check_queries as check
from catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # A window over the whole table would sort it in one task.
    assert not re.search(r"Window \[[^\n]*windowspecdefinition\((?:[^\n]*?)\)\], \[\],", plan)
    verdict = check.compare(con, df, ORACLE_SQL.get(name))
    assert verdict.startswith(("ok", "rows")) and verdict != "rows 0", verdict


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
