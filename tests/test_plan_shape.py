"""Physical-plan hygiene for the registered queries (sf0.001).

Every oracle-checked query must plan without cartesian products or nested
loop joins; the stratified split must not use a window (a label window would
put a whole class in one task); the flagship must prune columns at the scan
and push the null filter down.
"""

import __spark_entry__ as E

from .conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_or_nested_loop(spark):
    qs = E.queries()
    bad = []
    for name in sorted(E.oracle_sql()):
        plan = _plan(qs[name](spark, SF_SMALL))
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
            bad.append(name)
    assert bad == []


def test_split_has_no_window(spark):
    from boreframe.operators import prepare as I
    from boreframe.plans.q_analytics import labelled_normalized
    from boreframe.sources.testview import KEY
    sp = I.stratified_split(labelled_normalized(spark, SF_SMALL), "LABEL", KEY, 0.2)
    fo = I.stratified_folds(labelled_normalized(spark, SF_SMALL), "LABEL", KEY, 3)
    for df in (sp, fo):
        plan = _plan(df)
        assert "Window" not in plan
        assert "Exchange hashpartitioning(LABEL" not in plan


def test_flagship_prunes_and_pushes(spark):
    plan = _plan(E.entry(spark))
    assert "PushedFilters: [IsNotNull(l_partkey)]" in plan
    scan = [ln for ln in plan.splitlines() if "FileScan parquet" in ln and "lineitem" in ln][0]
    for unused in ("l_returnflag", "l_linestatus", "l_comment"):
        assert unused not in scan
