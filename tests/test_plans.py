"""Physical-plan properties of registered queries (pushdown, pruning, partial aggregation)."""

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _plan(spark, name):
    return E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_filter_pushed_to_scan(spark):
    plan = _plan(spark, "filter_equals")
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan


def test_projection_pruned(spark):
    plan = _plan(spark, "select_columns")
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line][0]
    assert "o_orderdate" not in scan and "o_orderpriority" not in scan


def test_grouped_aggregate_is_partial_then_final(spark):
    plan = _plan(spark, "grouped_mean")
    assert "partial_avg" in plan and "Exchange hashpartitioning(l_linestatus" in plan
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line][0]
    assert "l_orderkey" not in scan  # only the two columns used are read


def test_overview_combines_duplicates_map_side(spark):
    plan = _plan(spark, "overview")
    assert "partial_count" in plan
