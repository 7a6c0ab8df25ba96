"""Plan shape: no pairwise joins, no Python outside the two packing steps, filters and columns reach the scan."""

import re

import pytest

import __spark_entry__ as entry

# The training-data queries have tests of their own beside their subpackage.
QUERIES = {n: q for n, q in entry.queries().items() if n != "pipeline" and not re.match(r"op\d+_", n)}
PYTHON_ALLOWED = ("e16_greedy_chunks", "s09_shard_plan")
RUNS_JOBS = ("s", "t0", "d21", "d22", "d23", "e16", "w04", "w06")  # building these already writes or reads files


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(RUNS_JOBS)])
def test_no_pairwise_joins(spark, sf, name):
    plan = physical(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON_ALLOWED:
        assert "Python" not in plan and "InPandas" not in plan


def test_scan_is_pruned_and_filtered(spark, sf):
    plan = physical(QUERIES["s01_table_scan"](spark, sf))
    assert "PushedFilters: [IsNotNull(l_shipdate), IsNotNull(l_quantity)" in plan
    assert "l_extendedprice" not in plan


def test_top_per_key_limits_before_the_shuffle(spark, sf):
    plan = physical(QUERIES["k03_owner_holdings_page"](spark, sf))
    assert "WindowGroupLimit" in plan


def test_collectors_page_is_cut_before_the_join(spark, sf):
    plan = physical(QUERIES["k04_drop_collectors_page"](spark, sf))
    join = next(line for line in plan.splitlines() if "Join" in line)
    limit = next(line for line in plan.splitlines() if "WindowGroupLimit" in line)
    assert plan.index(join) < plan.index(limit)  # a plan is printed from its last step down
