"""Physical plans: pruned scans, no products of tables, no Python where built-ins do."""

import re

import pytest

from spindrift.plans import catalog

DATA = "/root/testdata/sf0.001"
PYTHON = {  # queries that need special functions, matrices or resampling in Python
    "rates_clopper_pearson", "fleet_poisson_bounds", "paired_bootstrap", "unpaired_bootstrap", "log_rank_p", "claim_fisher", "guard_levels_grouped", "mahalanobis", "unit_fingerprint", "fusion_fit", "hotspots", "calibrate_by_task",
    "baseline_detectors", "guard_replay",
    # the guard's state machine: built-ins can only fold it into an array per episode, in time quadratic in its steps
    "guard_levels", "guard_episodes", "alert_latency",
}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_plan(spark, name):
    if name in ("bradley_terry", "guard_replay", "baseline_detectors", "fusion_fit"):
        return  # fitted on the driver from sums; their plans are those of the parts
    plan = plan_of(catalog.QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in plan
    if name not in PYTHON:
        assert not re.search("Python|Pandas|Arrow", plan), name


@pytest.mark.parametrize("name,table,columns", [("rates_wilson", "orders", {"o_orderpriority", "o_orderstatus", "o_totalprice"}), ("claim_rates", "lineitem", {"l_returnflag", "l_linestatus", "l_discount"}), ("gripper_toggles", "events", {"user_id", "ts", "value"})])
def test_scans_read_only_what_is_used(spark, name, table, columns):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    read = set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<([^>]*)>", plan)[1]))
    assert read == columns


def test_filters_reach_the_scan(spark):
    plan = plan_of(catalog.QUERIES["rates_subset"](spark, DATA))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_orderstatus,F\)", plan)
