"""Plan checks: the physical plans have the shape the design relies on."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_MID

ANALYTICS = ["daily_summary", "anomaly_candidates", "seasonal_peaks", "correlation_aq_aq", "trend", "health_impact"]
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"]


def _plan(spark, name):
    return E.queries()[name](spark, SF_MID)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ANALYTICS)
def test_analytics_plans_are_pure_jvm_and_pruned(spark, name):
    plan = _plan(spark, name)
    assert not [k for k in FORBIDDEN if k in plan]
    assert "PushedFilters: [" in plan and "ts" in plan.split("PushedFilters: [", 1)[1].split("]", 1)[0]


def test_simple_forecast_limits_before_the_shuffle(spark):
    plan = _plan(spark, "simple_forecast")
    assert "WindowGroupLimit" in plan and "Partial" in plan.split("WindowGroupLimit")[-1]


def test_exact_percentiles_keep_no_value_map(spark):
    # quartiles come from (key, value) counts with running totals, not from a percentile buffer
    assert "percentile" not in _plan(spark, "anomaly_candidates")


def test_fusion_has_no_cartesian_join(spark):
    plan = _plan(spark, "grid_fusion")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
