"""Registered queries against their SQL at the smallest scale; all of them with ACCESSLENS_ALL=1."""

import os

import pytest

import __spark_entry__ as entry
from accesslens.plans import registry
from cross_check import SMALL, compare, duck

CORE = (
    "engineer_features", "profile_build", "profile_drift", "profile_value_frequency", "detect", "detect_salted", "classify",
    "analyst_summary", "feature_attribution", "build_alerts", "alert_history_window", "overview_metrics", "feature_summary",
    "roc_auc", "pr_auc", "curve_downsample", "eval_detection", "eval_classification", "eval_cold_start", "eval_concept_drift",
    "detection_stability", "period_drift", "paginate_alerts", "entity_sample_to_budget", "dq_report", "dq_distribution_sums",
    "scan_events", "sink_analyst_summary", "union_injected", "behaviour_summary", "ext_scoring_strategy", "stream_detect", "stream_features",
)
NAMES = tuple(registry.SQL) if os.environ.get("ACCESSLENS_ALL") else CORE


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    problem, _ = compare(spark, con, SMALL, entry.queries()[name], entry.oracle_sql()[name])
    assert problem == ""


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["entityId", "entity_type", "department", "alert_count", "max_risk", "highest_severity", "last_seen", "most_recent_alert"]
    assert df.count() > 0


def test_every_query_has_sql():
    assert set(registry.PLANS) == set(registry.SQL)
    assert set(registry.PLANS) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
