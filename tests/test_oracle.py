"""Registered queries against DuckDB at the smallest scale, and shapes of plans.

By default one or two queries per family; ``ORACLE_ALL=1`` runs every one of them.
"""

import os

import pytest

from oracle import compare, connect
from skytriage.plans import load_all
from skytriage.plans.registry import ORACLES, QUERIES

load_all()
SF = "/root/testdata/sf0.001"
QUICK = ["b1_b8_box_measures", "b9_iou_pairs", "c1_generate_tiles", "c2_c3_merge_tiles_nms", "d1_affinity", "e2_e13_track_features", "f3_f4_evaluate_dataset",
         "f7_f9_false_alarm_rate_per_clip", "g1_grouped_split", "g3_track_census", "h3_feature_ranges", "i7_compare_arms", "j3_match_authorization", "j5_query_history",
         "j8_j9_decide", "l7_lockout_streaks", "a9_source_notes"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("ORACLE_ALL") else QUICK)
def test_query(spark, con, name):
    ok, message = compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert ok, message


@pytest.mark.parametrize("name", ["b9_iou_pairs", "d1_affinity", "e2_e13_track_features", "g3_track_census", "j3_match_authorization", "j5_query_history", "j7_assemble_evidence", "l7_lockout_streaks"])
def test_no_products(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_is_pruned(spark):
    plan = QUERIES["j14_action_budget"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "props" not in plan
