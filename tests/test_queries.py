"""Registered queries against DuckDB on the smallest tables (all of them: ``python tests/oracle.py sf0.001``)."""

import pytest

import __spark_entry__ as entry
from oracle import DATA, compare, connect

QUICK = [
    "player_stats", "court_zones", "box_iou_best_match", "contact_detect", "ball_active", "shot_cooldown", "position_buffer", "lifecycle_states", "eval_detect", "rolling_confidence",
    "best_detection", "nearest_frame", "locf_pose", "ball_trail", "tracklets", "cannot_link", "tracklet_distance", "ball_labels", "shot_labels", "court_labels", "epoch_median", "run_timing",
    "results_roundtrip", "reports_roundtrip", "court_filter_short", "primary_ball", "stream_rallies", "stream_stats", "stream_team_lock", "stream_lifecycle",
]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    for sf in ("sf0.001", "sf0.01"):  # a result without rows proves nothing: then the larger tables count
        diff = compare(entry.queries()[name](spark, f"{DATA}/{sf}"), connect(sf), entry.oracle_sql()[name])
        if diff != "EMPTY":
            break
    assert diff is None


@pytest.mark.parametrize("name", ["ball_trail", "epoch_median", "sequence_groups", "rolling_confidence", "step_distance"])
def test_ordered_queries_read_their_table_once(spark, name):
    df = entry.queries()[name](spark, f"{DATA}/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan
