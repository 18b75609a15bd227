from __future__ import annotations

import oracle

from driftwise.operators.planning import repair_group_nodes
from driftwise.plans import registry

STATE = "id string, run_id string, detected_at timestamp_ntz, observed_state array<struct<node_url string, present boolean, collection string, change_vector string, last_modified string>>"


def test_observed_states_of_redelivered_mismatches_count_once(spark, tmp_path):
    from datetime import datetime

    seen = lambda present: [("a", present, "Users", "v", "t"), ("b", True, "users", "v", "t")]
    rows = [("1", "r", datetime(2026, 1, 1), seen(True)), ("2", "r", datetime(2026, 1, 1), seen(True)), ("2", "r", datetime(2026, 1, 2), seen(False)), ("3", "r", None, seen(False)), ("3", "r", None, seen(False))]
    spark.createDataFrame(rows, STATE).write.parquet(f"{tmp_path}/mismatches.parquet")
    got = registry.QUERIES["observed_states"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.select("node_url", "present", "n", "n_collections").collect()) == [("a", False, 2, 1), ("a", True, 1, 1), ("b", True, 3, 1)]
    assert oracle.difference(got, oracle.connect(str(tmp_path)), registry.SQL["observed_states"]) == ""


def test_nodes_of_a_group_are_the_union_over_its_documents(spark):
    rows = [("w", "Users", "v", "b,c"), ("w", "Users", "v", "a,b"), ("w", "users", "v", "b"), ("w", None, "v", ""), ("w", None, None, None)]
    got = repair_group_nodes(spark.createDataFrame(rows, "winner_node string, collection string, winner_cv string, affected_nodes string"))
    assert {tuple(r) for r in got.collect()} == {("w", "Users", "v", "a,b,c", 3), ("w", "users", "v", "b", 1), ("w", None, "v", "", 0), ("w", None, None, "", 0)}
