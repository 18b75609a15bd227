from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from driftwise.operators import recovery
from driftwise.operators.replicas import Node
from driftwise.sinks.files import upsert_changed

RUN = "run_id string, run_mode string, scan_mode string, started_at timestamp_ntz, last_saved_at timestamp_ntz, is_complete boolean, current_phase string, safe_restart_etag bigint, repairs_planned bigint, mismatches_found bigint, source_repair_plan_run_id string, source_snapshot_run_id string, source_snapshot_cache_run_id string, source_node_index int"


def execution(id, plan, status, operation=None, documents=("d/1",), counts=(None, None, None), run="r"):
    return (run, id, plan, "scan", status, operation, None if documents is None else list(documents), *counts)


def test_resume_state(spark):
    rows = [
        execution("1", "p/1", "PatchCompletedOnWinner", 1, ("a", "b", "c"), (3, 2, 1), "counted"),
        execution("2", "p/2", "PatchFailed", 2, ("a", "b"), (None, None, None), "counted"),
        execution("3", "p/1", "PatchStarted", 42, run="started"),
        execution("4", "p/1", "PatchStarted", None, run="started without operation"),
        execution("5", "p/1", "PatchDispatching", None, run="blocked"),
        execution("6", "p/1", "PatchDispatching", 5, run="dispatched"),
        execution("7", "p/1", "PatchFailed", 1, run="twice"),
        execution("8", "P/1", "PatchCompletedOnWinner", 2, run="twice"),
        execution("9", "p/1", "PatchCompletedOnWinner", 11, ("u/1", "u/2"), run="inferred"),
        execution("10", "p/2", "SkippedStateChanged", 12, ("u/3",), run="inferred"),
        execution("11", " ", None, None, None, run="no plan"),
    ]
    df = spark.createDataFrame(rows, recovery.EXECUTION).withColumn("plan", F.lit("clash"))
    got = {r["run_id"]: (r["n_completed"], r["n_blocked"], r["n_started"], r["attempted"], r["patched"], r["failed"], r["n_repeated_plans"], r["resumable"]) for r in recovery.resume_state(df).collect()}
    assert got == {
        "counted": (2, 0, 0, 5, 2, 3, 0, True), "started": (0, 0, 1, 0, 0, 0, 0, True), "started without operation": (0, 0, 0, 0, 0, 0, 0, True),
        "blocked": (0, 1, 0, 0, 0, 0, 0, True), "dispatched": (0, 0, 0, 0, 0, 0, 0, True), "twice": (2, 0, 0, 2, 1, 1, 1, False),
        "inferred": (2, 0, 0, 2, 2, 0, 0, True), "no plan": (0, 0, 0, 0, 0, 0, 0, False),
    }
    assert recovery.resume_state(df.limit(0)).count() == 0
    assert [tuple(r) for r in recovery.blocked_counts(df).collect()] == [("blocked", "scan", 1)]
    plans = spark.createDataFrame([("P/1",), ("p/3",)], "plan_id string")
    assert sorted((r["plan_id"], r["execution_status"], r["open"]) for r in recovery.plan_progress(plans, df.where("run_id = 'twice'")).collect()) == [("P/1", "PatchCompletedOnWinner", False), ("p/3", None, True)]


@pytest.mark.parametrize(("applying", "untold"), [(True, "PatchFailed"), (False, "SkippedStateChanged")])
def test_patch_outcomes_without_details(spark, applying, untold):
    rows = [execution(i, f"p/{i}", "PatchStarted", 1, ("a", "A", "b")) for i in "123"] + [execution("4", "p/4", "PatchStarted", 1, None)]
    details = spark.createDataFrame([("3", "A", "Patched"), ("3", "b", "Skipped"), ("2", None, "Patched")], "id string, document_id string, detail string")
    totals = spark.createDataFrame([("1", 2), ("2", 0), ("3", 0)], "id string, total long")
    got = recovery.patch_outcomes(spark.createDataFrame(rows, recovery.EXECUTION), details, totals, applying=applying)
    done = "PatchCompletedOnWinner"
    assert sorted(tuple(r) for r in got.collect()) == [("1", "A", done), ("1", "B", done), ("2", "A", untold), ("2", "B", untold), ("3", "A", done), ("3", "B", "PatchFailed")]
    groups = {r["id"]: (r["n_patched"], r["repair_status"], r["error"]) for r in recovery.outcome_counts(got).collect()}
    assert groups == {"1": (2, done, None), "2": (0, "SkippedStateChanged", "Non-patched documents in group: 2 of 2."), "3": (1, done, "Non-patched documents in group: 1 of 2.")}


def run(id, mode, day, complete, etag=None, planned=None, of=None, node=0, saved=None, phase=None, snapshot=None, cache=None, scan="AllMismatches", found=None):
    return (id, mode, scan, datetime(2026, 1, day), saved and datetime(2026, 1, saved), complete, phase, etag, planned, found, of, snapshot, cache, node)


def test_node_work(spark):
    scan, apply = "LiveETagScan", "ApplyRepairPlan"
    runs = [
        run("s1", scan, 1, False, 40, 0, node=1),
        run("s2", scan, 1, True, 50, 3, node=2),
        run("s3", scan, 1, True, 60, 3, node=3), run("a3", apply, 2, False, of="s3", node=None),
        run("s4", scan, 1, True, 70, 3, node=4), run("a4", apply, 2, True, of="s4", node=None),
        run("s5", scan, 1, True, 80, 3, node=5), run("a5", apply, 2, False, of="s5", node=None), run("s5b", scan, 3, True, 90, 0, node=5),
        run("s6", scan, 4, True, 10, 0, node=6), run("s6b", scan, 1, False, None, 0, node=6, saved=9),
        run("s7", scan, 1, False, 11, 2, node=7), run("a7", apply, 2, False, of="s7", node=None),
        run("other", "DryRunRepair", 9, True, 99, 9, node=0),
    ]
    nodes = spark.createDataFrame([(i,) for i in range(8)], "node_idx int")
    got = sorted(tuple(r) for r in recovery.node_work(spark.createDataFrame(runs, RUN), nodes).collect())
    assert got == [
        (0, "StartScan", 0, None, None), (1, "ResumeScan", 40, "s1", None), (2, "StartApply", 50, "s2", None), (3, "ResumeApply", 60, "s3", "a3"), (4, "StartScan", 70, "s4", None),
        (5, "StartScan", 90, "s5b", None), (6, "ResumeScan", 0, "s6b", None), (7, "ResumeApply", 11, "s7", "a7"),
    ]


def test_runs_that_can_be_resumed(spark):
    runs = [
        run("import", "ImportSnapshots", 1, False, phase="SnapshotImport"), run("late import", "ImportSnapshots", 1, False, phase="CandidateProcessing"), run("done", "ImportSnapshots", 1, True, phase="SnapshotImport"),
        run("download", "DownloadSnapshotsToCache", 1, False, phase="SnapshotCacheDownload"), run("apply", "ApplyRepairPlan", 1, False, phase="SnapshotCacheDownload"),
        run("cached", "ImportCachedSnapshotsToStateStore", 1, False, phase="SnapshotImport", cache="c"), run("cached from nowhere", "ImportCachedSnapshotsToStateStore", 1, False, phase="SnapshotImport", cache=" "),
        run("waiting", "ScanOnly", 1, False, phase="WaitingForSnapshotIndex", snapshot="s"), run("candidates", "DryRunRepair", 1, False, phase="CandidateProcessing", snapshot="s"), run("no snapshot", "DryRunRepair", 1, False, phase="CandidateProcessing"),
        run("found one", "ScanOnly", 1, False, phase="CandidateProcessing", snapshot="s", scan="FirstMismatch", found=1), run("found none", "ScanOnly", 1, False, phase="CandidateProcessing", snapshot="s", scan="FirstMismatch", found=0), run("live", "LiveETagScan", 1, False),
    ]
    got = {r[0]: r[1] for r in spark.createDataFrame(runs, RUN).select("run_id", recovery.resumable_as()).collect()}
    assert got == {
        "import": "import", "late import": None, "done": None, "download": "download", "apply": None, "cached": "cached import", "cached from nowhere": None, "waiting": "analysis", "candidates": "analysis", "no snapshot": None,
        "found one": None, "found none": "analysis", "live": "analysis",
    }


STATE = "array<struct<node_url string, present boolean, collection string, change_vector string, last_modified string>>".replace(" string", ":string").replace(" boolean", ":boolean")
NODES = [Node(0, "A", "a", "http://a"), Node(1, "B", "b", "http://b")]


def test_observed_states_agree_without_ignored_segments(spark):
    here = lambda cv, url="http://A": (url, True, "Users", cv, None)
    gone = ("http://b", False, None, None, None)
    cases = [
        ([here("A:5-x,TRXN:7-old")], [here("A:5-x"), gone], True), ([here("A:5-x")], [here("A:6-x")], False), ([here("A:5-x")], [("http://a", True, "USERS", "Z:5-x", None)], True),
        ([here("A:5-x")], [here("A:5-x"), here("A:5-x", "http://b")], False), ([], [gone], True), (None, [], True), ([here("A:5-x", "http://elsewhere")], [], True),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], f"i int, a {STATE}, b {STATE}")
    told = lambda ignored: [r[1] for r in df.select("i", recovery.observed_unchanged(F.col("a"), F.col("b"), NODES, ignored)).orderBy("i").collect()]
    assert told(["old"]) == [c[2] for c in cases] and told([]) == [False, *[c[2] for c in cases[1:]]]


def test_revalidated(spark):
    seen = [("http://a", True, "Users", "A:5-x", None), ("http://b", False, None, None, None)]
    saved = spark.createDataFrame([(k, "Users", "http://a", "A:5-x", seen) for k in ("SAME", "CONSISTENT", "OTHER WINNER", "AMBIGUOUS", "OTHER STATE", "OTHER CASE")], f"document_key string, collection string, winner_node string, winner_cv string, observed_state {STATE}")
    now = [("SAME", "MISSING", "http://a", "A:5-x", "Users"), ("OTHER WINNER", "MISSING", "http://b", "A:5-x", "Users"), ("AMBIGUOUS", "AMBIGUOUS_CV", "http://a", "A:5-x", "Users"), ("OTHER STATE", "MISSING", "http://a", "A:5-x", "Users"), ("OTHER CASE", "MISSING", "HTTP://A", "B:5-x", "USERS")]
    aligned = spark.createDataFrame([(k, [seen[0], ("http://b", True, "Users", "A:1-x", None)] if k == "OTHER STATE" else seen) for k, *_ in now], f"document_key string, states {STATE}")
    got = {r[0]: tuple(r[1:]) for r in recovery.revalidated(saved, spark.createDataFrame(now, "document_key string, mismatch_type string, winner_node string, winner_cv string, collection string"), aligned, NODES).collect()}
    changed = ("SkippedStateChanged", "ChangedStillInconsistent")
    assert got == {"SAME": ("Eligible", None), "OTHER CASE": ("Eligible", None), "CONSISTENT": ("SkippedAlreadyConsistent", "ConsistentNow"), "OTHER WINNER": changed, "AMBIGUOUS": changed, "OTHER STATE": changed}


def test_fixed_up(spark):
    rows = [("1", "r", "a", "SkippedAlreadyPlanned", None), ("2", "r", "B", "SkippedAlreadyPlanned", ""), ("3", "q", "b", "PatchPlannedDryRun", "PatchCompletedOnWinner"), ("4", "r", "c", "PatchPlannedDryRun", None), ("5", "r", None, "SkippedAlreadyPlanned", None)]
    df = spark.createDataFrame(rows, "id string, run_id string, document_id string, repair_decision string, current_repair_decision string")
    assert sorted((r["id"], r["repair_decision"], r["current_repair_decision"]) for r in recovery.fixed_up(df).collect()) == [("1", "PatchPlannedDryRun", "PatchPlannedDryRun"), ("5", "PatchPlannedDryRun", "PatchPlannedDryRun")]


def test_upserts_leave_equal_rows_alone(spark):
    schema = "k string, v string, at long"
    current = spark.createDataFrame([("a", "x", 1), ("b", "x", None), ("c", "x", 1), (None, "x", 1)], schema)
    changes = spark.createDataFrame([("a", "x", 1), ("b", "x", None), ("c", "x", None), ("d", None, None), (None, "y", 1)], schema)
    got = sorted((r["k"] or "", r["outcome"]) for r in upsert_changed(current, changes, ["k"], ["v", "at"]).collect())
    assert got == [("", "updated"), ("c", "updated"), ("d", "inserted")]
    assert upsert_changed(current.limit(0), changes, ["k"], ["v"]).count() == 5
