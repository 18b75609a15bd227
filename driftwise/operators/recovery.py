"""Applied plans and interrupted runs: what was done, what is blocked, what still holds, and what is to be done next."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwise import fixed
from driftwise.functions.vectors import blank, key, normalize
from driftwise.operators.planning import effective_decision, without
from driftwise.operators.replicas import Node

EXECUTION = (
    "run_id string, id string, source_repair_plan_id string, source_repair_plan_run_id string, repair_status string, patch_operation_id bigint, "
    "document_ids array<string>, documents_attempted bigint, documents_patched bigint, documents_failed bigint"
)
SKIPS = [fixed.STATE_CHANGED, fixed.ALREADY_CONSISTENT, fixed.BY_OPERATOR]


# executions


def is_terminal(status: Column) -> Column:
    """Whether an execution has ended. Never null."""
    return F.coalesce(status.isin(fixed.PATCHED, fixed.PATCH_FAILED, *SKIPS), F.lit(False))


def is_blocked(status: Column, operation: Column) -> Column:
    """Sent, but no operation is known: it may or may not have been carried out. Never null."""
    return F.coalesce(status == fixed.DISPATCHING, F.lit(False)) & operation.isNull()


def is_started(status: Column, operation: Column) -> Column:
    """Sent, with a known operation. Never null."""
    return F.coalesce(status == fixed.STARTED, F.lit(False)) & operation.isNotNull()


def resume_state(executions: DataFrame) -> DataFrame:
    """One row for each run: ``n_executions``, ``n_completed``, ``n_blocked``, ``n_started``, ``attempted``, ``patched`` and
    ``failed`` (documents of executions that have ended), ``n_without_plan``, ``n_repeated_plans`` (plans, ignoring case, with
    more than one execution) and ``resumable``: whether there are neither.

    Counts that an execution doesn't have follow from its status: skipped documents were not attempted, a patched group
    has patched all, a failed one none. A null run is a run. Two aggregations, by plan and by run, both combined on the map
    side, so no list of a run's executions is made."""
    status, operation = F.col("repair_status"), F.col("patch_operation_id")
    held = F.greatest(F.coalesce(F.size("document_ids"), F.lit(0)), F.lit(0)).cast("bigint")
    done, skipped = is_terminal(status), F.coalesce(status.isin(SKIPS), F.lit(False))
    attempted = F.coalesce("documents_attempted", F.when(skipped, F.lit(0)).otherwise(held))
    patched = F.coalesce("documents_patched", F.when(status == fixed.PATCHED, held).otherwise(F.lit(0)))
    failed = F.coalesce(
        "documents_failed",
        F.when(status == fixed.PATCHED, F.greatest(F.lit(0), attempted - patched)).when(skipped, F.lit(0)).otherwise(attempted),
    )
    plan = F.when(~blank(F.col("source_repair_plan_id")), key(F.col("source_repair_plan_id")))
    counted = {
        "n_completed": done, "n_blocked": is_blocked(status, operation), "n_started": is_started(status, operation), "n_without_plan": plan.isNull(),
    }
    sums = {"attempted": attempted, "patched": patched, "failed": failed}
    by_plan = executions.groupBy("run_id", plan.alias("plan")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(c).alias(n) for n, c in counted.items()],
        *[F.sum(F.when(done, c).otherwise(F.lit(0))).alias(n) for n, c in sums.items()],
    )
    by_run = by_plan.groupBy("run_id").agg(
        F.sum("n").alias("n_executions"),
        *[F.sum(n).alias(n) for n in [*counted, *sums]],
        F.count_if(F.col("plan").isNotNull() & (F.col("n") > 1)).alias("n_repeated_plans"),
    )
    return by_run.withColumn("resumable", (F.col("n_without_plan") == 0) & (F.col("n_repeated_plans") == 0))


def blocked_counts(executions: DataFrame) -> DataFrame:
    """Blocked executions of each run and planning run, of those that name plan and planning run."""
    named = (F.coalesce("source_repair_plan_id", F.lit("")) != "") & (F.coalesce("source_repair_plan_run_id", F.lit("")) != "")
    return executions.where(is_blocked(F.col("repair_status"), F.col("patch_operation_id")) & named).groupBy(
        "run_id", "source_repair_plan_run_id"
    ).agg(F.count(F.lit(1)).alias("n_blocked"))


def plan_progress(plans: DataFrame, executions: DataFrame) -> DataFrame:
    """Plans (``plan_id``) with the status of their execution, and whether it is still to be run (``open``). Several executions
    of a plan: the one with the greatest id."""
    last = executions.where(~blank(F.col("source_repair_plan_id"))).groupBy(key(F.col("source_repair_plan_id")).alias("_p")).agg(
        F.max(F.struct("id", "repair_status")).alias("w")
    )
    joined = plans.join(last, key(F.col("plan_id")) == F.col("_p"), "left")
    return joined.select(*plans.columns, F.col("w.repair_status").alias("execution_status"), (~is_terminal(F.col("w.repair_status"))).alias("open"))


def patch_decision(detail: Column) -> Column:
    """What a patch's report on a document means for it; null without a report."""
    return F.when(detail == fixed.DETAIL_PATCHED, fixed.PATCHED).when(detail == fixed.DETAIL_ABSENT, fixed.STATE_CHANGED).when(
        detail.isNotNull(), fixed.PATCH_FAILED
    )


def patch_outcomes(executions: DataFrame, details: DataFrame, totals: DataFrame, *, applying: bool) -> DataFrame:
    """One row for each execution (``id``) and document: ``document_key`` and ``decision``.

    ``details``: execution ``id``, ``document_id``, ``detail``, of several for a document the greatest; ``totals``: ``id`` and
    ``total``, the number of documents that the patch says it handled. An operation without any detail that handled
    some has patched all; a document without a detail where others have one was patched if some were handled, else it has
    changed (found while scanning) or failed (``applying``)."""
    documents = executions.select("id", F.explode("document_ids").alias("d")).select("id", key(F.col("d")).alias("document_key")).distinct()
    told = details.where(~blank(F.col("document_id"))).groupBy(F.col("id").alias("ti"), key(F.col("document_id")).alias("tk")).agg(F.max("detail").alias("detail"))
    handled = totals.groupBy(F.col("id").alias("hi")).agg(F.max("total").alias("total"))
    joined = documents.join(told, (F.col("id") == F.col("ti")) & (F.col("document_key") == F.col("tk")), "left").join(handled, F.col("id") == F.col("hi"), "left")
    untold = F.when(F.coalesce("total", F.lit(0)) > 0, fixed.PATCHED).otherwise(fixed.PATCH_FAILED if applying else fixed.STATE_CHANGED)
    return joined.select("id", "document_key", F.coalesce(patch_decision(F.col("detail")), untold).alias("decision"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """For each execution its documents, those patched, and the status and error text of the group."""
    counted = outcomes.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("decision") == fixed.PATCHED).alias("n_patched")
    )
    other = F.col("n_documents") - F.col("n_patched")
    return counted.select(
        "id", "n_documents", "n_patched",
        F.when(F.col("n_patched") > 0, fixed.PATCHED).otherwise(fixed.STATE_CHANGED).alias("repair_status"),
        F.when(other > 0, F.format_string("Non-patched documents in group: %d of %d.", other, F.col("n_documents"))).alias("error"),
    )


# plans


def observed_unchanged(observed: Column, states: Column, nodes: Sequence[Node], ignored: Iterable[str] = ()) -> Column:
    """Whether two arrays of states agree on every configured node, a state that isn't there being absent: presence,
    collection (ignoring case) and normalised vector, without ``ignored`` database ids."""
    ignored = list(ignored)
    state = lambda s: F.when(s.present, F.struct(key(F.coalesce(s.collection, F.lit(""))), normalize(s.change_vector, ignored)))
    of = lambda c, n: F.get(F.transform(F.filter(c, lambda s: key(s.node_url) == n.url.upper()), state), F.lit(0))
    same = F.lit(True)
    for n in nodes:
        same = same & of(observed, n).eqNullSafe(of(states, n))
    return same


def revalidated(saved: DataFrame, now: DataFrame, aligned: DataFrame, nodes: Sequence[Node], ignored: Iterable[str] = ()) -> DataFrame:
    """Saved mismatches against the present: ``document_key``, ``outcome`` (Eligible, SkippedAlreadyConsistent or
    SkippedStateChanged) and ``reason`` (null for eligible ones).

    ``saved``: one row a document with ``document_key``, collection, winner_node, winner_cv and observed_state; ``now``: what
    :func:`evaluate` says; ``aligned``: what it was given. A plan is eligible if the document is still inconsistent, in a
    way that can be repaired, with the same winner, collection and winning vector, and in the state that was observed."""
    ignored = list(ignored)
    found = now.select(F.col("document_key").alias("nk"), F.struct("mismatch_type", "winner_node", "winner_cv", "collection").alias("f"))
    states = aligned.select(F.col("document_key").alias("ak"), "states")
    joined = saved.join(found, F.col("document_key") == F.col("nk"), "left").join(states, F.col("document_key") == F.col("ak"), "left")
    same = (
        ~F.col("f.mismatch_type").isin(fixed.AMBIGUOUS_CV, fixed.COLLECTION_MISMATCH)
        & key(F.col("f.winner_node")).eqNullSafe(key(F.col("winner_node")))
        & key(F.col("f.collection")).eqNullSafe(key(F.col("collection")))
        & (key(normalize(F.col("f.winner_cv"), ignored)) == key(normalize(F.col("winner_cv"), ignored)))
        & observed_unchanged(F.col("observed_state"), F.col("states"), nodes, ignored)
    )
    return joined.select(
        "document_key",
        F.when(F.col("nk").isNull(), fixed.ALREADY_CONSISTENT).when(same, "Eligible").otherwise(fixed.STATE_CHANGED).alias("outcome"),
        F.when(F.col("nk").isNull(), fixed.CONSISTENT_NOW).when(~same, fixed.STILL_INCONSISTENT).alias("reason"),
    )


def fixed_up(mismatches: DataFrame) -> DataFrame:
    """Mismatches that were skipped as planned before though nothing repaired their document, as planned ones."""
    repaired = mismatches.where(effective_decision() == fixed.PATCHED)
    skipped = mismatches.where(F.col("repair_decision") == fixed.ALREADY_PLANNED)
    return without(skipped, key(F.col("document_id")), repaired, key(F.col("document_id"))).select(
        "id", "run_id", "document_id", F.lit(fixed.PLANNED).alias("repair_decision"), F.lit(fixed.PLANNED).alias("current_repair_decision")
    )


def executable_order(priority: Column) -> list[Column]:
    """The order in which plans are carried out: those with a priority by it, the others by winner node, collection and id."""
    return [priority.asc_nulls_last(), F.col("winner_node").asc_nulls_first(), F.col("collection").asc_nulls_first(), F.col("item_id")]


# runs


def recency() -> Column:
    return F.coalesce("last_saved_at", "started_at")


def node_work(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """What each node (``node_idx``) is to do next: ``action``, ``start_etag``, ``scan_run`` and ``apply_run``.

    The latest live scan of the node decides, by when it was last heard of, then by its start, then by its id: without one a
    scan starts at 0; an unfinished run that applies its plan is resumed, else the scan if it is unfinished; a
    finished scan with plans and without a finished run that applies them has them applied; else a new scan
    starts at its restart etag."""
    order = lambda *more: F.struct(recency().alias("at"), "started_at", "run_id", *more)
    scans = runs.where(F.col("run_mode") == fixed.LIVE_SCAN).groupBy(F.col("source_node_index").alias("i")).agg(
        F.max(order("is_complete", "safe_restart_etag", "repairs_planned")).alias("s")
    )
    applied = runs.where(F.col("run_mode") == fixed.APPLY).groupBy(F.col("source_repair_plan_run_id").alias("of")).agg(
        F.max(F.when(~F.col("is_complete"), order())).alias("open"), F.coalesce(F.bool_or("is_complete"), F.lit(False)).alias("done")
    )
    joined = nodes.select("node_idx").join(scans, F.col("node_idx") == F.col("i"), "left").join(applied, F.col("s.run_id") == F.col("of"), "left")
    action = (
        F.when(F.col("s").isNull(), fixed.START_SCAN)
        .when(F.col("open").isNotNull(), fixed.RESUME_APPLY)
        .when(~F.col("s.is_complete"), fixed.RESUME_SCAN)
        .when((F.coalesce("s.repairs_planned", F.lit(0)) > 0) & ~F.coalesce("done", F.lit(False)), fixed.START_APPLY)
        .otherwise(fixed.START_SCAN)
    )
    return joined.select(
        "node_idx", action.alias("action"), F.coalesce("s.safe_restart_etag", F.lit(0)).alias("start_etag"), F.col("s.run_id").alias("scan_run"), F.col("open.run_id").alias("apply_run")
    )


def run_policies(mode: Column) -> dict[str, Column]:
    """What a run mode needs, by name. Never null."""
    among = lambda *modes: F.coalesce(mode.isin(*modes), F.lit(False))
    return {
        "needs_cluster": among(fixed.IMPORT, fixed.DOWNLOAD, fixed.SCAN_AND_REPAIR, fixed.APPLY, fixed.LIVE_SCAN),
        "needs_startup_check": among(fixed.IMPORT, fixed.DOWNLOAD, fixed.SCAN_AND_REPAIR, fixed.APPLY, fixed.LIVE_SCAN),
        "needs_fresh_semantics": among(fixed.IMPORT, fixed.DOWNLOAD, fixed.SCAN_AND_REPAIR, fixed.LIVE_SCAN),
        "needs_semantics": among(fixed.IMPORT, fixed.DOWNLOAD, fixed.SCAN_ONLY, fixed.DRY_RUN, fixed.SCAN_AND_REPAIR, fixed.LIVE_SCAN),
        "evaluates_locally": among(fixed.SCAN_ONLY, fixed.DRY_RUN),
    }


def resumable_as(imported: Column | None = None) -> Column:
    """As what a run can be resumed: import, download, cached import, analysis, or null. ``imported``: whether its import is
    complete, false where runs don't say."""
    mode, phase = F.col("run_mode"), F.col("current_phase")
    importing = (phase == fixed.PHASE_IMPORT) & ~(F.lit(False) if imported is None else imported)
    ended_early = (mode == fixed.SCAN_ONLY) & (F.col("scan_mode") == fixed.FIRST_MISMATCH) & (F.coalesce("mismatches_found", F.lit(0)) > 0)
    analysing = mode.isin(fixed.LIVE_SCAN, fixed.CROSS_CHECK) | (
        ~mode.isin(fixed.IMPORT, fixed.DOWNLOAD, fixed.CACHED_IMPORT, fixed.APPLY, fixed.FIXUP)
        & ~blank(F.col("source_snapshot_run_id")) & ~F.coalesce(ended_early, F.lit(False)) & phase.isin(fixed.PHASE_INDEX, fixed.PHASE_CANDIDATES)
    )
    return F.when(
        ~F.col("is_complete"),
        F.when((mode == fixed.IMPORT) & importing, "import")
        .when((mode == fixed.DOWNLOAD) & (phase == fixed.PHASE_DOWNLOAD), "download")
        .when((mode == fixed.CACHED_IMPORT) & ~blank(F.col("source_snapshot_cache_run_id")) & importing, "cached import")
        .when(analysing, "analysis"),
    )


def health(stale_after: float) -> Column:
    """The state of a service from ``fatal``, ``scheduled``, ``configured``, ``retrying``, ``expected_mode`` and
    ``seconds_since_progress`` (null: none yet)."""
    waiting = F.when(F.col("retrying"), "retrying").otherwise("starting")
    return (
        F.when(F.col("fatal"), "fatal")
        .when(~F.col("scheduled"), "wrong-mode")
        .when(~F.col("configured"), waiting)
        .when(~F.col("expected_mode"), "wrong-mode")
        .when(F.col("seconds_since_progress").isNull(), waiting)
        .when(F.col("seconds_since_progress") <= stale_after, "ok")
        .otherwise("stale")
    )
