"""Queries on applied plans, interrupted runs and stored versions, with their SQL.

The test data has no table of executions: they are literal rows, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwise import fixed
from driftwise.functions.vectors import key, normalize
from driftwise.operators import planning, recovery, replicas, views
from driftwise.plans import audit
from driftwise.plans.audit import ALIGNED, EFFECTIVE, ETAG, EVALUATED, LIVE
from driftwise.plans.sqltext import blank as sql_blank
from driftwise.plans.sqltext import cv_norm, present
from driftwise.session import scratch
from driftwise.sinks.files import upsert_changed
from driftwise.sources.tables import table
from driftwise.streaming.deliveries import DeliveryStore
from driftwise.streaming.feeds import once_a_run

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# executions: run, id, plan, planning run, status, operation, documents, attempted, patched, failed

EXECUTIONS = [
    ("apply/1", "e1", "plans/1", "scan/1", "PatchCompletedOnWinner", 11, ["a/1", "a/2", "a/3"], None, None, None),
    ("apply/1", "e2", "plans/2", "scan/1", "PatchCompletedOnWinner", 12, ["b/1", "b/2"], 2, 1, 1),
    ("apply/1", "e3", "plans/3", "scan/1", "PatchFailed", 13, ["c/1"], None, None, None),
    ("apply/1", "e4", "plans/4", "scan/1", "SkippedStateChanged", None, ["d/1", "d/2"], None, None, None),
    ("apply/1", "e5", "plans/5", "scan/1", "PatchDispatching", None, ["f/1"], None, None, None),
    ("apply/1", "e6", "plans/6", "scan/1", "PatchStarted", 16, ["g/1", "G/1", "g/2"], None, None, None),
    ("apply/2", "e7", "plans/7", "scan/2", "PatchDispatching", None, ["h/1"], None, None, None),
    ("apply/2", "e8", "PLANS/7", "scan/2", "PatchDispatching", 18, ["h/2"], None, None, None),
    ("apply/2", "e9", " ", "scan/2", "PatchDispatching", None, [], None, None, None),
    ("apply/3", "e10", "plans/9", "", "PatchDispatching", None, ["i/1"], None, None, None),
    ("apply/3", "e11", None, "scan/3", "SkippedByOperator", None, None, 5, None, None),
    ("apply/3", "e12", "plans/10", "scan/3", "PatchDispatching", None, ["j/1"], None, None, None),
]
DETAILS = [("e1", "A/1", "Patched"), ("e1", "a/2", "DocumentDoesNotExist"), ("e2", "b/1", "Patched"), ("e2", "b/2", "NotModified"), ("e3", " ", "Patched"), ("e4", "d/1", "Created")]
TOTALS = [("e1", 3), ("e2", 2), ("e3", 0), ("e4", 0), ("e5", 1), ("e6", 2), ("e7", None)]


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, list):
        return "CAST([" + ", ".join(map(_literal, x)) + "] AS VARCHAR[])"
    return str(x).lower() if isinstance(x, (bool, int, float)) else f"'{x}'"


def _values(rows: list[tuple], name: str, columns: str) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + ")"


EXECUTION_COLUMNS = ", ".join(c.split(" ")[0] for c in recovery.EXECUTION.split(", "))
E = "WITH " + _values(EXECUTIONS, "e", EXECUTION_COLUMNS)
ENDED = "coalesce(repair_status IN ('PatchCompletedOnWinner', 'PatchFailed', 'SkippedStateChanged', 'SkippedAlreadyConsistent', 'SkippedByOperator'), false)"
SKIPPED = "repair_status IN ('SkippedStateChanged', 'SkippedAlreadyConsistent', 'SkippedByOperator')"


def _executions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXECUTIONS, recovery.EXECUTION)


@query(
    E
    + f""", x AS (SELECT *, {ENDED} AS ended, coalesce(len(document_ids), 0) AS held FROM e), y AS (SELECT *, coalesce(documents_attempted, CASE WHEN {SKIPPED} THEN 0 ELSE held END) AS att,
  coalesce(documents_patched, CASE WHEN repair_status = 'PatchCompletedOnWinner' THEN held ELSE 0 END) AS pat FROM x),
z AS (SELECT *, coalesce(documents_failed, CASE WHEN repair_status = 'PatchCompletedOnWinner' THEN greatest(0, att - pat) WHEN {SKIPPED} THEN 0 ELSE att END) AS fai FROM y),
p AS (SELECT run_id, upper(source_repair_plan_id) AS plan FROM e WHERE {present("source_repair_plan_id")} GROUP BY 1, 2 HAVING count(*) > 1)
SELECT run_id, count(*) AS n_executions, count(*) FILTER (ended) AS n_completed, count(*) FILTER (repair_status = 'PatchDispatching' AND patch_operation_id IS NULL) AS n_blocked,
  count(*) FILTER (repair_status = 'PatchStarted' AND patch_operation_id IS NOT NULL) AS n_started, count(*) FILTER ({sql_blank("source_repair_plan_id")}) AS n_without_plan,
  CAST(coalesce(sum(att) FILTER (ended), 0) AS BIGINT) AS attempted, CAST(coalesce(sum(pat) FILTER (ended), 0) AS BIGINT) AS patched, CAST(coalesce(sum(fai) FILTER (ended), 0) AS BIGINT) AS failed,
  (SELECT count(*) FROM p WHERE p.run_id = z.run_id) AS n_repeated_plans,
  count(*) FILTER ({sql_blank("source_repair_plan_id")}) = 0 AND (SELECT count(*) FROM p WHERE p.run_id = z.run_id) = 0 AS resumable FROM z GROUP BY run_id"""
)
def apply_resume_state(spark, folder):
    """What each applying run has done, and whether it can be taken up again."""
    return recovery.resume_state(_executions(spark))


@query(E + """ SELECT run_id, source_repair_plan_run_id, count(*) AS n_blocked FROM e WHERE repair_status = 'PatchDispatching' AND patch_operation_id IS NULL AND source_repair_plan_id <> ''
  AND source_repair_plan_run_id <> '' GROUP BY 1, 2""")
def blocked_apply_counts(spark, folder):
    return recovery.blocked_counts(_executions(spark))


PLANS = [(f"plans/{i}",) for i in range(1, 12)]


@query(E + ", " + _values(PLANS, "p", "plan_id") + f""" SELECT plan_id, repair_status AS execution_status, NOT coalesce({ENDED}, false) AS open FROM p
  LEFT JOIN (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY upper(source_repair_plan_id) ORDER BY id DESC) = 1) e ON upper(plan_id) = upper(source_repair_plan_id)""")
def plan_progress(spark, folder):
    """Plans with what became of them, and whether they are still to be carried out."""
    return recovery.plan_progress(spark.createDataFrame(PLANS, "plan_id string"), _executions(spark))


OUTCOMES = (
    E
    + ", "
    + _values(DETAILS, "t", "id, document_id, detail")
    + ", "
    + _values(TOTALS, "h", "id, total")
    + f""", doc AS (SELECT DISTINCT id, upper(d) AS document_key FROM (SELECT id, unnest(document_ids) AS d FROM e)),
o AS (SELECT doc.id, document_key, CASE WHEN t.detail = 'Patched' THEN 'PatchCompletedOnWinner' WHEN t.detail = 'DocumentDoesNotExist' THEN 'SkippedStateChanged' WHEN t.detail IS NOT NULL THEN 'PatchFailed'
  WHEN h.total > 0 THEN 'PatchCompletedOnWinner' ELSE 'PatchFailed' END AS decision
  FROM doc LEFT JOIN t ON t.id = doc.id AND upper(t.document_id) = document_key AND {present("t.document_id")} LEFT JOIN h ON h.id = doc.id)"""
)


def _outcomes(spark: SparkSession) -> DataFrame:
    return recovery.patch_outcomes(
        _executions(spark), spark.createDataFrame(DETAILS, "id string, document_id string, detail string"), spark.createDataFrame(TOTALS, "id string, total bigint"), applying=True
    )


@query(OUTCOMES + " SELECT * FROM o")
def patch_outcomes(spark, folder):
    """What became of each document of each execution."""
    return _outcomes(spark)


@query(OUTCOMES + """, c AS (SELECT id, count(*) AS n_documents, count(*) FILTER (decision = 'PatchCompletedOnWinner') AS n_patched FROM o GROUP BY 1) SELECT *,
  CASE WHEN n_patched > 0 THEN 'PatchCompletedOnWinner' ELSE 'SkippedStateChanged' END AS repair_status,
  CASE WHEN n_documents > n_patched THEN 'Non-patched documents in group: ' || (n_documents - n_patched) || ' of ' || n_documents || '.' END AS error FROM c""")
def patch_group_outcomes(spark, folder):
    """What became of each execution as a whole."""
    return recovery.outcome_counts(_outcomes(spark))


# plans

SAVED = f"""saved AS (SELECT *, upper(document_id) AS document_key FROM mismatches WHERE document_id IS NOT NULL AND repair_decision = 'PatchPlannedDryRun'
  QUALIFY row_number() OVER (PARTITION BY upper(document_id) ORDER BY detected_at DESC NULLS LAST, run_id DESC, id DESC, winner_cv DESC NULLS LAST, winner_node DESC NULLS LAST, collection DESC NULLS LAST) = 1)"""


@query(
    EVALUATED
    + f""", {SAVED}, o AS (SELECT document_key, unnest(observed_state) AS s FROM saved),
seen AS (SELECT document_key, upper(s.node_url) AS u, bool_or(coalesce(s.present, false)) AS present, max(CASE WHEN s.present THEN upper(coalesce(s.collection, '')) END) AS c,
  max(CASE WHEN s.present THEN {cv_norm("s.change_vector")} END) AS nv FROM o GROUP BY 1, 2),
here AS (SELECT document_key, upper(node_url) AS u, present, CASE WHEN present THEN upper(coalesce(c, '')) END AS c, CASE WHEN present THEN {cv_norm("cv")} END AS nv FROM grid),
m AS (SELECT l.document_key, bool_and(coalesce(s.present, false) = coalesce(w.present, false) AND s.c IS NOT DISTINCT FROM w.c AND s.nv IS NOT DISTINCT FROM w.nv) AS unchanged
  FROM saved l CROSS JOIN nodes n LEFT JOIN seen s ON s.document_key = l.document_key AND s.u = upper(n.node_url) LEFT JOIN here w ON w.document_key = l.document_key AND w.u = upper(n.node_url) GROUP BY 1),
v AS (SELECT s.document_key, f.document_key IS NULL AS gone, coalesce(f.mismatch_type NOT IN ('AMBIGUOUS_CV', 'COLLECTION_MISMATCH') AND upper(f.winner_node) IS NOT DISTINCT FROM upper(s.winner_node)
  AND upper(f.collection) IS NOT DISTINCT FROM upper(s.collection) AND upper({cv_norm("f.winner_cv")}) = upper({cv_norm("s.winner_cv")}) AND m.unchanged, false) AS same
  FROM saved s JOIN m ON m.document_key = s.document_key LEFT JOIN found f ON f.document_key = s.document_key)
SELECT document_key, CASE WHEN gone THEN 'SkippedAlreadyConsistent' WHEN same THEN 'Eligible' ELSE 'SkippedStateChanged' END AS outcome,
  CASE WHEN gone THEN 'ConsistentNow' WHEN NOT same THEN 'ChangedStillInconsistent' END AS reason FROM v"""
)
def revalidate_plan(spark, folder):
    """The last planned mismatch of each document: whether it may be carried out as it was planned, and if not, why."""
    planned = table(spark, folder, "mismatches").where(F.col("document_id").isNotNull() & (F.col("repair_decision") == fixed.PLANNED))
    saved = planned.groupBy(key(F.col("document_id")).alias("document_key")).agg(
        F.max(F.struct("detected_at", "run_id", "id", "winner_cv", "winner_node", "collection", "observed_state")).alias("w")
    ).select("document_key", "w.collection", "w.winner_node", "w.winner_cv", "w.observed_state")
    aligned, nodes = audit._aligned(spark, folder), audit._nodes(spark, folder)
    ignored = audit.ignored_ids(spark)
    return recovery.revalidated(saved, replicas.evaluate(aligned, ignored), aligned, nodes, ignored)


@query(f"""SELECT id, run_id, document_id, 'PatchPlannedDryRun' AS repair_decision, 'PatchPlannedDryRun' AS current_repair_decision FROM mismatches WHERE repair_decision = 'SkippedAlreadyPlanned'
  AND coalesce(upper(document_id) NOT IN (SELECT upper(document_id) FROM mismatches WHERE {EFFECTIVE} = 'PatchCompletedOnWinner' AND document_id IS NOT NULL), true)""")
def fixup_decisions(spark, folder):
    """Mismatches skipped as planned before that nothing repaired (the test data has none; the tests have)."""
    return recovery.fixed_up(table(spark, folder, "mismatches"))


@query(audit._decision_sql("SkippedAlreadyPlanned"))
def view_skipped_already_planned(spark, folder):
    return views.by_decision(table(spark, folder, "mismatches"), fixed.ALREADY_PLANNED)


@query(f"""SELECT run_id, upper(document_id) AS document_key, id, collection, mismatch_type, winner_node, {EFFECTIVE} AS decision FROM mismatches
  WHERE run_id = (SELECT max(run_id) FROM mismatches) AND upper(document_id) IN (SELECT upper(original_document_id) FROM node_document_snapshots WHERE from_node = 'A')""")
def view_by_run_and_document(spark, folder):
    """The lookup by run and documents: the mismatches of the last run of documents that node A has."""
    rows = table(spark, folder, "mismatches")
    documents = table(spark, folder, "node_document_snapshots").where("from_node = 'A'")
    of_run = rows.where(F.col("run_id") == rows.agg(F.max("run_id").alias("r")).scalar())
    return views.lookup(of_run, documents.select(key(F.col("original_document_id")).alias("document_key")))


@query(
    EVALUATED
    + f""", items AS (SELECT sha256({audit.GROUP_ID} || '/' || upper(document_id)) AS item_id, document_key, winner_node, collection FROM decided WHERE decision = 'PatchPlannedDryRun'),
wanted AS (SELECT upper(document_id) AS k, min(detected_at) AS first FROM mismatches WHERE {EFFECTIVE} = 'PatchFailed' GROUP BY 1)
SELECT item_id, document_key, winner_node, collection FROM items LEFT JOIN wanted ON k = document_key ORDER BY first NULLS LAST, winner_node NULLS FIRST, collection NULLS FIRST, item_id LIMIT 512"""
)
def plan_page(spark, folder):
    """The first 512 plans to carry out; the limit is the feature. Documents whose repair failed come first, the longest known
    ones before the others."""
    planned = audit._planned(spark, folder)
    items = planned.select(F.sha2(F.concat(planning.group_id(), F.lit("/"), key(F.col("document_id"))), 256).alias("item_id"), "document_key", "winner_node", "collection")
    wanted = table(spark, folder, "mismatches").where(planning.effective_decision() == fixed.PATCH_FAILED).groupBy(
        key(F.col("document_id")).alias("k")
    ).agg(F.min("detected_at").alias("first"))
    joined = items.join(wanted, F.col("document_key") == F.col("k"), "left")
    return joined.orderBy(*recovery.executable_order(F.col("first"))).limit(512).select(*items.columns)


@query(EVALUATED + " SELECT document_key, mismatch_type FROM found ORDER BY document_key LIMIT 1")
def first_mismatch(spark, folder):
    """The first mismatch by document, as a check that stops there gives it; the limit is the feature."""
    first = audit._evaluated(spark, folder).agg(F.min(F.struct("document_key", "mismatch_type")).alias("w"))
    return first.where(F.col("w").isNotNull()).select("w.*")


# runs


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY source_node_index ORDER BY coalesce(last_saved_at, started_at) DESC, started_at DESC, run_id DESC) AS rn FROM runs WHERE run_mode = 'LiveETagScan'),
a AS (SELECT source_repair_plan_run_id AS k, bool_or(is_complete) AS done, arg_max(run_id, (coalesce(last_saved_at, started_at), started_at, run_id)) FILTER (NOT is_complete) AS open FROM runs WHERE run_mode = 'ApplyRepairPlan' GROUP BY 1)
SELECT node_idx, CASE WHEN s.run_id IS NULL THEN 'StartScan' WHEN a.open IS NOT NULL THEN 'ResumeApply' WHEN NOT s.is_complete THEN 'ResumeScan' WHEN s.repairs_planned > 0 AND NOT coalesce(a.done, false) THEN 'StartApply'
  ELSE 'StartScan' END AS action, coalesce(s.safe_restart_etag, 0) AS start_etag, s.run_id AS scan_run, a.open AS apply_run
FROM node_config n LEFT JOIN s ON s.source_node_index = n.node_idx AND rn = 1 LEFT JOIN a ON a.k = s.run_id""")
def node_work_resolution(spark, folder):
    """What each node is to do next."""
    return recovery.node_work(table(spark, folder, "runs"), table(spark, folder, "node_config"))


@query("""SELECT run_id, coalesce(run_mode IN ('ImportSnapshots', 'DownloadSnapshotsToCache', 'ScanAndRepair', 'ApplyRepairPlan', 'LiveETagScan'), false) AS needs_cluster,
  coalesce(run_mode IN ('ImportSnapshots', 'DownloadSnapshotsToCache', 'ScanAndRepair', 'ApplyRepairPlan', 'LiveETagScan'), false) AS needs_startup_check,
  coalesce(run_mode IN ('ImportSnapshots', 'DownloadSnapshotsToCache', 'ScanAndRepair', 'LiveETagScan'), false) AS needs_fresh_semantics,
  coalesce(run_mode IN ('ImportSnapshots', 'DownloadSnapshotsToCache', 'ScanOnly', 'DryRunRepair', 'ScanAndRepair', 'LiveETagScan'), false) AS needs_semantics,
  coalesce(run_mode IN ('ScanOnly', 'DryRunRepair'), false) AS evaluates_locally,
  CASE WHEN NOT is_complete THEN CASE WHEN run_mode = 'ImportSnapshots' AND current_phase = 'SnapshotImport' THEN 'import' WHEN run_mode = 'DownloadSnapshotsToCache' AND current_phase = 'SnapshotCacheDownload' THEN 'download'
    WHEN run_mode = 'ImportCachedSnapshotsToStateStore' AND trim(coalesce(source_snapshot_cache_run_id, '')) <> '' AND current_phase = 'SnapshotImport' THEN 'cached import'
    WHEN run_mode IN ('LiveETagScan', 'SnapshotCrossCheck') OR (run_mode IN ('ScanOnly', 'DryRunRepair', 'ScanAndRepair') AND trim(coalesce(source_snapshot_run_id, '')) <> ''
      AND NOT coalesce(run_mode = 'ScanOnly' AND scan_mode = 'FirstMismatch' AND mismatches_found > 0, false) AND current_phase IN ('WaitingForSnapshotIndex', 'CandidateProcessing')) THEN 'analysis' END END AS resumable_as FROM runs""")
def run_policies(spark, folder):
    """What each run's mode needs, and as what the run can be resumed."""
    return table(spark, folder, "runs").select("run_id", *[c.alias(n) for n, c in recovery.run_policies(F.col("run_mode")).items()], recovery.resumable_as().alias("resumable_as"))


SERVICES = [
    ("a", True, True, True, False, True, 1.0), ("b", False, False, True, False, True, 1.0), ("c", False, True, False, True, True, None), ("d", False, True, False, False, True, None),
    ("e", False, True, True, False, False, 1.0), ("f", False, True, True, True, True, None), ("g", False, True, True, False, True, 300.0), ("h", False, True, True, True, True, 301.0),
]
SERVICE = "name string, fatal boolean, scheduled boolean, configured boolean, retrying boolean, expected_mode boolean, seconds_since_progress double"


@query("WITH " + _values(SERVICES, "s", ", ".join(c.split(" ")[0] for c in SERVICE.split(", "))) + """ SELECT name, CASE WHEN fatal THEN 'fatal' WHEN NOT scheduled THEN 'wrong-mode'
  WHEN NOT configured THEN CASE WHEN retrying THEN 'retrying' ELSE 'starting' END WHEN NOT expected_mode THEN 'wrong-mode' WHEN seconds_since_progress IS NULL THEN CASE WHEN retrying THEN 'retrying' ELSE 'starting' END
  WHEN seconds_since_progress > 300 THEN 'stale' ELSE 'ok' END AS status FROM s""")
def health_status(spark, folder):
    return spark.createDataFrame(SERVICES, SERVICE).select("name", recovery.health(300).alias("status"))


# stored versions and upserts

HASH = f"upper(sha256(upper(id) || chr(10) || {cv_norm('change_vector')}))"
PAGES = f"v AS (SELECT node_url, page_no, {HASH} AS hash FROM iteration_items WHERE {LIVE} AND {present('id')} AND {ETAG} IS NOT NULL)"
STORED_PAGES = 20
#: Steps in which a backlog of batches is taken, however many there are.
BACKLOG_STEPS = 4


@query(f"WITH {PAGES} SELECT DISTINCT hash FROM v WHERE page_no > {STORED_PAGES} AND hash NOT IN (SELECT hash FROM v WHERE page_no <= {STORED_PAGES})")
def new_versions(spark, folder):
    """Versions on later pages of the feeds that no earlier page had: the earlier ones' digests are stored as 32 bytes each, and
    excluded."""
    hashed = audit._live(spark, folder).select("page_no", replicas.version_hash(key(F.col("id")), normalize(F.col("change_vector"))).alias("hash"))
    path = scratch(spark, "versions")
    hashed.where(F.col("page_no") <= STORED_PAGES).select(F.unhex("hash").alias("digest")).distinct().write.parquet(path)
    later = hashed.where(F.col("page_no") > STORED_PAGES).select(F.unhex("hash").alias("digest")).distinct()
    return later.join(spark.read.parquet(path), "digest", "left_anti").select(F.hex("digest").alias("hash"))


@query(f"""WITH f AS (SELECT node_url, upper(id) AS document_key, {ETAG} AS e, feed_seq, page_no FROM iteration_items WHERE {LIVE} AND {present("id")} AND {ETAG} IS NOT NULL)
SELECT node_url, document_key, e AS etag, feed_seq FROM f QUALIFY row_number() OVER (PARTITION BY node_url, document_key ORDER BY page_no // {STORED_PAGES}, e, feed_seq) = 1""")
def first_verdicts(spark, folder):
    """Live documents of each node's feed once, as first seen, though they come again on later pages: a store of what was seen
    takes pages in batches. What waits is taken in a fixed number of steps, each of as many batches as come to it, and the batch
    comes first in the store's order, so a step keeps what its batches one after the other would."""
    run = F.coalesce(F.concat(F.lit("="), "node_url"), F.lit(""))  # no node isn't a node without name
    live = audit._live(spark, folder).select("node_url", "id", "etag", "feed_seq", F.expr(f"page_no div {STORED_PAGES}").alias("batch_no")).withColumn("guard", once_a_run(run, F.col("id")))
    # what has no number comes last
    order = [F.col("batch_no").isNull(), "batch_no", "etag", F.col("feed_seq").isNull(), "feed_seq"]
    store = DeliveryStore(spark, scratch(spark, "guards"), live.schema, "guard", lambda: F.lit(0), order)
    have = live.agg(F.count(F.lit(1)).alias("n"), F.min("batch_no").alias("least"), F.max("batch_no").alias("most")).first()
    batches = 1 if have["least"] is None else have["most"] - have["least"] + 1
    steps = min(BACKLOG_STEPS, batches) if have["n"] else 0
    step = F.coalesce(F.floor((F.col("batch_no") - have["least"]) * steps / batches), F.lit(steps - 1))
    for number in range(steps):
        store.accept(f"{number:08d}", live.where(step == number))
    return store.rows().select("node_url", key(F.col("id")).alias("document_key"), "etag", "feed_seq")


ROUNDS = 24
RANKED = """SELECT *, row_number() OVER (PARTITION BY batch_no < {r}, upper(id) ORDER BY last_modified DESC NULLS LAST, upper(coalesce(change_vector, '')) DESC, delivery_id) AS rn FROM node_document_snapshots"""


@query(f"""WITH r AS (SELECT * FROM ({RANKED.format(r=ROUNDS)}) WHERE rn = 1), o AS (SELECT * FROM r WHERE batch_no < {ROUNDS}), n AS (SELECT * FROM r WHERE batch_no >= {ROUNDS})
SELECT n.delivery_id, CASE WHEN o.id IS NULL THEN 'inserted' ELSE 'updated' END AS outcome FROM n LEFT JOIN o ON upper(o.id) = upper(n.id)
WHERE o.id IS NULL OR o.change_vector IS DISTINCT FROM n.change_vector OR o.collection IS DISTINCT FROM n.collection OR o.last_modified IS DISTINCT FROM n.last_modified""")
def upsert_changes(spark, folder):
    """What an upsert of the later delivery rounds writes over the earlier ones: new rows and changed ones, not those that are
    the same."""
    rows = table(spark, folder, "node_document_snapshots")
    columns = ["delivery_id", "id", "change_vector", "collection", "last_modified"]
    half = lambda where: replicas.latest(rows.where(where), [key(F.col("id"))], columns).withColumn("k", key(F.col("id")))
    wrote = upsert_changed(half(F.col("batch_no") < ROUNDS), half(F.col("batch_no") >= ROUNDS), ["k"], columns[2:])
    return wrote.select("delivery_id", "outcome")
