"""The auditing queries over whole tables, with their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftwise import fixed
from driftwise.functions.scalars import backoff_seconds, csv_field, duration_text, iso_text, parse_iso, touch_statement
from driftwise.functions.vectors import blank, key, normalize, parse_long, strip
from driftwise.operators import planning, recovery, replicas, views
from driftwise.plans.sqltext import blank as sql_blank
from driftwise.plans.sqltext import cv_norm, cv_segments, present
from driftwise.session import cut, scratch
from driftwise.sources.pages import first_seen, is_live_document
from driftwise.sources.tables import table
from driftwise.streaming.feeds import live_versions, read_feed, run_to_end

QUERIES: dict = {}
SQL: dict[str, str] = {}
CHUNK = 512


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "node_document_snapshots")


def _nodes(spark: SparkSession, folder: str) -> list[replicas.Node]:
    return replicas.nodes_of(table(spark, folder, "node_config"))


def _aligned(spark: SparkSession, folder: str) -> DataFrame:
    return replicas.align(_rows(spark, folder), _nodes(spark, folder))


def ignored_ids(spark: SparkSession) -> list[str]:
    """Database ids that don't count in vectors: the session's driftwise.ignored.ids, comma-separated, by default none."""
    return [x.strip() for x in spark.conf.get("driftwise.ignored.ids", "").split(",") if x.strip()]


def _evaluated(spark: SparkSession, folder: str) -> DataFrame:
    return replicas.evaluate(_aligned(spark, folder), ignored_ids(spark))


def _mismatches(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "mismatches")


# fragments of SQL: the latest row of each document and node, the grid of documents and nodes, and the evaluation
ALIGNED = f"""
WITH nodes AS (SELECT *, chr(65 + node_idx) AS node FROM node_config),
ranked AS (SELECT s.*, upper(s.original_document_id) AS document_key, row_number() OVER (PARTITION BY upper(s.original_document_id), s.from_node
  ORDER BY s.last_modified DESC NULLS LAST, upper(coalesce(s.change_vector, '')) DESC, s.delivery_id) AS rn
  FROM node_document_snapshots s WHERE s.original_document_id IS NOT NULL AND s.from_node IN (SELECT node FROM nodes)),
docs AS (SELECT document_key, min(original_document_id) AS document_id FROM ranked GROUP BY 1),
held AS (SELECT document_key, from_node, collection AS c, coalesce(change_vector, '') AS cv, last_modified AS lm FROM ranked WHERE rn = 1),
grid AS (SELECT d.document_key, d.document_id, n.node_idx, n.node, n.node_url, h.from_node IS NOT NULL AS present, h.c, h.cv, h.lm
  FROM docs d CROSS JOIN nodes n LEFT JOIN held h ON h.document_key = d.document_key AND h.from_node = n.node)"""
EVALUATED = (
    ALIGNED
    + f""", norms AS (SELECT *, {cv_norm("cv")} AS nv FROM grid),
per AS (SELECT document_key, min(document_id) AS document_id, count(*) FILTER (present) AS n_present, count(*) AS n_all,
  count(DISTINCT upper(c)) FILTER (present AND {present("c")}) AS n_collections, count(DISTINCT upper(nv)) FILTER (present) AS n_versions,
  string_agg(cv, ',' ORDER BY node_idx) FILTER (present) AS every, arg_min(c, node_idx) FILTER (present AND {present("c")}) AS named,
  min(node_idx) FILTER (present) AS first_idx FROM norms GROUP BY 1),
tops AS (SELECT *, {cv_norm("every")} AS top FROM per WHERE n_present > 0),
win AS (SELECT t.document_key, arg_min(n.node_url, upper(n.node_url)) AS winner_node, arg_min(n.cv, upper(n.node_url)) AS winner_cv
  FROM tops t JOIN norms n ON n.document_key = t.document_key AND n.present AND (t.n_versions = 1 OR n.nv = t.top) GROUP BY 1),
evaluated AS (SELECT t.document_key, t.document_id, CASE WHEN t.n_collections = 1 THEN t.named ELSE f.c END AS collection,
  CASE WHEN t.n_collections > 1 THEN 'COLLECTION_MISMATCH' WHEN t.n_present = t.n_all AND t.n_versions = 1 THEN NULL
    WHEN w.winner_node IS NULL THEN 'AMBIGUOUS_CV' WHEN t.n_present < t.n_all THEN 'MISSING' ELSE 'CV_MISMATCH' END AS mismatch_type,
  w.winner_node, w.winner_cv FROM tops t JOIN norms f ON f.document_key = t.document_key AND f.node_idx = t.first_idx LEFT JOIN win w ON w.document_key = t.document_key),
found AS (SELECT e.*, (SELECT string_agg(n.node_url, ',' ORDER BY upper(n.node_url)) FROM nodes n WHERE e.winner_node IS NULL OR n.node_url <> e.winner_node) AS affected_nodes
  FROM evaluated e WHERE e.mismatch_type IS NOT NULL),
decided AS (SELECT *, CASE WHEN mismatch_type = 'AMBIGUOUS_CV' THEN 'SkippedAmbiguousCv' WHEN mismatch_type = 'COLLECTION_MISMATCH' OR {sql_blank("collection")}
  OR {sql_blank("winner_node")} THEN 'SkippedCollectionMismatch' ELSE 'PatchPlannedDryRun' END AS decision FROM found)"""
)
EFFECTIVE = f"CASE WHEN {sql_blank('current_repair_decision')} THEN repair_decision ELSE current_repair_decision END"


# vectors


@query(f"SELECT delivery_id, {cv_norm('change_vector')} AS cv_norm FROM node_document_snapshots")
def cv_normalize(spark, folder):
    return _rows(spark, folder).select("delivery_id", normalize(F.col("change_vector")).alias("cv_norm"))


@query(f"""SELECT delivery_id, s.d AS db_id, arg_min(s.t, i) AS tag, max(CAST(trim(s.e) AS BIGINT)) AS etag FROM
  (SELECT delivery_id, unnest(seg) AS s, unnest(range(len(seg))) AS i FROM (SELECT delivery_id, {cv_segments("change_vector")} AS seg FROM node_document_snapshots)) GROUP BY 1, 2""")
def cv_segments_explode(spark, folder):
    return replicas.vector_segments(_rows(spark, folder), "delivery_id", F.col("change_vector"))


@query(
    ALIGNED
    + f""", x AS (SELECT document_key, node, s.d AS db_id, CAST(trim(s.e) AS BIGINT) AS etag FROM (SELECT document_key, node, unnest({cv_segments("cv")}) AS s FROM grid WHERE present)),
w AS (SELECT document_key, db_id, max(etag) FILTER (node = 'A') AS a, max(etag) FILTER (node = 'B') AS b, max(etag) FILTER (node = 'C') AS c FROM x GROUP BY 1, 2)
SELECT *, a IS NOT DISTINCT FROM b AND a IS NOT DISTINCT FROM c AS all_same FROM w"""
)
def cv_segment_pivot(spark, folder):
    return replicas.segment_pivot(_aligned(spark, folder), _nodes(spark, folder))


@query(
    ALIGNED
    + f""", x AS (SELECT document_key, node, s.d AS d, max(CAST(trim(s.e) AS BIGINT)) AS e FROM (SELECT document_key, node, unnest({cv_segments("cv")}) AS s FROM grid WHERE present) GROUP BY 1, 2, 3),
p AS (SELECT l.document_key, l.node AS node_l, r.node AS node_r FROM grid l JOIN grid r ON l.document_key = r.document_key AND l.node <> r.node WHERE l.present AND r.present)
SELECT p.document_key, p.node_l, p.node_r, coalesce(bool_and(xr.d IS NULL OR (xl.e IS NOT NULL AND xl.e >= xr.e)), true) AS dominates FROM p
LEFT JOIN x xr ON xr.document_key = p.document_key AND xr.node = p.node_r LEFT JOIN x xl ON xl.document_key = p.document_key AND xl.node = p.node_l AND xl.d = xr.d GROUP BY 1, 2, 3"""
)
def cv_dominates_pairs(spark, folder):
    return replicas.dominance(_aligned(spark, folder))


@query(f"""WITH s AS (SELECT delivery_id, from_node, t.s.d AS db_id, t.s.t AS tag FROM (SELECT delivery_id, from_node, unnest({cv_segments("change_vector")}) AS s FROM node_document_snapshots) t),
c AS (SELECT tag, db_id, count(*) AS n FROM s GROUP BY 1, 2), cur AS (SELECT db_id FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY n DESC, db_id) AS rn FROM c
  WHERE tag IN (SELECT DISTINCT from_node FROM node_document_snapshots)) WHERE rn = 1)
SELECT db_id, CAST(sum(n) AS BIGINT) AS n FROM c WHERE db_id NOT IN (SELECT db_id FROM cur) GROUP BY 1""")
def potential_unused_ids(spark, folder):
    return replicas.potential_unused_ids(_rows(spark, folder))


# rows, ids, alignment


@query(r"""SELECT delivery_id, CASE WHEN regexp_matches(original_document_id, '[\\\x00-\x1f]') THEN 'NodeDocumentSnapshots/' || from_node || '/' || upper(sha256(original_document_id))
  ELSE original_document_id || '/' || from_node END AS snapshot_id, upper(id) = upper(snapshot_id) AS as_delivered, coalesce(change_vector, '') AS change_vector FROM node_document_snapshots""")
def snapshot_rows(spark, folder):
    rows = _rows(spark, folder).withColumn("snapshot_id", replicas.physical_id(F.col("original_document_id"), F.col("from_node")))
    return rows.select(
        "delivery_id",
        "snapshot_id",
        (key(F.col("id")) == key(F.col("snapshot_id"))).alias("as_delivered"),
        F.coalesce("change_vector", F.lit("")).alias("change_vector"),
    )


@query(r"""SELECT DISTINCT original_document_id AS document_id, concat_ws(',', CASE WHEN contains(original_document_id, '\') THEN 'ContainsBackslash' END,
  CASE WHEN regexp_matches(original_document_id, '[\x00-\x1f]') THEN 'ContainsControlCharacter' END) AS reason FROM node_document_snapshots WHERE regexp_matches(original_document_id, '[\\\x00-\x1f]')""")
def unsafe_ids(spark, folder):
    ids = F.col("original_document_id")
    return _rows(spark, folder).where(replicas.has_unsafe_characters(ids)).select(
        ids.alias("document_id"), replicas.unsafe_reason(ids).alias("reason")
    ).distinct()


@query("SELECT from_node, count(*) AS n_rows, count(DISTINCT upper(id)) AS n_ids FROM node_document_snapshots GROUP BY 1")
def node_row_counts(spark, folder):
    return _rows(spark, folder).groupBy("from_node").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key(F.col("id"))).alias("n_ids")
    )


@query(ALIGNED + " SELECT document_key, node, present, c AS collection, cv AS change_vector, lm AS last_modified FROM grid")
def replica_alignment(spark, folder):
    return replicas.alignment_rows(_aligned(spark, folder)).select(
        "document_key", "node", "present", "collection", "change_vector", "last_modified"
    )


@query(ALIGNED + " SELECT document_key, node, present, c AS collection, cv AS change_vector FROM grid WHERE document_key IN (SELECT document_key FROM held WHERE from_node = 'A')")
def source_driven_alignment(spark, folder):
    seen = _aligned(spark, folder).where(F.exists("states", lambda s: (s.node == "A") & s.present))
    return replicas.alignment_rows(seen).select("document_key", "node", "present", "collection", "change_vector")


LATEST = """WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY upper(id) ORDER BY last_modified DESC NULLS LAST, upper(coalesce(change_vector, '')) DESC, delivery_id) AS rn
  FROM node_document_snapshots) WHERE rn = 1)"""


def _latest(spark, folder):
    return replicas.latest(
        _rows(spark, folder),
        [key(F.col("id"))],
        ["delivery_id", "id", "original_document_id", "from_node", "change_vector", "collection", "last_modified"],
    )


@query(LATEST + " SELECT delivery_id, id, original_document_id, from_node, change_vector, collection, last_modified FROM l")
def aggregate_latest(spark, folder):
    return _latest(spark, folder)


@query(
    LATEST
    + """ SELECT upper(original_document_id) AS document_key, count(*) AS n_rows, string_agg(DISTINCT from_node, ',' ORDER BY from_node) AS from_nodes, count(DISTINCT from_node) AS n_nodes,
  count(DISTINCT upper(coalesce(change_vector, ''))) AS n_vectors FROM l GROUP BY 1 HAVING count(*) < 3 OR count(DISTINCT upper(coalesce(change_vector, ''))) > 1"""
)
def problem_candidates(spark, folder):
    return replicas.problem_candidates(_latest(spark, folder), len(_nodes(spark, folder)))


# evaluation and planning


@query(EVALUATED + " SELECT document_key, document_id, collection, mismatch_type, winner_node, winner_cv, affected_nodes FROM found")
def evaluate_documents(spark, folder):
    return _evaluated(spark, folder).drop("states")


@query(EVALUATED + " SELECT mismatch_type, count(*) AS n FROM found GROUP BY 1")
def mismatch_type_counts(spark, folder):
    return _evaluated(spark, folder).groupBy("mismatch_type").agg(F.count(F.lit(1)).alias("n"))


@query(EVALUATED + " SELECT winner_node, count(*) AS n FROM found GROUP BY 1")
def winner_node_histogram(spark, folder):
    return _evaluated(spark, folder).groupBy("winner_node").agg(F.count(F.lit(1)).alias("n"))


@query(EVALUATED + " SELECT document_key, decision FROM decided")
def repair_decisions(spark, folder):
    return _evaluated(spark, folder).select("document_key", planning.decision().alias("decision"))


def _planned(spark, folder):
    return _evaluated(spark, folder).where(planning.decision() == planning.PLANNED)


@query(EVALUATED + " SELECT winner_node, collection, winner_cv, count(*) AS n_docs, min(document_id) AS first_document, max(document_id) AS last_document FROM decided WHERE decision = 'PatchPlannedDryRun' GROUP BY 1, 2, 3")
def repair_groups(spark, folder):
    return planning.repair_groups(_planned(spark, folder))


@query(
    EVALUATED
    + """, n AS (SELECT winner_node, collection, winner_cv, unnest(string_split(coalesce(affected_nodes, ''), ',')) AS node FROM decided WHERE decision = 'PatchPlannedDryRun')
SELECT winner_node, collection, winner_cv, coalesce(string_agg(DISTINCT node, ',' ORDER BY node) FILTER (node <> ''), '') AS affected_nodes, count(DISTINCT node) FILTER (node <> '') AS n_nodes FROM n GROUP BY 1, 2, 3"""
)
def repair_group_nodes(spark, folder):
    """The nodes that each repair group affects."""
    return planning.repair_group_nodes(_planned(spark, folder))


@query(EVALUATED + f" SELECT document_key, winner_node, CAST(floor((row_number() OVER (PARTITION BY winner_node ORDER BY document_key) - 1) / {CHUNK}) AS BIGINT) AS chunk FROM decided WHERE decision = 'PatchPlannedDryRun'")
def repair_chunks(spark, folder):
    # read three times below, and evaluated once
    planned = cut(_planned(spark, folder).select("document_key", "winner_node"))
    return planning.chunks(planned, ["winner_node"], "document_key", CHUNK)


GROUP_ID = "sha256(concat_ws(chr(10), coalesce('+' || winner_node, '-'), coalesce('+' || collection, '-'), coalesce('+' || winner_cv, '-')))"


@query(EVALUATED + f" SELECT DISTINCT sha256({GROUP_ID} || '/' || upper(document_id)) AS item_id, document_id, {GROUP_ID} AS group_id FROM decided WHERE decision = 'PatchPlannedDryRun'")
def repair_plan_items(spark, folder):
    return planning.plan_items(_planned(spark, folder))


@query(EVALUATED + f" SELECT document_key, mismatch_type FROM decided WHERE decision = 'PatchPlannedDryRun' AND document_key NOT IN (SELECT upper(document_id) FROM mismatches WHERE {EFFECTIVE} = 'PatchPlannedDryRun' AND document_id IS NOT NULL)")
def guard_anti_join(spark, folder):
    guards = _mismatches(spark, folder).where(planning.effective_decision() == planning.PLANNED)
    return planning.without(
        _planned(spark, folder).select("document_key", "mismatch_type"), F.col("document_key"), guards, key(F.col("document_id"))
    )


@query(EVALUATED + f" SELECT document_key FROM decided WHERE decision = 'PatchPlannedDryRun' AND document_key IN (SELECT upper(document_id) FROM mismatches WHERE {EFFECTIVE} = 'PatchPlannedDryRun')")
def guard_overlap(spark, folder):
    guards = _mismatches(spark, folder).where(planning.effective_decision() == planning.PLANNED)
    return planning.among(_planned(spark, folder).select("document_key"), F.col("document_key"), guards, key(F.col("document_id")))


@query(f"SELECT DISTINCT upper(document_id) AS document_key FROM mismatches WHERE upper(document_id) NOT IN (SELECT upper(document_id) FROM mismatches WHERE {EFFECTIVE} = 'PatchCompletedOnWinner' AND document_id IS NOT NULL)")
def exclude_repaired(spark, folder):
    rows = _mismatches(spark, folder)
    done = rows.where(planning.effective_decision() == fixed.PATCHED)
    return planning.without(
        rows.select(key(F.col("document_id")).alias("document_key")), F.col("document_key"), done, key(F.col("document_id"))
    ).distinct()


@query(
    EVALUATED
    + """ SELECT f.document_key, f.mismatch_type, w.node AS source_node, t.node AS target_node, w.cv AS source_cv, t.cv AS target_cv FROM found f
  JOIN grid w ON w.document_key = f.document_key AND w.node_url = f.winner_node JOIN grid t ON t.document_key = f.document_key AND t.node <> w.node"""
)
def pairwise_mismatch_rows(spark, folder):
    found = _evaluated(spark, folder).where(F.col("winner_node").isNotNull()).select(
        "document_key",
        "mismatch_type",
        F.get(F.filter("states", lambda s: s.node_url == F.col("winner_node")), F.lit(0)).alias("w"),
        F.explode("states").alias("t"),
    )
    return found.where(F.col("t.node") != F.col("w.node")).select(
        "document_key",
        "mismatch_type",
        F.col("w.node").alias("source_node"),
        F.col("t.node").alias("target_node"),
        F.col("w.change_vector").alias("source_cv"),
        F.col("t.change_vector").alias("target_cv"),
    )


@query(
    EVALUATED
    + """, x AS (SELECT n.node, g.present, f.mismatch_type, f.winner_node = n.node_url AS wins FROM found f JOIN nodes n ON true JOIN grid g ON g.document_key = f.document_key AND g.node = n.node)
SELECT coalesce(node, 'all') AS node, count(*) AS n_mismatches, count(*) FILTER (NOT present) AS n_missing, count(*) FILTER (wins) AS n_wins FROM x GROUP BY ROLLUP (node)"""
)
def cluster_rollup(spark, folder):
    rows = _evaluated(spark, folder).select("winner_node", F.explode("states").alias("s"))
    counted = rows.rollup(F.col("s.node").alias("node")).agg(
        F.count(F.lit(1)).alias("n_mismatches"),
        F.count_if(~F.col("s.present")).alias("n_missing"),
        F.count_if(F.col("winner_node") == F.col("s.node_url")).alias("n_wins"),
    )
    return counted.withColumn("node", F.coalesce("node", F.lit("all")))


# views over stored mismatches


@query(f"""SELECT id, run_id, document_id, collection, mismatch_type,
  coalesce(array_to_string(list_sort(list_transform(list_filter(observed_state, lambda s: s.present), lambda s: s.node_url)), ','), '') AS present_nodes,
  coalesce(len(list_filter(observed_state, lambda s: s.present)), 0) AS n_present,
  coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(observed_state, lambda s: s.present), lambda s: s.change_vector), lambda v: {present("v")}))), ' | '), '') AS vectors,
  coalesce(len(list_distinct(list_filter(list_transform(list_filter(observed_state, lambda s: s.present), lambda s: s.change_vector), lambda v: {present("v")}))), 0) AS n_vectors
  FROM mismatches WHERE mismatch_type = 'AMBIGUOUS_CV'""")
def view_manual_review(spark, folder):
    return views.manual_review(_mismatches(spark, folder))


def _decision_sql(wanted):
    return f"SELECT id, run_id, document_id, collection, mismatch_type, winner_node, winner_cv FROM mismatches WHERE {EFFECTIVE} = '{wanted}'"


@query(_decision_sql("PatchPlannedDryRun"))
def view_auto_plan(spark, folder):
    return views.by_decision(_mismatches(spark, folder), planning.PLANNED)


@query(_decision_sql("SkippedAmbiguousCv"))
def view_skipped_ambiguous(spark, folder):
    return views.by_decision(_mismatches(spark, folder), planning.AMBIGUOUS)


@query(_decision_sql("SkippedCollectionMismatch"))
def view_skipped_collection(spark, folder):
    return views.by_decision(_mismatches(spark, folder), planning.COLLECTION)


@query(_decision_sql("SkippedStateChanged"))
def view_skipped_state_changed(spark, folder):
    return views.by_decision(_mismatches(spark, folder), fixed.STATE_CHANGED)


@query(f"SELECT id, run_id, document_id, collection, mismatch_type, winner_node, {EFFECTIVE} AS decision, len(list_filter(observed_state, lambda s: NOT s.present)) AS n_missing FROM mismatches")
def view_unhealthy(spark, folder):
    return views.unhealthy(_mismatches(spark, folder))


@query("""SELECT run_id, count(*) AS n_rows, count(DISTINCT upper(document_id)) AS n_documents, count(*) FILTER (mismatch_type = 'MISSING') AS missing, count(*) FILTER (mismatch_type = 'CV_MISMATCH') AS cv_mismatch,
  count(*) FILTER (mismatch_type = 'AMBIGUOUS_CV') AS ambiguous_cv, count(*) FILTER (mismatch_type = 'COLLECTION_MISMATCH') AS collection_mismatch, min(detected_at) AS first_detected, max(detected_at) AS last_detected FROM mismatches GROUP BY 1""")
def view_by_run(spark, folder):
    return views.run_overview(_mismatches(spark, folder))


@query(f"""SELECT upper(document_id) AS document_key, id, run_id, {EFFECTIVE} AS decision FROM mismatches QUALIFY row_number() OVER (PARTITION BY upper(document_id)
  ORDER BY coalesce({EFFECTIVE} = 'PatchPlannedDryRun', false) DESC, last_repair_updated_at DESC NULLS LAST, detected_at DESC NULLS LAST, id DESC, run_id DESC, {EFFECTIVE} DESC NULLS LAST) = 1""")
def preferred_mismatch(spark, folder):
    return planning.preferred_mismatches(_mismatches(spark, folder))


@query(f"SELECT {EFFECTIVE} AS decision, mismatch_type, count(*) AS n FROM mismatches GROUP BY 1, 2")
def decision_counts(spark, folder):
    return _mismatches(spark, folder).groupBy(
        planning.effective_decision().alias("decision"), "mismatch_type"
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH p AS (SELECT unnest(observed_state) AS s FROM (SELECT observed_state FROM mismatches QUALIFY row_number() OVER (PARTITION BY id
  ORDER BY detected_at DESC NULLS LAST, run_id DESC NULLS LAST, observed_state DESC NULLS LAST) = 1))
SELECT s.node_url AS node_url, s.present AS present, count(*) AS n, count(DISTINCT upper(s.collection)) AS n_collections FROM p GROUP BY 1, 2"""
)
def observed_states(spark, folder):
    """States of all mismatches by node, each id once, however often it was delivered: as its last copy has them."""
    last = _mismatches(spark, folder).groupBy("id").agg(F.max(F.struct("detected_at", "run_id", "observed_state")).alias("w"))
    return last.select(F.explode("w.observed_state").alias("s")).groupBy("s.node_url", "s.present").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(key(F.col("s.collection"))).alias("n_collections")
    )


@query(
    EVALUATED
    + f""", pref AS (SELECT * FROM mismatches QUALIFY row_number() OVER (PARTITION BY upper(document_id) ORDER BY detected_at DESC NULLS LAST, run_id DESC, id DESC, winner_cv DESC NULLS LAST) = 1)
SELECT upper(p.document_id) AS document_key, CASE WHEN f.document_key IS NULL THEN 'ConsistentNow' WHEN f.mismatch_type = p.mismatch_type AND f.winner_node IS NOT DISTINCT FROM p.winner_node
  AND {cv_norm("f.winner_cv")} = {cv_norm("p.winner_cv")} THEN 'Unchanged' ELSE 'ChangedStillInconsistent' END AS outcome FROM pref p LEFT JOIN found f ON f.document_key = upper(p.document_id) WHERE p.document_id IS NOT NULL"""
)
def revalidate_mismatches(spark, folder):
    """The last mismatch of each document against what the snapshots say now."""
    last = _mismatches(spark, folder).where(F.col("document_id").isNotNull()).groupBy(key(F.col("document_id")).alias("document_key")).agg(
        F.max(F.struct("detected_at", "run_id", "id", "winner_cv", "mismatch_type", "winner_node")).alias("p")
    )
    now = _evaluated(spark, folder).select(
        F.col("document_key").alias("k"), F.struct("mismatch_type", "winner_node", "winner_cv").alias("f")
    )
    same = (F.col("f.mismatch_type") == F.col("p.mismatch_type")) & F.col("f.winner_node").eqNullSafe(F.col("p.winner_node")) & (
        normalize(F.col("f.winner_cv"), ignored_ids(spark)) == normalize(F.col("p.winner_cv"), ignored_ids(spark))
    )
    outcome = F.when(F.col("k").isNull(), "ConsistentNow").when(same, "Unchanged").otherwise("ChangedStillInconsistent")
    return last.join(now, F.col("document_key") == F.col("k"), "left").select("document_key", outcome.alias("outcome"))


@query(f"""SELECT DISTINCT collection, 'from "' || replace(collection, '"', '""') || '" where id() in ($ids) update {{ put(id(this), this); }}' AS statement FROM mismatches WHERE {present("collection")}""")
def patch_statement(spark, folder):
    return _mismatches(spark, folder).where(~blank(F.col("collection"))).select(
        "collection", touch_statement(F.col("collection")).alias("statement")
    ).distinct()


@query("""SELECT id, document_id || ',' || coalesce(CASE WHEN regexp_matches(winner_cv, '[,"\r\n]') THEN '"' || replace(winner_cv, '"', '""') || '"' ELSE winner_cv END, '') || ',' || strftime(detected_at, '%Y-%m-%dT%H:%M:%S.%f') || '0Z' AS line FROM mismatches""")
def csv_lines(spark, folder):
    return _mismatches(spark, folder).select(
        "id", F.concat("document_id", F.lit(","), csv_field(F.col("winner_cv")), F.lit(","), iso_text(F.col("detected_at"))).alias("line")
    )


# runs


@query("""WITH s AS (SELECT *, coalesce(lag(safe_restart_etag) OVER (PARTITION BY source_node_index ORDER BY started_at, run_id), 0) AS start_etag FROM runs WHERE run_mode = 'LiveETagScan')
SELECT s.run_id, n.node_label AS source_node, s.start_etag, s.safe_restart_etag - 1 AS end_etag FROM s LEFT JOIN node_config n ON n.node_idx = s.source_node_index""")
def scan_ranges(spark, folder):
    return views.scan_ranges(table(spark, folder, "runs"), table(spark, folder, "node_config"))


@query("""SELECT run_mode, source_node_index, run_id, is_complete, safe_restart_etag FROM runs QUALIFY row_number() OVER (PARTITION BY run_mode, source_node_index
  ORDER BY coalesce(last_saved_at, started_at) DESC, started_at DESC, run_id DESC) = 1""")
def latest_runs(spark, folder):
    return views.latest_runs(table(spark, folder, "runs"))


@query("""SELECT a.run_id, a.is_complete, s.run_id AS scan_id, s.run_mode AS scan_run_mode, s.repairs_planned AS planned, coalesce(s.source_snapshot_cache_run_id, s.source_snapshot_run_id) AS snapshot_run_id
  FROM runs a LEFT JOIN runs s ON s.run_id = a.source_repair_plan_run_id WHERE a.run_mode = 'ApplyRepairPlan'""")
def run_lineage(spark, folder):
    return views.run_lineage(table(spark, folder, "runs"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY run_mode ORDER BY coalesce(last_saved_at, started_at) DESC, started_at DESC, run_id DESC) AS rn,
  row_number() OVER (PARTITION BY run_mode, is_complete ORDER BY coalesce(last_saved_at, started_at) DESC, started_at DESC, run_id DESC) AS rc FROM runs)
SELECT run_mode, count(*) AS n_runs, max(run_id) FILTER (rn = 1) AS latest_run, max(run_id) FILTER (rc = 1 AND is_complete) AS latest_complete, max(safe_restart_etag) FILTER (rc = 1 AND is_complete) AS complete_etag,
  max(run_id) FILTER (rc = 1 AND NOT is_complete) AS latest_open, CAST(sum(mismatches_found) AS BIGINT) AS mismatches_found, coalesce(min(safe_restart_etag), 0) AS safe_restart_etag FROM r GROUP BY 1""")
def run_heads(spark, folder):
    return views.run_heads(table(spark, folder, "runs"))


@query("""SELECT run_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS took FROM (SELECT run_id, coalesce(greatest(CAST(floor(epoch(last_saved_at) - epoch(started_at)) AS BIGINT), 0), 0) AS s FROM runs)""")
def duration_format(spark, folder):
    seconds = F.unix_micros(F.col("last_saved_at").cast("timestamp")) / 1e6 - F.unix_micros(F.col("started_at").cast("timestamp")) / 1e6
    return table(spark, folder, "runs").select("run_id", duration_text(F.coalesce(seconds, F.lit(0))).alias("took"))


@query("SELECT run_id, n AS failures, least(30 * pow(2.0, n - 1), 60.0) AS wait_seconds FROM (SELECT run_id, row_number() OVER (ORDER BY run_id) AS n FROM runs)")
def backoff_schedule(spark, folder):
    # runs is a table of a handful of rows
    numbered = table(spark, folder, "runs").select("run_id", F.row_number().over(W.orderBy("run_id")).cast("bigint").alias("failures"))
    return numbered.withColumn("wait_seconds", backoff_seconds(F.col("failures")))


# feeds

FLAGS = "list_transform(string_split(upper(coalesce(flags, '')), ','), lambda f: trim(f))"
LIVE = f"(coalesce(upper(trim(item_type)) = 'DOCUMENT', false) AND NOT list_contains({FLAGS}, 'CONFLICTED') AND NOT list_contains({FLAGS}, 'DELETEREVISION'))"
ETAG = r"CASE WHEN regexp_full_match(etag, '\s*\+?[0-9]+\s*') THEN try_cast(trim(etag) AS BIGINT) END"


def _items(spark, folder):
    return table(spark, folder, "iteration_items").withColumn("etag", parse_long(F.col("etag")))


@query(f"SELECT feed_seq, {ETAG} AS etag, {LIVE} AND {present('id')} AND {ETAG} IS NOT NULL AS keep FROM iteration_items")
def etag_page_filter(spark, folder):
    items = _items(spark, folder)
    keep = is_live_document(F.col("item_type"), F.col("flags")) & ~blank(F.col("id")) & F.col("etag").isNotNull()
    return items.select("feed_seq", "etag", keep.alias("keep"))


def _live(spark, folder):
    return _items(spark, folder).where(
        is_live_document(F.col("item_type"), F.col("flags")) & ~blank(F.col("id")) & F.col("etag").isNotNull()
    )


@query(f"""SELECT node_url, page_no, document_key, e AS etag, feed_seq FROM (SELECT *, upper(id) AS document_key, {ETAG} AS e FROM iteration_items WHERE {LIVE} AND {present("id")}) WHERE e IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY node_url, page_no, document_key ORDER BY e, feed_seq) = 1""")
def etag_first_seen(spark, folder):
    return first_seen(_live(spark, folder))


@query(f"""SELECT node_url, hash, left(hash, 4) AS prefix, count(*) AS n FROM (SELECT node_url, upper(sha256(upper(id) || chr(10) || {cv_norm("change_vector")})) AS hash FROM iteration_items WHERE {LIVE} AND {present("id")} AND {ETAG} IS NOT NULL) GROUP BY 1, 2, 3""")
def version_dedup(spark, folder):
    hashed = _live(spark, folder).select(
        "node_url", replicas.version_hash(key(F.col("id")), normalize(F.col("change_vector"))).alias("hash")
    )
    return hashed.groupBy("node_url", "hash", F.substring("hash", 1, 4).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT node_url, max({ETAG}) + 1 AS next_etag, count(*) AS n_items, count(*) FILTER ({LIVE}) AS n_live, min({ETAG}) AS first_etag, count(DISTINCT page_no) AS n_pages FROM iteration_items GROUP BY 1")
def safe_restart_etag(spark, folder):
    """Where each node's feed is to be read on: skipped items count too."""
    return _items(spark, folder).groupBy("node_url").agg(
        (F.max("etag") + 1).alias("next_etag"),
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(is_live_document(F.col("item_type"), F.col("flags"))).alias("n_live"),
        F.min("etag").alias("first_etag"),
        F.countDistinct("page_no").alias("n_pages"),
    )


@query(r"""WITH t AS (SELECT feed_seq, regexp_replace(trim(last_modified), '(\.\d{6})\d*', '\1') AS x FROM iteration_items)
SELECT feed_seq, CASE WHEN regexp_matches(x, '[+-]\d\d:\d\d$') THEN make_timestamp(epoch_us(try_cast(x AS TIMESTAMPTZ))) ELSE try_cast(regexp_replace(x, 'Z$', '') AS TIMESTAMP) END AS last_modified FROM t""")
def feed_timestamps(spark, folder):
    return table(spark, folder, "iteration_items").select("feed_seq", parse_iso(F.col("last_modified")).alias("last_modified"))


@query(f"SELECT DISTINCT node_url, upper(id) AS document_key, upper(sha256(upper(id) || chr(10) || {cv_norm('change_vector')})) AS version FROM iteration_items WHERE {LIVE} AND {present('id')}")
def stream_live_scan(spark, folder):
    """The feed read as a stream to its end, exactly once for each version."""
    whole = table(spark, folder, "iteration_items")
    path, at = scratch(spark, "live-versions"), scratch(spark, "live-cursor")
    source = f"{folder}/iteration_items.parquet"
    single = os.path.isfile(source)  # a stream reads folders: a single file is matched by a pattern
    run_to_end(
        live_versions(
            read_feed(spark, f"{folder}/iteration_item[s].parquet" if single else source, whole.schema)
        ).select("node_url", "document_key", "version"),
        path,
        at,
    )
    return spark.read.parquet(path)


# more of plans, runs and feeds


@query(EVALUATED + r" SELECT document_key, mismatch_type FROM found WHERE document_key NOT IN (SELECT upper(original_document_id) FROM node_document_snapshots WHERE regexp_matches(original_document_id, '[\\\x00-\x1f]'))")
def exclude_skipped(spark, folder):
    """Mismatches of documents that no import had to skip for their id."""
    rows = _rows(spark, folder)
    skipped = rows.where(replicas.has_unsafe_characters(F.col("original_document_id")))
    return planning.without(
        _evaluated(spark, folder).select("document_key", "mismatch_type"),
        F.col("document_key"),
        skipped,
        key(F.col("original_document_id")),
    )


@query(
    LATEST
    + """, c AS (SELECT upper(original_document_id) AS document_key, count(*) AS n_rows FROM l GROUP BY 1 HAVING count(*) < 3 OR count(DISTINCT upper(coalesce(change_vector, ''))) > 1)
SELECT document_key, n_rows FROM c ORDER BY document_key LIMIT 100 OFFSET 100"""
)
def candidate_page(spark, folder):
    """The second page of candidates by document; the limit is the feature."""
    return problem_candidates(spark, folder).select("document_key", "n_rows").orderBy("document_key").offset(100).limit(100)


@query(ALIGNED + " SELECT document_key, min(node_idx) FILTER (present) AS first_node, count(*) FILTER (present) AS n_nodes FROM grid GROUP BY 1")
def coverage_union(spark, folder):
    """What passes over one node after the other see: each document at the first node that has it, and how many have it."""
    held = F.filter("states", lambda s: s.present)
    return _aligned(spark, folder).select(
        "document_key", F.array_min(F.transform(held, lambda s: s.node_idx)).alias("first_node"), F.size(held).alias("n_nodes")
    )


DONE = f"""done AS (SELECT upper(document_id) AS k, {EFFECTIVE} AS outcome FROM mismatches WHERE {present("current_repair_decision")} AND document_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY upper(document_id) ORDER BY last_repair_updated_at DESC NULLS LAST, detected_at DESC NULLS LAST, current_repair_decision DESC) = 1)"""


@query(f"WITH {DONE} SELECT m.id, m.run_id, CASE WHEN {sql_blank('m.current_repair_decision')} THEN coalesce(d.outcome, m.repair_decision) ELSE m.current_repair_decision END AS decision FROM mismatches m LEFT JOIN done d ON upper(m.document_id) = d.k")
def decision_writeback(spark, folder):
    """Each mismatch with the last outcome of its document where it has none of its own."""
    rows = _mismatches(spark, folder)
    done = rows.where(~blank(F.col("current_repair_decision")) & F.col("document_id").isNotNull()).groupBy(key(F.col("document_id")).alias("k")).agg(
        F.max(F.struct("last_repair_updated_at", "detected_at", "current_repair_decision")).alias("w")
    )
    joined = rows.withColumn("_key", key(F.col("document_id"))).join(done, F.col("_key") == F.col("k"), "left")
    own = F.when(
        blank(F.col("current_repair_decision")), F.coalesce("w.current_repair_decision", "repair_decision")
    ).otherwise(F.col("current_repair_decision"))
    return joined.select("id", "run_id", own.alias("decision"))


@query(
    ALIGNED
    + f""", lastm AS (SELECT upper(document_id) AS document_key, observed_state FROM mismatches WHERE document_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY upper(document_id) ORDER BY detected_at DESC NULLS LAST, run_id DESC, id DESC) = 1),
o AS (SELECT document_key, unnest(observed_state) AS s FROM (SELECT document_key, observed_state FROM lastm)),
seen AS (SELECT document_key, upper(s.node_url) AS u, bool_or(coalesce(s.present, false)) AS present, max(CASE WHEN s.present THEN upper(coalesce(s.collection, '')) END) AS c,
  max(CASE WHEN s.present THEN {cv_norm("s.change_vector")} END) AS nv FROM o GROUP BY 1, 2),
now AS (SELECT document_key, upper(node_url) AS u, present, CASE WHEN present THEN upper(coalesce(c, '')) END AS c, CASE WHEN present THEN {cv_norm("cv")} END AS nv FROM grid)
SELECT l.document_key, bool_and(coalesce(s.present, false) = coalesce(w.present, false) AND s.c IS NOT DISTINCT FROM w.c AND s.nv IS NOT DISTINCT FROM w.nv) AS unchanged
FROM lastm l CROSS JOIN nodes n LEFT JOIN seen s ON s.document_key = l.document_key AND s.u = upper(n.node_url) LEFT JOIN now w ON w.document_key = l.document_key AND w.u = upper(n.node_url) GROUP BY 1"""
)
def observed_state_match(spark, folder):
    """Whether what was observed with the last mismatch of each document is still so on every configured node: presence,
    collection (ignoring case) and normalised vector."""
    nodes = _nodes(spark, folder)
    last = _mismatches(spark, folder).where(F.col("document_id").isNotNull()).groupBy(key(F.col("document_id")).alias("document_key")).agg(
        F.max(F.struct("detected_at", "run_id", "id", "observed_state")).alias("w")
    ).select("document_key", F.col("w.observed_state").alias("o"))
    now = _aligned(spark, folder).select(F.col("document_key").alias("k"), "states")
    both = last.join(now, F.col("document_key") == F.col("k"), "left")
    same = recovery.observed_unchanged(F.col("o"), F.col("states"), nodes, ignored_ids(spark))
    return both.select("document_key", same.alias("unchanged"))


@query("""WITH b AS (SELECT from_node, batch_no, count(*) AS n_rows, (epoch_us(max(received_at)) - epoch_us(min(received_at))) / 1e6 AS seconds FROM node_document_snapshots GROUP BY 1, 2)
SELECT from_node, batch_no, n_rows, n_rows - lag(n_rows) OVER (PARTITION BY from_node ORDER BY batch_no) AS change, round(n_rows / nullif(seconds, 0), 3) AS rows_a_second FROM b""")
def delivery_rates(spark, folder):
    """Rows of each node and delivery round, against the round before."""
    at = F.unix_micros(F.col("received_at").cast("timestamp"))
    rounds = _rows(spark, folder).groupBy("from_node", "batch_no").agg(
        F.count(F.lit(1)).alias("n_rows"), ((F.max(at) - F.min(at)) / 1e6).alias("seconds")
    )
    change = F.col("n_rows") - F.lag("n_rows").over(W.partitionBy("from_node").orderBy("batch_no"))
    return rounds.select(
        "from_node",
        "batch_no",
        "n_rows",
        change.alias("change"),
        F.round(F.col("n_rows") / F.nullif(F.col("seconds"), F.lit(0.0)), 3).alias("rows_a_second"),
    )


@query(f"""SELECT node_url, page_no, count(*) AS n_items, count(*) FILTER ({LIVE}) AS n_live, count(*) FILTER (coalesce(upper(trim(item_type)) <> 'DOCUMENT', true)) AS n_other_types,
  count(*) FILTER (list_contains({FLAGS}, 'CONFLICTED')) AS n_conflicted, count(*) FILTER ({ETAG} IS NULL) AS n_unreadable, min({ETAG}) AS first_etag, max({ETAG}) AS last_etag,
  count(*) - count(DISTINCT coalesce(upper(id), '')) AS n_repeated FROM iteration_items GROUP BY 1, 2""")
def page_diagnostics(spark, folder):
    """What was read and skipped on each page of the feeds."""
    kind, flags = F.col("item_type"), F.col("flags")
    conflicted = F.coalesce(F.exists(F.split(flags, ","), lambda f: key(strip(f)) == fixed.CONFLICTED), F.lit(False))
    return _items(spark, folder).groupBy("node_url", "page_no").agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if(is_live_document(kind, flags)).alias("n_live"), F.count_if(
            F.coalesce(key(strip(kind)) != fixed.DOCUMENT, F.lit(True))
        ).alias("n_other_types"), F.count_if(conflicted).alias("n_conflicted"),
        F.count_if(F.col("etag").isNull()).alias("n_unreadable"), F.min("etag").alias("first_etag"), F.max("etag").alias("last_etag"), (
            F.count(F.lit(1)) - F.countDistinct(F.coalesce(key(F.col("id")), F.lit("")))
        ).alias("n_repeated"),
    )


@query("SELECT run_id, run_mode, is_complete, coalesce(last_saved_at, started_at) AS heard_at FROM runs ORDER BY heard_at DESC, started_at DESC, run_id DESC LIMIT 10")
def recent_runs(spark, folder):
    """The ten runs heard of last; the limit is the feature."""
    return table(spark, folder, "runs").orderBy(
        views.recency().desc(), F.col("started_at").desc(), F.col("run_id").desc()
    ).limit(10).select("run_id", "run_mode", "is_complete", views.recency().alias("heard_at"))


# the projection of orders onto three replicas (FIXTURES.md), whose outcome is known in advance

PROJECTED_NODES = [replicas.Node(i, a, f"Node {a}", f"http://node-{a.lower()}") for i, a in enumerate("ABC")]
UNUSED = ["dbOld1"]


def projected_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """One document for each order on nodes A, B and C, with a deviation by order key modulo 20."""
    k = F.col("o_orderkey")
    r = F.col("r")
    base = table(spark, folder, "orders").select(
        k,
        F.col("o_orderdate").cast("timestamp_ntz").alias("last_modified"),
        (k % 20).alias("r"),
        F.explode(F.array(*map(F.lit, "ABC"))).alias("from_node"),
    )
    on = lambda node: F.col("from_node") == node
    absent = ((r == 0) & on("C")) | ((r == 1) & on("A")) | ((r == 5) & on("C")) | ((r == 7) & on("B")) | ((r == 13) & on("C"))
    a = 100 + k + F.when((r == 2) & on("B"), -1).when(r.isin(4, 5) & on("A"), 1).when(r.isin(12, 13) & on("B"), -1).when((r == 12) & on("C"), -2).otherwise(0)
    b = 10 + k % 7 + F.when((r == 3) & on("A"), -1).when(r.isin(4, 5) & on("B"), 1).otherwise(0)
    c = 5 + k % 5
    part = lambda tag, n, db: F.concat(
        tag if not isinstance(tag, str) else F.lit(tag), F.lit(":"), n.cast("string"), F.lit(f"-{db}")
    )
    first = F.when((r == 9) & on("B"), "RAFT").otherwise("A")
    plain = F.concat_ws(",", part(first, a, "dbA"), part("B", b, "dbB"), part("C", c, "dbC"))
    turned = F.concat_ws(", ", part("C", c, "dbC"), part("B", b, "dbB"), part("A", a, "dbA"))
    more = F.when((r == 8) & on("A"), ",TRXN:3-dbOld1").when((r == 11) & on("B"), ",SINK:1-dbA").when(
        (r == 16) & on("A"), ",bad,:3-x,Q:zz-dbQ"
    ).otherwise("")
    vector = F.when((r == 17) & on("B"), None).when((r == 10) & on("C"), turned).otherwise(F.concat(plain, more))
    collection = F.when(r == 7, None).when((r == 6) & on("B"), "Invoices").when((r == 15) & on("C"), "ORDERS").otherwise("Orders")
    document = F.concat(F.when(r == 14, "orders\\").otherwise("orders/"), k.cast("string"))
    return base.where(~absent).select(
        (k * 3 + F.ascii("from_node")).alias("delivery_id"), document.alias("original_document_id"), "from_node", vector.alias("change_vector"), collection.alias("collection"), "last_modified"
    )


def _projection_counts(ignored):
    skip = "" if ignored else "WHEN r = 8 THEN 'CV_MISMATCH'"
    return f"""SELECT mismatch_type, count(*) AS n FROM (SELECT CASE WHEN r IN (0, 1, 7, 13) THEN 'MISSING' WHEN r IN (2, 3, 12, 17) THEN 'CV_MISMATCH' WHEN r IN (4, 5) THEN 'AMBIGUOUS_CV'
  WHEN r = 6 THEN 'COLLECTION_MISMATCH' {skip} END AS mismatch_type FROM (SELECT o_orderkey % 20 AS r FROM orders)) WHERE mismatch_type IS NOT NULL GROUP BY 1"""


@query(_projection_counts(True))
def evaluate_projection(spark, folder):
    found = replicas.evaluate(replicas.align(projected_snapshots(spark, folder), PROJECTED_NODES), UNUSED)
    return found.groupBy("mismatch_type").agg(F.count(F.lit(1)).alias("n"))


@query(_projection_counts(False))
def evaluate_projection_no_ignore(spark, folder):
    found = replicas.evaluate(replicas.align(projected_snapshots(spark, folder), PROJECTED_NODES))
    return found.groupBy("mismatch_type").agg(F.count(F.lit(1)).alias("n"))
