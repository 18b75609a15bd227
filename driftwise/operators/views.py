"""Views over stored mismatches and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftwise import fixed
from driftwise.functions.vectors import blank
from driftwise.operators.planning import effective_decision

OVERVIEW = ["id", "run_id", "document_id", "collection", "mismatch_type"]


def manual_review(mismatches: DataFrame) -> DataFrame:
    """Ambiguous documents with the nodes that hold them and the different vectors that were seen there."""
    held = F.filter("observed_state", lambda s: s.present)
    vectors = F.array_distinct(F.filter(F.transform(held, lambda s: s.change_vector), lambda v: ~blank(v)))
    return mismatches.where(F.col("mismatch_type") == fixed.AMBIGUOUS_CV).select(
        *OVERVIEW, F.array_join(
            F.sort_array(F.transform(held, lambda s: s.node_url)), ","
        ).alias("present_nodes"), F.coalesce(F.size(held), F.lit(0)).alias("n_present"), F.array_join(F.sort_array(vectors), " | ").alias("vectors"), F.coalesce(F.size(vectors), F.lit(0)).alias("n_vectors")
    )


def by_decision(mismatches: DataFrame, wanted: str) -> DataFrame:
    """Mismatches whose effective decision is ``wanted``, with their winner."""
    return mismatches.where(effective_decision() == wanted).select(*OVERVIEW, "winner_node", "winner_cv")


def lookup(mismatches: DataFrame, documents: DataFrame) -> DataFrame:
    """The mismatches of ``documents`` (``document_key``, repeated ones and nulls allowed), by run and document."""
    wanted = documents.select(F.col("document_key").alias("_k")).where(F.col("_k").isNotNull()).distinct()
    named = mismatches.withColumn("document_key", F.upper("document_id"))
    return named.join(wanted, F.col("document_key") == F.col("_k"), "left_semi").select(
        "run_id", "document_key", "id", "collection", "mismatch_type", "winner_node", effective_decision().alias("decision")
    )


def unhealthy(mismatches: DataFrame) -> DataFrame:
    return mismatches.select(
        *OVERVIEW,
        "winner_node",
        effective_decision().alias("decision"),
        F.size(F.filter("observed_state", lambda s: ~s.present)).alias("n_missing"),
    )


def run_overview(mismatches: DataFrame) -> DataFrame:
    """Counts for each run, with the share of the most frequent type: combined on the map side."""
    kinds = [fixed.MISSING, fixed.CV_MISMATCH, fixed.AMBIGUOUS_CV, fixed.COLLECTION_MISMATCH]
    return mismatches.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(F.upper("document_id")).alias("n_documents"),
        *[F.count_if(F.col("mismatch_type") == k).alias(k.lower()) for k in kinds],
        F.min("detected_at").alias("first_detected"),
        F.max("detected_at").alias("last_detected"),
    )


def scan_ranges(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """What each live scan has read: its source node, and the etags from which and up to which it scanned."""
    names = nodes.select(F.col("node_idx").alias("_i"), F.col("node_label").alias("source_node"))
    by_node = W.partitionBy("source_node_index").orderBy("started_at", "run_id")
    start = F.coalesce(F.lag("safe_restart_etag").over(by_node), F.lit(0))
    scans = runs.where(F.col("run_mode") == "LiveETagScan").withColumn("start_etag", start)
    return scans.join(names, F.col("source_node_index") == F.col("_i"), "left").select(
        "run_id", "source_node", "start_etag", (F.col("safe_restart_etag") - 1).alias("end_etag")
    )


def recency() -> Column:
    """When a run was last heard of."""
    return F.coalesce("last_saved_at", "started_at")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest run of each mode and source node."""
    order = W.partitionBy("run_mode", "source_node_index").orderBy(recency().desc(), F.col("started_at").desc(), F.col("run_id").desc())
    return runs.withColumn("rn", F.row_number().over(order)).where("rn = 1").select(
        "run_mode", "source_node_index", "run_id", "is_complete", "safe_restart_etag"
    )


def run_lineage(runs: DataFrame) -> DataFrame:
    """Applying runs with the scan they apply and the latest snapshot before it."""
    scans = runs.select(
        F.col("run_id").alias("scan_id"),
        F.col("run_mode").alias("scan_run_mode"),
        F.col("repairs_planned").alias("planned"),
        F.coalesce("source_snapshot_cache_run_id", "source_snapshot_run_id").alias("snapshot_run_id"),
    )
    applied = runs.where(F.col("run_mode") == "ApplyRepairPlan")
    return applied.join(scans, F.col("source_repair_plan_run_id") == F.col("scan_id"), "left").select(
        "run_id", "is_complete", "scan_id", "scan_run_mode", "planned", "snapshot_run_id"
    )


def run_heads(runs: DataFrame) -> DataFrame:
    """For each mode the latest run, the latest complete one with its etag, and the latest that is under way."""
    at = lambda c: F.struct(recency().alias("at"), "started_at", "run_id", c.alias("x"))
    done = F.col("is_complete")
    none = F.lit(None).cast("bigint")
    folded = runs.groupBy("run_mode").agg(
        F.count(F.lit(1)).alias("n_runs"), F.max(at(none)).alias("l"), F.max(
            F.when(done, at(F.col("safe_restart_etag")))
        ).alias("c"), F.max(F.when(~done, at(none))).alias("o"), F.sum("mismatches_found").alias("mismatches_found"), F.coalesce(F.min("safe_restart_etag"), F.lit(0)).alias("safe_restart_etag")
    )
    return folded.select(
        "run_mode",
        "n_runs",
        F.col("l.run_id").alias("latest_run"),
        F.col("c.run_id").alias("latest_complete"),
        F.col("c.x").alias("complete_etag"),
        F.col("o.run_id").alias("latest_open"),
        "mismatches_found",
        "safe_restart_etag",
    )
