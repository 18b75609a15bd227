"""From mismatches to plans: decisions, exclusions, groups, chunks and single items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwise import fixed
from driftwise.functions.vectors import blank, key
from driftwise.operators.ranking import rank_within
from driftwise.session import cut, small

PLANNED, AMBIGUOUS, COLLECTION = fixed.PLANNED, fixed.SKIPPED_AMBIGUOUS, fixed.SKIPPED_COLLECTION
GROUP = ["winner_node", "collection", "winner_cv"]


def decision() -> Column:
    """What is to be done about an evaluated document."""
    kind = F.col("mismatch_type")
    unclear = (kind == fixed.COLLECTION_MISMATCH) | blank(F.col("collection")) | blank(F.col("winner_node"))
    return F.when(kind == fixed.AMBIGUOUS_CV, AMBIGUOUS).when(unclear, COLLECTION).otherwise(PLANNED)


def effective_decision() -> Column:
    """The current decision, unless it is blank, else the first one."""
    return F.when(blank(F.col("current_repair_decision")), F.col("repair_decision")).otherwise(F.col("current_repair_decision"))


def without(rows: DataFrame, row_key: Column, excluded: DataFrame, excluded_key: Column) -> DataFrame:
    """Rows whose key isn't excluded: guards, skipped imports, documents repaired before. The excluded keys are made
    distinct first, so a key that is excluded a million times is one row of the join."""
    gone = excluded.select(excluded_key.alias("_gone")).where(F.col("_gone").isNotNull()).distinct()
    return rows.withColumn("_key", row_key).join(gone, F.col("_key") == F.col("_gone"), "left_anti").drop("_key")


def without_existing(rows: DataFrame, stored: DataFrame, row_id: str, fallback: Sequence[str]) -> DataFrame:
    """Rows that ``stored`` has neither under their id nor, where it was stored under another, with the same ``fallback`` columns.
    Nulls are equal to nothing."""
    ids = stored.select(F.col(row_id).alias("_id")).where(F.col("_id").isNotNull()).distinct()
    known = stored.select(*[F.col(c).alias(f"_f_{c}") for c in fallback]).dropna().distinct()
    on = F.lit(True)
    for c in fallback:
        on = on & (F.col(c) == F.col(f"_f_{c}"))
    return rows.join(ids, F.col(row_id) == F.col("_id"), "left_anti").join(known, on, "left_anti")


def among(rows: DataFrame, row_key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """Rows whose key is wanted; the complement of :func:`without` but for null keys."""
    kept = wanted.select(wanted_key.alias("_kept")).distinct()
    return rows.withColumn("_key", row_key).join(kept, F.col("_key") == F.col("_kept"), "left_semi").drop("_key")


def group_id() -> Column:
    """Digest of what a group is made by: equal exactly, case and spaces counting, nulls apart from empty values."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(F.concat(F.lit("+"), F.col(c)), F.lit("-")) for c in GROUP]), 256)


def repair_groups(planned: DataFrame) -> DataFrame:
    """One row for each winner node, collection and winning vector, with the number of documents and the least and greatest
    id. Members are rows of :func:`plan_items`: a group of a third of all documents isn't gathered into a list."""
    return planned.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n_docs"), F.min("document_id").alias("first_document"), F.max("document_id").alias("last_document")
    )


def repair_group_nodes(planned: DataFrame) -> DataFrame:
    """One row for each group of :func:`repair_groups`, with the nodes that any of its documents affects, distinct and in order
    (``affected_nodes``, comma-joined; empty if there are none), and their number. Sets are bounded by the nodes, and combine
    on the map side."""
    nodes = planned.select(*GROUP, F.explode_outer(F.split("affected_nodes", ",")).alias("node"))
    union = F.sort_array(F.collect_set(F.when(F.col("node") != "", F.col("node"))))
    return nodes.groupBy(*GROUP).agg(union.alias("u")).select(
        *GROUP, F.array_join("u", ",").alias("affected_nodes"), F.size("u").cast("bigint").alias("n_nodes")
    )


def plan_items(planned: DataFrame) -> DataFrame:
    """One row for each document of a plan, with a deterministic id, and the group it belongs to."""
    return planned.select(
        F.sha2(F.concat(group_id(), F.lit("/"), key(F.col("document_id"))), 256).alias("item_id"),
        "document_id",
        group_id().alias("group_id"),
    ).distinct()


def chunks(rows: DataFrame, by: Sequence[str], order: str, size: int) -> DataFrame:
    """``rows`` with ``chunk``: the number, from 0, of the chunk of at most ``size`` rows within its group. Sizes of groups are
    computed once, and broadcast if they are checked to be few, so that a hot group isn't shuffled to meet its size."""
    sizes = small(cut(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))))
    return rank_within(rows, by, [order], sizes).withColumn("chunk", F.floor(F.col("rank") / size)).drop("rank")


def preferred_mismatches(mismatches: DataFrame) -> DataFrame:
    """One mismatch for each document: a planned one first, then the one updated last, then the one detected last, then the
    greatest id, run and decision; ``document_key``, ``id``, ``run_id``, ``decision``."""
    planned = (effective_decision() == PLANNED).cast("int")
    order = F.struct(planned.alias("p"), "last_repair_updated_at", "detected_at", "id", "run_id", effective_decision().alias("decision"))
    best = mismatches.groupBy(key(F.col("document_id")).alias("document_key")).agg(F.max(order).alias("w"))
    return best.select("document_key", "w.id", "w.run_id", "w.decision")
