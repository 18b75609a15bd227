"""What changed between consecutive full snapshots.

Gaps and islands: over the snapshots of an owner, the runs of consecutive snapshots in which a key has the same row hash are
its validity intervals. An interval that starts where another of the key ended the snapshot before is a change, any other
start an addition, an end without such a successor a removal.

Skew: rows of a key within a snapshot are first reduced to the one that counts, by partial aggregation. After that a key has
at most one row for each snapshot, so the windows over a key are bounded by the number of snapshots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftwise.session import cut, small


def snapshot_numbers(rows: DataFrame, owner: Column, snapshot: Column) -> DataFrame:
    """``owner``, ``snapshot``, ``i`` (its position among the owner's, from 1) and ``n_snapshots``: one row for each snapshot,
    computed once, few enough in any use to be broadcast, which is checked."""
    names = rows.select(owner.alias("owner"), snapshot.alias("snapshot")).distinct()
    by = W.partitionBy("owner")
    numbered = names.select(
        "owner", "snapshot", F.row_number().over(by.orderBy("snapshot")).alias("i"), F.count(F.lit(1)).over(by).alias("n_snapshots")
    )
    return small(cut(numbered))


def validity_intervals(
    rows: DataFrame,
    owner: Column,
    snapshot: Column,
    key: Column,
    content: Sequence[Column],
    rank: Sequence[Column],
    numbers: DataFrame | None = None,
) -> DataFrame:
    """One row for each interval: ``owner``, ``key``, ``first`` and ``last`` (positions among the owner's snapshots, from 1),
    ``row_hash``, and ``n_snapshots`` of the owner.

    The snapshots of an owner are the distinct values of ``snapshot`` in its rows, in order. Of several rows of a key in one
    snapshot the one with the greatest ``rank`` (columns in order, null least) counts, among equal ranks the greatest
    content hash. Null keys are no records, but their rows still make a snapshot exist; a null owner or snapshot is a value
    like any other. Content is compared by a 128-bit hash over all of it, in which nulls are equal to each other and differ
    from every value. An empty table gives no intervals."""
    numbers = snapshot_numbers(rows, owner, snapshot) if numbers is None else numbers
    # each value after its length, so that no two contents have the same text
    told = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    whole = F.concat(*[told(c.cast("string")) for c in content])
    plain = rows.select(
        owner.alias("owner"),
        snapshot.alias("snapshot"),
        key.alias("key"),
        F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)]).alias("rank"),
        F.md5(whole).alias("row_hash"),
    )
    one = plain.where(F.col("key").isNotNull()).groupBy("owner", "snapshot", "key").agg(F.max(F.struct("rank", "row_hash")).alias("w"))
    at = one.alias("o").join(
        numbers.alias("n"), F.col("o.owner").eqNullSafe(F.col("n.owner")) & F.col("o.snapshot").eqNullSafe(F.col("n.snapshot"))
    ).select("o.owner", "o.key", F.col("w.row_hash").alias("row_hash"), "i", "n_snapshots")
    same = W.partitionBy("owner", "key").orderBy("i")
    starts = ~(F.lag("row_hash").over(same).eqNullSafe(F.col("row_hash")) & F.lag("i").over(same).eqNullSafe(F.col("i") - 1))
    islands = at.withColumn("starts", starts.cast("int")).withColumn("island", F.sum("starts").over(same))
    return islands.groupBy("owner", "key", "island").agg(
        F.min("i").alias("first"),
        F.max("i").alias("last"),
        F.any_value("row_hash").alias("row_hash"),
        F.any_value("n_snapshots").alias("n_snapshots"),
    ).drop("island")


def snapshot_changes(
    rows: DataFrame, owner: Column, snapshot: Column, key: Column, content: Sequence[Column], rank: Sequence[Column]
) -> DataFrame:
    """``owner``, ``snapshot`` (the later of the two), ``key`` and ``change``: added, removed or changed.

    Parameters and cases as in :func:`validity_intervals`. The first snapshot of an owner changes nothing."""
    numbers = snapshot_numbers(rows, owner, snapshot)
    spans = validity_intervals(rows, owner, snapshot, key, content, rank, numbers)
    by = W.partitionBy("owner", "key").orderBy("first")
    met = spans.select(
        "owner",
        "key",
        "first",
        "last",
        "n_snapshots",
        (F.lag("last").over(by) == F.col("first") - 1).alias("follows"),
        (F.lead("first").over(by) == F.col("last") + 1).alias("goes_on"),
    )
    start = F.when(
        F.col("first") > 1, F.struct(F.col("first").alias("i"), F.when(F.col("follows"), "changed").otherwise("added").alias("change"))
    )
    end = F.when(
        (F.col("last") < F.col("n_snapshots")) & ~F.coalesce("goes_on", F.lit(False)),
        F.struct((F.col("last") + 1).alias("i"), F.lit("removed").alias("change")),
    )
    events = met.select("owner", "key", F.explode(F.array_compact(F.array(start, end))).alias("e")).select("owner", "key", "e.*")
    return events.alias("e").join(
        numbers.alias("n"), F.col("e.owner").eqNullSafe(F.col("n.owner")) & (F.col("e.i") == F.col("n.i"))
    ).select("e.owner", "n.snapshot", "e.key", "e.change")
