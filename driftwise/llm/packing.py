"""Items of varying length into containers of fixed capacity.

The plan is made over the histogram of lengths, not over items: best fit in order of decreasing length, many containers at
a step. A step puts the items of one length with ranks in a range into a range of containers, a fixed number in each, so a
plan is a short table of such steps. Items then find their step by their length and their rank within it.

The histogram has at most ``capacity`` rows, whatever the number of items. So does the plan, up to a factor: a range of
containers that a length fills completely keeps less than half of its gap, hence is filled at most log2(capacity) times, and
each length splits off two ranges at most. The plan of a million items is as large as that of a billion; it is the only
thing that the driver sees and that is broadcast.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.operators.ranking import rank_within

PLAN_SCHEMA = "length bigint, first_rank bigint, last_rank bigint, first_container bigint, each bigint, fill bigint"


def plan_containers(histogram: Iterable[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first rank, last rank, first container, items in each, tokens in the container before them).

    ``histogram``: (length, count) with lengths from 1 to ``capacity``. The item of rank r of a step goes to container
    first_container + (r - first_rank) // each. Among containers with the same gap the first made is filled first."""
    steps: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[int] = []  # gaps that containers have, ascending
    ranges: dict[int, list[tuple[int, int]]] = {}  # by gap: (first container, number of containers), the next to use last
    made = 0

    def leave(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in ranges:
                bisect.insort(gaps, gap)
                ranges[gap] = []
            ranges[gap].append((first, count))

    for length, count in sorted(histogram, reverse=True):
        rank = 0
        while rank < count:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, there = ranges[gap].pop()
                if not ranges[gap]:
                    del ranges[gap], gaps[at]
            else:
                gap, first, there = capacity, made, -(-(count - rank) // (capacity // length))
                made += there
            each = gap // length
            full = min(there, (count - rank) // each)
            if full:
                steps.append((length, rank, rank + full * each - 1, first, each, capacity - gap))
                rank += full * each
                leave(gap - each * length, first, full)
            over = count - rank if full < there else 0
            if over:  # the last container that this length needs takes fewer
                steps.append((length, rank, count - 1, first + full, each, capacity - gap))
                leave(gap - over * length, first + full, 1)
                rank = count
            leave(gap, first + full + bool(over), there - full - bool(over))
    return steps


def pack(items: DataFrame, item_id: str, size: str, capacity: int) -> DataFrame:
    """One row for each piece: ``item_id``, ``piece`` (from 0), ``first_token``, ``n_tokens``, ``container_id`` and
    ``container_offset`` (the tokens before it in its container).

    An item is one piece unless its ``size`` exceeds ``capacity``; then it is cut into pieces of ``capacity`` tokens, which
    fill a container each, and a rest. Items of null or no size take no room: they come as one piece of 0 tokens without a
    container. ``item_id`` must be unique; equal sizes are told apart by it. An empty table gives an empty one.

    Only ids and sizes are moved, never texts. A length that a third of the items have is ranked in slices."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    sized = items.select(F.col(item_id).alias("item"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("all"))
    piece = lambda n, at, of: F.struct(
        n.cast("bigint").alias("piece"), at.cast("bigint").alias("first_token"), of.cast("bigint").alias("length")
    )
    whole = F.floor(F.col("all") / capacity)
    rest = F.col("all") % capacity
    pieces = F.transform(
        F.sequence(F.lit(0), F.ceil(F.col("all") / capacity) - 1),
        lambda n: piece(n, n * capacity, F.when(n < whole, F.lit(capacity)).otherwise(rest)),
    )
    parts = sized.where(F.col("all") > 0).select("item", F.explode(pieces).alias("p")).select("item", "p.*")
    histogram = parts.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    counted = [(r["length"], r["n"]) for r in histogram.collect()]  # at most ``capacity`` rows
    spark = items.sparkSession
    plan = spark.createDataFrame(plan_containers(counted, capacity), PLAN_SCHEMA).withColumnRenamed("length", "of")
    sizes = spark.createDataFrame(counted, "length bigint, n bigint")
    ranked = rank_within(parts, ["length"], ["item", "piece"], F.broadcast(sizes))
    within = F.col("rank") - F.col("first_rank")
    placed = ranked.join(F.broadcast(plan), (F.col("of") == F.col("length")) & F.col("rank").between(F.col("first_rank"), F.col("last_rank"))).select(
        "item", "piece", "first_token", F.col("length").alias("n_tokens"),
        (F.col("first_container") + F.floor(within / F.col("each"))).cast("bigint").alias("container_id"),
        (F.col("fill") + within % F.col("each") * F.col("length")).alias("container_offset"),
    )
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    empty = sized.where(F.col("all") <= 0).select(
        "item",
        zero.alias("piece"),
        zero.alias("first_token"),
        zero.alias("n_tokens"),
        none.alias("container_id"),
        none.alias("container_offset"),
    )
    return placed.unionAll(empty).withColumnRenamed("item", item_id)
