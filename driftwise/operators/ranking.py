"""Positions of rows within groups, and joins by hot keys, without putting a group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a group that one task is meant to number.
SLICE_ROWS = 100_000
#: Tasks that :func:`join_spread` spreads the rows of a key over.
WAYS = 8


def same(left: Sequence[str], right: Sequence[str]) -> Column:
    """That columns agree pair by pair, nulls being equal to each other."""
    on = F.lit(True)
    for a, b in zip(left, right, strict=True):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def join_spread(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], *, by: Sequence[str], how: str = "inner", ways: int = WAYS) -> DataFrame:
    """``left`` joined with ``right``, a table of few rows for each key, by pairs of columns (left, right) whose names differ,
    nulls being equal. The rows of one key of ``left`` are spread over ``ways`` tasks by a hash of their columns ``by``; rows
    of ``right`` come ``ways`` times for that. The key columns of ``right`` stay."""
    salted = left.withColumn("_way", F.pmod(F.xxhash64(*by), F.lit(ways)))
    each = right.withColumn("_ways", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(ways - 1).cast("bigint"))))
    met = salted.join(each, same([a for a, _ in on], [b for _, b in on]) & (F.col("_way") == F.col("_ways")), how)
    return met.drop("_way", "_ways")


def rank_within(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    sizes: DataFrame,
    *,
    rank: str = "rank",
    slice_rows: int = SLICE_ROWS,
    carry: Sequence[str] = (),
    ways: int = 1,
) -> DataFrame:
    """``df`` with ``rank``: the position, from 0, of each row within its group of ``by``.

    ``sizes`` has the columns ``by`` and ``n``, the number of rows of each group, and any columns to ``carry`` over to the
    rows; rows of groups that it hasn't are left out. Groups of more than ``slice_rows`` rows are cut into slices by a hash
    of ``order``; rows are numbered within their slice, and a slice starts where the ones before it end. The order of a
    group is that of (slice, ``order``): total, and the same in every run, if ``order`` is unique in the group, which also
    must hold for the slices to be even. Null group values are values. ``ways``: over how many tasks the rows of a group
    are spread when they meet their size; 1 leaves that to Spark, as for a size table that is broadcast."""
    slices = F.greatest(F.lit(1), F.ceil(F.col("_n") / slice_rows)).cast("bigint")
    named = sizes.select(*[F.col(c).alias(f"_s_{c}") for c in by], F.col("n").alias("_n"), *carry)
    pairs = [(c, f"_s_{c}") for c in by]
    met = join_spread(df, named, pairs, by=order, ways=ways) if ways > 1 else df.join(named, same(by, [b for _, b in pairs]))
    sized = met.withColumn("_slice", F.pmod(F.xxhash64(*order), slices)).drop(*[b for _, b in pairs])
    cut = sized.where(F.col("_n") > slice_rows).groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_c"))
    starts = cut.select(
        *[F.col(c).alias(f"_t_{c}") for c in by],
        F.col("_slice").alias("_t"),
        (F.sum("_c").over(W.partitionBy(*by).orderBy("_slice")) - F.col("_c")).alias("_start"),
    )
    numbered = sized.withColumn("_r", F.row_number().over(W.partitionBy(*by, "_slice").orderBy(*order)) - 1)
    on = (F.col("_t") == F.col("_slice")) & same(by, [f"_t_{c}" for c in by])
    return numbered.join(starts, on, "left").withColumn(rank, F.col("_r") + F.coalesce("_start", F.lit(0))).drop(
        "_r", "_n", "_slice", "_t", "_start", *[f"_t_{c}" for c in by]
    )


def repeated(df: DataFrame, times: Column, name: str, block: int = 4096) -> DataFrame:
    """``df`` with each row so many ``times``, and ``name``, the number of the copy from 1. Copies are counted out in blocks, so
    that no row makes an array of all its copies."""
    blocks = df.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((times - 1) / block).cast("bigint"))))
    first = F.col("_block") * block + 1
    return blocks.withColumn(name, F.explode(F.sequence(first, F.least(times.cast("bigint"), first + block - 1)))).drop("_block")
