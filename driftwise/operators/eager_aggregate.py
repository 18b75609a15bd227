"""Aggregation of a join, computed before the join.

``aggregate_join`` gives, for ``SELECT groups, count(*), count(DISTINCT key), ... FROM left LEFT JOIN right ON key GROUP BY
groups``, the result without ever making the joined rows: both inputs shrink to one state for each join key (and group) by
partial aggregation, states are joined, counts are multiplied, and the products are rolled up.

Skew: a key or a group that holds a third of the rows is combined on the map side into one state for each map task before
anything is shuffled. No list of rows is collected anywhere. The join is between states that are unique on the right, so its
output is no larger than the left states.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregate_join(
    left: DataFrame,
    right: DataFrame,
    left_key: Column,
    right_key: Column,
    groups: Mapping[str, Column],
    *,
    right_sums: Mapping[str, Column] | None = None,
    left_sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row for each combination of ``groups`` (columns of ``left``), as a left outer join would give it.

    Columns: the groups, ``n_rows`` (rows of left), ``n_keys`` (distinct join keys of left), ``n_joined`` (rows of the left
    outer join, a row without partner counting once), ``n_matched`` (those with a partner), for each of ``left_sums`` its
    sum over the joined rows, and for each of ``right_sums`` likewise.

    Nulls: a null join key has no partner and is no distinct key, its rows count. Null groups are a group. Empty inputs give
    an empty result (left) or no partners (right). Repeated rows all count. Columns of the inputs other than those in the
    expressions never enter, so their names can't clash."""
    right_sums, left_sums = right_sums or {}, left_sums or {}
    g = [f"g{i}" for i in range(len(groups))]
    states = (
        left.select(
            left_key.alias("k"),
            *[c.alias(n) for n, c in zip(g, groups.values(), strict=True)],
            *[c.alias(f"l{i}") for i, c in enumerate(left_sums.values())],
        )
        .groupBy("k", *g)
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"l{i}").alias(f"l{i}") for i in range(len(left_sums))])
    )
    partners = (
        right.select(right_key.alias("rk"), *[c.alias(f"r{i}") for i, c in enumerate(right_sums.values())])
        .where(F.col("rk").isNotNull())
        .groupBy("rk")
        .agg(F.count(F.lit(1)).alias("m"), *[F.sum(f"r{i}").alias(f"r{i}") for i in range(len(right_sums))])
    )
    joined = states.join(partners, states["k"] == partners["rk"], "left")
    # a key with several groups is one state for each of them, and distinct within each: counting states counts keys
    return joined.groupBy(*g).agg(
        F.sum("n").alias("n_rows"),
        F.count("k").alias("n_keys"),
        F.sum(F.col("n") * F.coalesce("m", F.lit(1))).alias("n_joined"),
        F.sum(F.col("n") * F.coalesce("m", F.lit(0))).alias("n_matched"),
        *[F.sum(F.col(f"l{i}") * F.coalesce("m", F.lit(1))).alias(name) for i, name in enumerate(left_sums)],
        *[F.sum(F.col(f"r{i}") * F.col("n")).alias(name) for i, name in enumerate(right_sums)],
    ).withColumnsRenamed(dict(zip(g, groups, strict=True)))


def heavy_groups(groups: DataFrame, total: DataFrame, one_in: int) -> DataFrame:
    """The rows of ``groups`` (with ``n_rows``) that hold at least one in ``one_in`` of the rows that ``total``, one row and
    one column, counts. Without rows there are no heavy groups."""
    whole = total.select(F.col(total.columns[0]).alias("whole")).scalar()
    return groups.where(F.col("n_rows") * one_in >= whole)
