"""Mixing sources to target weights.

Tokens are summed by source, which gives each source the rate at which its records must be repeated; a record then comes
floor(rate) times, and once more with the probability of the rate's fraction, decided by a hash of its id and a seed. No
record has to be compared or counted together with others, so there is no shuffle of records and the draw is the same in
every run, on every cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwise.session import small


def uniform(seed: int, identifier: Column) -> Column:
    """A number in [0, 1) from a hash of seed and identifier (null as an empty one): the first 8 hex digits of an MD5 sum over
    2^32."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(identifier.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


#: As ``total``: as many tokens as the sources with a target hold.
ALL = "all"


def mix_rates(records: DataFrame, source: str, size: str, targets: DataFrame, total: float | str | None = None) -> DataFrame:
    """For each source of ``targets``: ``source``, ``target_share``, ``max_repeats``, ``n_records``, ``n_tokens`` and ``rate``.

    Without ``total`` the mix is as large as the caps allow while every source with tokens keeps its share of it; with
    ``total`` tokens wanted (a number, or :data:`ALL`), a source whose cap binds falls short and the mix with it. Sources without tokens can give nothing: their rate is 0
    and the shares of the others keep their proportions. Records of null or unknown source aren't used. Several targets
    for a source add up, with the greatest cap; null, negative and zero shares and caps give rate 0, and of a
    cap only its whole part counts."""
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
    )
    held = records.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("_s")).agg(
        F.count(F.lit(1)).alias("n_records"), F.sum(size).cast("bigint").alias("n_tokens")
    )
    known = wanted.join(held, F.col("source") == F.col("_s"), "left").select(
        "source",
        "target_share",
        "max_repeats",
        F.coalesce("n_records", F.lit(0)).alias("n_records"),
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
    )
    usable = (F.col("n_tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") >= 1)
    # one number for the whole table: the largest mix in which no cap binds
    if total is None:
        room = F.min(F.when(usable, F.col("max_repeats") * F.col("n_tokens") / F.col("target_share")))
    else:
        wanted_tokens = F.sum(F.when(usable, F.col("n_tokens"))).cast("double") if total == ALL else F.lit(float(total))
        room = wanted_tokens / F.sum(F.when(usable, F.col("target_share")))
    scale = known.agg(room.alias("room")).scalar()
    rate = F.when(
        usable, F.least(F.floor("max_repeats").cast("double"), F.col("target_share") * scale / F.col("n_tokens"))
    ).otherwise(F.lit(0.0))
    return known.withColumn("rate", rate)


def mix(
    records: DataFrame, record_id: str, source: str, size: str, targets: DataFrame, *, seed: int = 0, total: float | str | None = None
) -> DataFrame:
    """One row for each copy: ``record_id``, ``source``, ``n_tokens`` and ``copy`` (from 1, at most max_repeats).

    ``targets``: source, target_share, max_repeats; see :func:`mix_rates` for what becomes of odd ones. ``record_id`` must be
    unique: rows that share it share their draw. A record without tokens is drawn like any other. An empty table, or none
    of its sources wanted, gives an empty mix."""
    rates = mix_rates(records, source, size, targets, total).where(F.col("rate") > 0).select(F.col("source").alias("_s"), "rate")
    # as many rows as targets has, which is checked; hot sources are no matter then
    drawn = records.select(F.col(record_id).alias("record"), F.col(source).alias("source"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n_tokens")).join(
        small_side(rates, targets), F.col("source") == F.col("_s")
    )
    once_more = (uniform(seed, F.col("record")) < F.col("rate") - F.floor("rate")).cast("bigint")
    copies = drawn.withColumn("copies", F.floor("rate") + once_more).where(F.col("copies") > 0)
    return copies.select(
        F.col("record").alias(record_id),
        "source",
        "n_tokens",
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"),
    )


def small_side(rates: DataFrame, targets: DataFrame) -> DataFrame:
    """``rates`` marked for broadcasting if ``targets``, which has no fewer rows, is small."""
    return F.broadcast(rates) if small(targets) is not targets else rates


def mix_shares(
    records: DataFrame, record_id: str, source: str, size: str, targets: DataFrame, *, seed: int = 0, total: float | str | None = None
) -> DataFrame:
    """For each source of ``targets`` what :func:`mix_rates` has, and of the mix: ``mixed_records``, ``mixed_tokens`` and
    ``actual_share`` of all its tokens (null if the mix has none)."""
    rates = mix_rates(records, source, size, targets, total)
    got = mix(records, record_id, source, size, targets, seed=seed, total=total).groupBy(F.col("source").alias("_s")).agg(
        F.count(F.lit(1)).alias("mixed_records"), F.sum("n_tokens").alias("mixed_tokens")
    )
    joined = rates.join(got, F.col("source") == F.col("_s"), "left").drop("_s").fillna(0, ["mixed_records", "mixed_tokens"])
    whole = got.agg(F.sum("mixed_tokens").alias("whole")).scalar()
    return joined.withColumn("actual_share", F.col("mixed_tokens") / F.nullif(whole, F.lit(0)))
