"""Exactly one copy of messages that were delivered at least once.

Deliveries are stored in time buckets. Within a bucket copies are reduced by exact aggregation. Across buckets every bucket
has a Bloom filter: an identifier that no other bucket's filter knows is definitely new and isn't compared with anything;
the possible repeats alone are verified exactly, against each other: since filters have no false negatives, whatever could
match a possible repeat in a bucket that its filter named is itself one.

A filter is blocked: a list of 64-bit words, an identifier belonging to the word that one hash names, with four bits in it
that another one names. The number of words follows the number of all rows, not of a bucket's: what an identifier is probed
against is the or of the filters of all other buckets, which together hold no more identifiers than there are words for, so
false positives stay under 1 % in sum, however many buckets there are.

Rows come together by word once. The words of the other buckets are then a bit-wise or over the rows before and after those
of the same bucket, a window over the few rows of a word, and as copies of an identifier have the same word, possible
repeats are verified where they are. Nothing is broadcast, and no filter has to fit anywhere as a whole.

Skew: copies of one identifier in a bucket are combined on the map side, before rows come together by word.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftwise.functions.vectors import key

#: Identifiers that a word of 64 bits is meant for, and bits that each of them sets.
WORD_IDS, BITS = 4, 4
#: Less than any bucket: stands for the null one, and leaves room for a step down.
NO_BUCKET = -(2**40)


def word_count(rows: DataFrame) -> Column:
    """The number of words for as many identifiers as there are ``rows``, as a scalar subquery that reads no column."""
    return F.greatest(F.lit(1), rows.agg(F.count(F.lit(1)).alias("n")).scalar() / WORD_IDS).cast("bigint")


def word_and_mask(identifier: Column, words: Column) -> list[Column]:
    """``word`` and ``mask``: where the identifier's bits are."""
    h, mask = F.xxhash64(identifier, F.lit(1)), F.lit(0).cast("bigint")
    for i in range(BITS):
        bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return [F.pmod(F.xxhash64(identifier), words).alias("word"), mask.alias("mask")]


def filters(keys: DataFrame, words: Column) -> DataFrame:
    """Bloom filters of ``keys`` (columns bucket and key): ``bucket``, ``word`` and its ``bits``."""
    return keys.select("bucket", *word_and_mask(F.col("key"), words)).groupBy("bucket", "word").agg(F.bit_or("mask").alias("bits"))


def knows(bits: Column, mask: Column) -> Column:
    return bits.bitwiseAND(mask) == mask


def screen(stored: DataFrame, words: Column) -> DataFrame:
    """``stored`` (with ``bucket`` and ``key``, each pair once) with ``word`` and ``possible``: whether the filters of the other
    buckets know the key, that is, whether it can be there."""
    placed = stored.withColumn("at", F.coalesce(F.col("bucket").cast("bigint"), F.lit(NO_BUCKET))).select("*", *word_and_mask(F.col("key"), words))
    by = W.partitionBy("word").orderBy("at")
    none = F.lit(0).cast("bigint")
    before = F.coalesce(F.bit_or("mask").over(by.rangeBetween(W.unboundedPreceding, -1)), none)
    after = F.coalesce(F.bit_or("mask").over(by.rangeBetween(1, W.unboundedFollowing)), none)
    return placed.withColumn("others", before.bitwiseOR(after)).withColumn("possible", knows(F.col("others"), F.col("mask"))).drop("at", "mask", "others")


def deduplicate(
    rows: DataFrame, identifier: str, bucket: Column, rank: Sequence[Column], keep: Sequence[str], *, same: Callable[[Column], Column] = key
) -> DataFrame:
    """The ``keep`` columns of one row for each identifier: the one with the greatest ``rank`` (columns in order, null least).

    Identifiers are compared by ``same`` (by default without regard to case), which gives a value for every value. Rows
    equal in rank and in what is kept are one. A null identifies nothing: its rows are all kept. ``bucket`` is an int; a null
    one is a bucket. Other columns don't enter. An empty table gives an empty one."""
    names = [f"x{i}" for i in range(len(keep))]
    kept = F.struct(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)]).alias("kept")
    known = rows.where(F.col(identifier).isNotNull()).select(
        bucket.cast("int").alias("bucket"),
        same(F.col(identifier)).alias("key"),
        F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)]).alias("rank"),
        kept,
    )
    stored = known.groupBy("bucket", "key").agg(F.max(F.struct("rank", "kept")).alias("w"))
    # both branches below need all of ``w`` and ``key``, so that the rows are shuffled by word once for the two
    probed = screen(stored, word_count(rows)).where(F.col("w").isNotNull() & F.col("key").isNotNull())
    new = probed.where(~F.col("possible")).select("w.kept")
    verified = probed.where("possible").groupBy("word", "key").agg(F.max("w").alias("w")).select("w.kept")
    unnamed = rows.where(F.col(identifier).isNull()).select(kept)
    return new.unionAll(verified).unionAll(unnamed).select(*[F.col(f"kept.{n}").alias(c) for n, c in zip(names, keep, strict=True)])
