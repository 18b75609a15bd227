"""Current state of a table from a feed of puts and deletes.

The way of equality deletes: puts and deletes are appended to separate relations, each entry with the sequence number at
which it takes effect; nothing is rewritten. A reader takes the last put of each key and anti-joins it against the deletes
of the same key with a later sequence number. The order in which entries arrive doesn't matter, and repeats change nothing.

Skew: of a key that holds a third of the feed only the last put and the last delete count, which partial aggregation finds
on the map side; both sides of the anti-join have each key once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def current_state(puts: DataFrame, deletes: DataFrame, keys: Sequence[str], sequence: str, payload: Sequence[str] = ()) -> DataFrame:
    """The keys whose last put no delete follows: ``keys``, ``sequence`` (of the last put) and ``payload`` columns of it.

    A delete removes puts with a lesser sequence number; of a put and a delete with the same number the put counts. Of
    several puts with the greatest number the one with the least payload, as a struct, is taken. Rows without a sequence
    number have no effect. Null keys are keys, equal to each other. Empty inputs give what they should: no state, or no
    deletes."""
    order = F.col(sequence)
    last = puts.where(order.isNotNull()).groupBy(*keys)
    if payload:
        found = last.agg(F.min(F.struct((-order).alias("q"), F.struct(*payload).alias("p"))).alias("w"))
        live = found.select(*keys, (-F.col("w.q")).alias(sequence), *[F.col("w.p")[c].alias(c) for c in payload])
    else:
        live = last.agg(F.max(order).alias(sequence))
    gone = deletes.where(order.isNotNull()).groupBy(*[F.col(k).alias(f"_d_{k}") for k in keys]).agg(F.max(order).alias("_d"))
    on = F.lit(True)
    for k in keys:
        on = on & live[k].eqNullSafe(gone[f"_d_{k}"])
    return live.join(gone, on & (gone["_d"] > live[sequence]), "left_anti")


class EqualityDeleteTable:
    """A table in the shared folder to which puts and deletes are appended, and which :func:`current_state` reads.

    An append writes the files of a batch, puts and deletes apart; nothing that was written before is touched. Writing a
    batch of the same name again replaces it, so a repeated or restarted batch does no harm. ``compact`` writes the current
    state as one batch and keeps the last delete of each key, which late entries may still have to meet."""

    def __init__(self, spark: SparkSession, path: str, keys: str, sequence: str, payload: str = "") -> None:
        """``keys`` and ``payload``: columns with types, as in DDL; ``sequence``: a bigint column."""
        self.spark, self.path, self.sequence = spark, path, sequence
        columns = [x for x in (keys, f"{sequence} bigint", payload) if x]
        self.schema = T.StructType.fromDDL(", ".join(columns))
        self.keys = T.StructType.fromDDL(keys).fieldNames()
        self.payload = T.StructType.fromDDL(payload).fieldNames() if payload else []

    def append(self, batch: str, entries: DataFrame) -> None:
        """``entries``: the table's columns and ``kind``, put or delete. Other kinds are left out."""
        known = entries.where(F.col("kind").isin("put", "delete")).select("kind", *self.schema.fieldNames())
        known.write.mode("overwrite").partitionBy("kind").parquet(f"{self.path}/batch={batch}")

    def entries(self, kind: str) -> DataFrame:
        whole = T.StructType([*self.schema, T.StructField("batch", T.StringType()), T.StructField("kind", T.StringType())])
        return self.spark.read.schema(whole).parquet(self.path).where(F.col("kind") == kind).drop("batch", "kind")

    def read(self) -> DataFrame:
        return current_state(self.entries("put"), self.entries("delete"), self.keys, self.sequence, self.payload)

    def compact(self, path: str) -> EqualityDeleteTable:
        """The table with the same state and fewer rows, at another path."""
        table = EqualityDeleteTable.__new__(EqualityDeleteTable)
        table.__dict__.update(self.__dict__ | {"path": path})
        last = self.entries("delete").groupBy(*self.keys).agg(F.max(self.sequence).alias(self.sequence)).withColumn("kind", F.lit("delete"))
        table.append("compacted", self.read().withColumn("kind", F.lit("put")).unionByName(last, allowMissingColumns=True))
        return table
