"""Messages accepted batch by batch, each identifier once.

The store keeps accepted rows in folders by time bucket, and Bloom filters of each bucket's identifiers. A batch is probed
against the filters: an identifier that no filter knows is new. The possible repeats are looked up exactly, and only in the
buckets whose filters named them; other buckets' files aren't read. Unlike :func:`driftwise.operators.delivery_dedup.deduplicate`,
which sees all deliveries and can keep the latest, a store keeps the first it got.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwise.functions.vectors import key
from driftwise.operators.delivery_dedup import WORD_IDS, filters, knows, word_and_mask
from driftwise.session import cut

FILTERS = "bucket int, word bigint, bits bigint, batch string"
#: Words that filters of a store have at least.
LEAST_WORDS = 2**12


class DeliveryStore:
    """``identifier``: the column that says what a message is; ``bucket``: a function of rows to an int column, their time
    bucket (null: -1); ``order``: columns, or expressions of them, by which the first of several copies within a batch is chosen.

    All filters have the same number of 64-bit words, at least one for each four identifiers of the whole store, so what a batch
    is probed against, the filters of all buckets together, lets less than 1 % of new identifiers through to exact lookups. A
    store that outgrows its words has its filters made anew with four times as many, or as many as it then needs, from the identifiers that are
    stored, so each is put into filters a bounded number of times on average, however long the store lives.

    Filters are written before rows. A failure in between leaves filters that know too much, which exact lookups put right,
    never rows that no filter knows."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        identifier: str,
        bucket: Callable[[], Column],
        order: Sequence[str | Column],
        least_words: int = LEAST_WORDS,
    ) -> None:
        self.spark, self.path, self.schema, self.identifier, self.bucket, self.order, self.least_words = spark, path, schema, identifier, bucket, list(order), least_words

    def _exists(self, what: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def _read(self, what: str, schema: T.StructType | str, batch: str | None) -> DataFrame:
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{what}") if self._exists(what) else self.spark.createDataFrame([], schema)
        return rows if batch is None else rows.where(F.col("batch") != batch)

    def _stored(self, batch: str | None) -> DataFrame:
        return self._read(
            "rows",
            T.StructType(
                [
                    *self.schema,
                    T.StructField("_key", T.StringType()),
                    T.StructField("batch", T.StringType()),
                    T.StructField("_bucket", T.IntegerType()),
                ]
            ),
            batch,
        )

    def rows(self) -> DataFrame:
        """All accepted rows."""
        return self._stored(None).drop("_key", "_bucket", "batch")

    def _words(self, identifiers: int) -> int:
        """The words of the filters that hold: those made last, or new ones if these are too few for so many identifiers."""
        sizes = [self.least_words * 4**i for i in range(20)]
        last = max((w for w in sizes if self._exists(f"filters-{w}/_made")), default=0)
        words = next(w for w in sizes if w * WORD_IDS >= identifiers)
        if last >= words:
            return last
        if self._exists("rows"):
            keys = self._stored(None).where(F.col("_key").isNotNull()).select(F.col("_bucket").alias("bucket"), F.col("_key").alias("key"))
            filters(keys, F.lit(words).cast("bigint")).write.mode("overwrite").parquet(f"{self.path}/filters-{words}/batch=_before")
        # an empty table is the mark that the filters are whole
        self.spark.createDataFrame([], "x int").write.mode("overwrite").parquet(f"{self.path}/filters-{words}/_made")
        return words

    def accept(self, batch: str, rows: DataFrame) -> None:
        """Stores the rows of ``batch`` whose identifiers are new. A batch of the same name is replaced, as after a failure.
        Rows without identifier are stored as they are."""
        names = self.schema.fieldNames()
        made = rows.select(
            *names, key(F.col(self.identifier)).alias("_key"), F.coalesce(self.bucket().cast("int"), F.lit(-1)).alias("_bucket")
        )
        first = made.where(F.col("_key").isNotNull()).groupBy("_key").agg(
            F.min(F.struct(*self.order, F.struct(*names, "_bucket").alias("row"))).alias("w")
        ).select("_key", "w.row.*")
        first = cut(first)
        size = self._words(self._stored(batch).count() + first.count())
        words, path = F.lit(size).cast("bigint"), f"filters-{size}"
        known = self._read(path, FILTERS, batch).groupBy(
            F.col("bucket").alias("other"), F.col("word").alias("at")
        ).agg(F.bit_or("bits").alias("bits"))
        probed = first.select("_key", *word_and_mask(F.col("_key"), words)).join(
            known, (F.col("word") == F.col("at")) & knows(F.col("bits"), F.col("mask"))
        )
        possible = cut(probed.select("_key", F.col("other").alias("_bucket")))
        named = [r[0] for r in possible.select("_bucket").distinct().collect()]  # as many as there are time buckets, at most
        stored = self._stored(batch).where(F.col("_bucket").isin(named)).select("_key", "_bucket")
        repeats = possible.join(stored, ["_key", "_bucket"], "left_semi").select("_key").distinct()
        new = cut(first.join(repeats, "_key", "left_anti").unionByName(made.where(F.col("_key").isNull())))
        keys = new.where(F.col("_key").isNotNull()).select(F.col("_bucket").alias("bucket"), F.col("_key").alias("key"))
        filters(keys, words).write.mode("overwrite").parquet(f"{self.path}/{path}/batch={batch}")
        new.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/rows/batch={batch}")
