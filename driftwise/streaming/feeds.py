"""The change feed as a stream: documents seen first, versions exactly once, and appends to an equality-delete table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftwise.functions.vectors import blank, key, normalize
from driftwise.operators.change_feed import EqualityDeleteTable
from driftwise.operators.replicas import version_hash
from driftwise.sources.pages import is_live_document
from driftwise.streaming.deliveries import DeliveryStore


def read_feed(spark: SparkSession, path: str, schema, files_a_batch: int = 1) -> DataFrame:
    """Parquet files of feed items as a stream; the checkpoint of the query is the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def live_versions(items: DataFrame, at: str | None = None, late: str = "7 days") -> DataFrame:
    """Live documents, each version once: by node, document and a digest of the normalised vector.

    With an event-time column ``at`` the state keeps versions for ``late`` and no longer; without one it keeps all of them,
    as exact deduplication over a feed's whole life must."""
    usable = items.where(is_live_document(F.col("item_type"), F.col("flags")) & ~blank(F.col("id")))
    keyed = usable.withColumn("document_key", key(F.col("id"))).withColumn(
        "version", version_hash(F.col("document_key"), normalize(F.col("change_vector")))
    )
    names = ["node_url", "document_key", "version"]
    return keyed.dropDuplicates(names) if at is None else keyed.withWatermark(at, late).dropDuplicatesWithinWatermark(names)


def append_feed(
    items: DataFrame, target: EqualityDeleteTable, entries: Callable[[DataFrame], DataFrame], checkpoint: str
) -> StreamingQuery:
    """Starts a query that appends the ``entries`` of each batch of the stream to ``target`` and ends when the input is read. A
    batch that is run again after a failure replaces itself, so each takes effect once."""

    def write(batch: DataFrame, number: int) -> None:
        target.append(f"{number:08d}", entries(batch))

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_a_run(run: Column, document: Column) -> Column:
    """The identifier by which a document counts once in a run; null, which is never suppressed, for a blank document."""
    return F.when(~blank(document), F.concat(F.hex(F.coalesce(run, F.lit(""))), F.lit("/"), key(document)))


def keep_first(items: DataFrame, store: DeliveryStore, checkpoint: str) -> StreamingQuery:
    """Starts a query that stores the rows of a stream whose identifiers ``store`` doesn't have, and ends when the input is
    read. With :func:`once_a_run` as identifier and the etag as order, a document that is seen again in a run is suppressed,
    be it at a later etag, and its first verdict kept. A batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        store.accept(f"{number:08d}", batch)

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes a stream's rows to parquet until the input is read."""
    query = stream.writeStream.format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint
    ).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
