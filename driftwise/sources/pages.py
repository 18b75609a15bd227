"""Pages of a change feed as JSON, and the cache of snapshot rows as compressed JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwise import fixed
from driftwise.functions.scalars import parse_iso
from driftwise.functions.vectors import blank, key, parse_long, strip

ITEM = "Id string, Etag string, Type string, Flags string, ChangeVector string, Collection string, LastModified string"
CACHE_ROW = "id string, cv string, c string, lm string"


def parse_pages(pages: DataFrame, body: Column) -> DataFrame:
    """The items of JSON pages ``{"Results": [...]}``, next to the page's columns: ``position``, ``id``, ``etag`` (bigint),
    ``item_type``, ``flags``, ``change_vector``, ``collection``, ``last_modified``.

    Missing properties are null; an etag may be a number or text. Items without id or readable etag are left out; a page that
    is no JSON has no items."""
    parsed = pages.select(
        "*",
        F.posexplode(
            F.from_json(body, f"Results array<struct<{', '.join(x.replace(' ', ':') for x in ITEM.split(', '))}>>").Results
        ).alias("position", "x"),
    )
    items = parsed.select(
        *pages.columns, "position", F.col("x.Id").alias("id"), parse_long(F.col("x.Etag")).alias("etag"), F.col("x.Type").alias("item_type"), F.col("x.Flags").alias("flags"),
        F.col("x.ChangeVector").alias("change_vector"), F.col("x.Collection").alias("collection"), F.col("x.LastModified").alias("last_modified"),
    )
    return items.where(~blank(F.col("id")) & F.col("etag").isNotNull())


def is_live_document(item_type: Column, flags: Column) -> Column:
    """Whether an item is a document that is neither conflicted nor a deleted revision. Never null."""
    barred = F.exists(F.split(flags, ","), lambda f: key(strip(f)).isin(fixed.CONFLICTED, fixed.DELETE_REVISION))
    return F.coalesce(key(strip(item_type)) == fixed.DOCUMENT, F.lit(False)) & ~F.coalesce(barred, F.lit(False))


def first_seen(items: DataFrame) -> DataFrame:
    """Of the items of one document and page the one with the least etag, then the first that arrived."""
    order = F.struct("etag", "feed_seq")
    return items.groupBy(
        "node_url", "page_no", key(F.col("id")).alias("document_key")
    ).agg(F.min(order).alias("w")).select("node_url", "page_no", "document_key", "w.etag", "w.feed_seq")


def read_cache(spark: SparkSession, path: str, after: str | None = None) -> DataFrame:
    """Rows of a segment cache, with the segment they are of; ``lm`` as a UTC timestamp. ``after``: the last segment that was read
    whole, as a reader that goes on where it stopped knows it; the files of it and of those before aren't opened."""
    rows = spark.read.schema(CACHE_ROW).json(path).withColumn("lm", parse_iso(F.col("lm"))).withColumn("segment", F.col("_metadata.file_name"))
    return rows if after is None else rows.where(F.col("segment") > after)


def keyset_page(rows: DataFrame, after: str | None, size: int) -> DataFrame:
    """The next page by id; the limit is the feature."""
    return (rows if after is None else rows.where(F.col("id") > after)).orderBy("id").limit(size)


def etag_page(items: DataFrame, start: int, size: int) -> DataFrame:
    """The next items of a feed from an etag on; the limit is the feature."""
    return items.where(F.col("etag") >= start).orderBy("etag", "feed_seq").limit(size)


def with_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose id begins with a prefix, which is pushed to the scan."""
    return rows.where(F.col(column).startswith(prefix))
