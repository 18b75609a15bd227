"""Written results: segment caches, CSV parts, manifests, quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.functions.scalars import iso_text
from driftwise.operators.replicas import has_unsafe_characters, unsafe_reason


def write_cache(rows: DataFrame, path: str, rows_a_segment: int = 8192) -> None:
    """Rows ``id, cv, c, lm`` as gzip segments of JSON lines, each of at most so many rows."""
    rows.select(
        "id", "cv", "c", iso_text(F.col("lm")).alias("lm")
    ).write.mode("overwrite").option("maxRecordsPerFile", rows_a_segment).json(path, compression="gzip")


def manifest(cache: DataFrame) -> DataFrame:
    """Each segment of a cache with its rows, its first and last id, and a digest of its rows that doesn't depend on their
    order."""
    return cache.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
        F.bit_xor(F.xxhash64("id", "cv", "c", "lm")).alias("digest"),
    )


def write_csv(rows: DataFrame, path: str, rows_a_file: int = 1_000_000) -> None:
    """CSV with header and RFC 4180 quoting, a new file after so many rows."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).csv(path, header=True, quote='"', escape='"', lineSep="\n")


def quarantine(rows: DataFrame, document_id: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose id is safe to store as it is, and the others with the ``reason``. Null ids are unsafe."""
    unsafe = F.col(document_id).isNull() | has_unsafe_characters(F.col(document_id))
    return rows.where(~unsafe), rows.where(unsafe).withColumn("reason", F.coalesce(unsafe_reason(F.col(document_id)), F.lit("Missing")))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with the rows of ``changes`` in place of those with the same keys; write it elsewhere, or by partition.
    ``changes`` has each key once. Null keys match null keys."""
    named = changes.select(*[F.col(k).alias(f"_u_{k}") for k in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_u_{k}"))
    return current.join(named, on, "left_anti").unionByName(changes)


def upsert_changed(current: DataFrame, changes: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The rows of ``changes`` that an upsert has to write, with ``outcome``, inserted or updated: those whose keys ``current``
    hasn't, and those that differ from its row in ``fields``. Nulls are equal to each other; either side has each key once."""
    held = current.select(*[F.col(k).alias(f"_u_{k}") for k in keys], F.struct(*fields).alias("_held"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_u_{k}"))
    joined = changes.join(held, on, "left").where(~F.struct(*fields).eqNullSafe(F.col("_held")))
    outcome = F.when(F.col("_held").isNull(), "inserted").otherwise("updated")
    return joined.withColumn("outcome", outcome).select(*changes.columns, "outcome")


def page_index(rows: DataFrame, page: list[str], order: str, fields: list[str]) -> DataFrame:
    """Each page of a cache with its rows, its first and last id, and the SHA-256 digest of its payload: rows by ``order``, in lines,
    fields between tabs, nulls as empty ones. ``page`` must bound the rows of a page, whose payload is made in one task."""
    line = F.concat_ws("\t", *[F.coalesce(F.col(f), F.lit("")) for f in fields])
    lines = F.transform(F.sort_array(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x.line)
    return rows.groupBy(*page).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.upper(F.sha2(F.array_join(lines, "\n"), 256)).alias("digest")
    )
