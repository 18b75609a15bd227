"""Queries on scans, pages, caches and streams, with their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwise import fixed
from driftwise.functions import scalars
from driftwise.functions.vectors import blank, key, parse_long, strip
from driftwise.operators import planning, replicas
from driftwise.plans import audit, problems
from driftwise.plans.audit import ALIGNED, ETAG, FLAGS, LIVE
from driftwise.plans.sqltext import present
from driftwise.session import scratch
from driftwise.sinks.files import page_index, quarantine, write_cache
from driftwise.sources import pages
from driftwise.sources.tables import table
from driftwise.streaming.feeds import append_feed, read_feed

QUERIES: dict = {}
SQL: dict[str, str] = {}
PAGE = 128


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# pages


@query(f"""WITH i AS (SELECT node_url, feed_seq, id, {ETAG} AS etag FROM iteration_items), a AS (SELECT * FROM i WHERE node_url = (SELECT min(node_url) FROM i) AND etag IS NOT NULL)
SELECT feed_seq, id, etag FROM a WHERE etag >= (SELECT (CAST(min(etag) AS HUGEINT) + max(etag)) // 2 FROM a) ORDER BY etag, feed_seq LIMIT {PAGE}""")
def etag_range_page(spark, folder):
    """A page of the first node's feed from the middle of its etags on; the limit is the feature."""
    items = table(spark, folder, "iteration_items").withColumn("etag", parse_long(F.col("etag")))
    of_node = items.where((F.col("node_url") == items.agg(F.min("node_url").alias("u")).scalar()) & F.col("etag").isNotNull())
    middle = of_node.agg(F.min("etag").alias("a"), F.max("etag").alias("b")).select(((F.col("a").cast("decimal(20)") + F.col("b")) / 2).cast("bigint").alias("m"))
    return pages.etag_page(of_node.where(F.col("etag") >= middle.scalar()), 0, PAGE).select("feed_seq", "id", "etag")


@query(f"SELECT DISTINCT id FROM node_document_snapshots WHERE id > 'M' ORDER BY id LIMIT {PAGE}")
def keyset_page(spark, folder):
    """A page of physical ids after a given one; the limit is the feature."""
    return pages.keyset_page(table(spark, folder, "node_document_snapshots").select("id").distinct(), "M", PAGE)


@query("SELECT delivery_id, original_document_id FROM node_document_snapshots WHERE starts_with(original_document_id, 'parcels/')")
def prefix_scan(spark, folder):
    rows = table(spark, folder, "node_document_snapshots").select("delivery_id", "original_document_id")
    return pages.with_prefix(rows, "original_document_id", "parcels/")


@query(f"SELECT node_url, page_no, id, {ETAG} AS etag, item_type, flags, change_vector, collection, last_modified FROM iteration_items WHERE {present('id')} AND {ETAG} IS NOT NULL")
def parsed_json_pages(spark, folder):
    """The feeds as the JSON pages that nodes send, parsed again. A body has at most 1024 items, as many as a page may have."""
    names = {"Id": "id", "Etag": "etag", "Type": "item_type", "Flags": "flags", "ChangeVector": "change_vector", "Collection": "collection", "LastModified": "last_modified"}
    item = F.struct(*[F.col(c).alias(n) for n, c in names.items()])
    sent = table(spark, folder, "iteration_items").groupBy("node_url", "page_no", F.floor(F.col("feed_seq") / 1024).alias("part")).agg(F.to_json(F.struct(F.collect_list(item).alias("Results"))).alias("body"))
    return pages.parse_pages(sent, F.col("body")).drop("body", "position", "part")


@query(f"""SELECT node_url, count(*) AS n_items, count(*) FILTER (kind AND NOT conflicted AND {present("id")} AND {present("change_vector")} AND e IS NOT NULL) AS n_kept, count(*) FILTER (NOT kind) AS n_other_types,
  count(*) FILTER (kind AND conflicted) AS n_conflicted FROM (SELECT *, {ETAG} AS e, coalesce(upper(trim(item_type)) = 'DOCUMENT', false) AS kind, list_contains({FLAGS}, 'CONFLICTED') AS conflicted FROM iteration_items) GROUP BY 1""")
def legacy_filter_counts(spark, folder):
    """What the older scan keeps and skips on each node: it needs a vector, and takes deleted revisions for documents."""
    items = table(spark, folder, "iteration_items")
    kind = F.coalesce(key(strip(F.col("item_type"))) == fixed.DOCUMENT, F.lit(False))
    conflicted = F.coalesce(F.exists(F.split("flags", ","), lambda f: key(strip(f)) == fixed.CONFLICTED), F.lit(False))
    usable = ~blank(F.col("id")) & ~blank(F.col("change_vector")) & parse_long(F.col("etag")).isNotNull()
    return items.groupBy("node_url").agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if(kind & ~conflicted & usable).alias("n_kept"), F.count_if(~kind).alias("n_other_types"), F.count_if(kind & conflicted).alias("n_conflicted")
    )


# lookups

WANTED = "wanted AS (SELECT DISTINCT upper(document_id) AS document_key FROM mismatches WHERE document_id IS NOT NULL UNION SELECT 'NO/SUCH/DOCUMENT')"


@query(ALIGNED + f", {WANTED} SELECT w.document_key, n.node, h.from_node IS NOT NULL AS present, h.c AS collection, h.cv AS change_vector FROM wanted w CROSS JOIN nodes n LEFT JOIN held h ON h.document_key = w.document_key AND h.from_node = n.node")
def point_lookup(spark, folder):
    """The documents of all mismatches, and one that nobody has, on every node: absent ones have a row too."""
    wanted = table(spark, folder, "mismatches").select(key(F.col("document_id")).alias("document_key")).where("document_key is not null")
    ids = wanted.unionByName(spark.createDataFrame([("NO/SUCH/DOCUMENT",)], "document_key string")).distinct()
    return replicas.looked_up(ids, audit._aligned(spark, folder), audit._nodes(spark, folder)).select("document_key", "node", "present", "collection", "change_vector")


@query("""WITH last AS (SELECT * FROM mismatches WHERE run_id = (SELECT max(run_id) FROM mismatches)), older AS (SELECT * FROM mismatches WHERE run_id < (SELECT max(run_id) FROM mismatches))
SELECT DISTINCT l.id, upper(l.document_id) AS document_key FROM last l WHERE l.id NOT IN (SELECT id FROM older WHERE id IS NOT NULL)
  AND NOT EXISTS (SELECT 1 FROM older o WHERE upper(o.document_id) = upper(l.document_id) AND o.mismatch_type = l.mismatch_type)""")
def new_mismatches(spark, folder):
    """Mismatches of the last run that no run before stored: neither under their id nor, by document and type, under another."""
    rows = table(spark, folder, "mismatches")
    newest = rows.agg(F.max("run_id").alias("r")).scalar()
    found = rows.where(F.col("run_id") == newest).select("id", key(F.col("document_id")).alias("document_key"), "mismatch_type")
    older = rows.where(F.col("run_id") < newest).select("id", key(F.col("document_id")).alias("document_key"), "mismatch_type")
    return planning.without_existing(found, older, "id", ["document_key", "mismatch_type"]).select("id", "document_key").distinct()


@query(r"""SELECT run_id, from_node, id AS document_id, concat_ws(',', CASE WHEN contains(id, '\') THEN 'ContainsBackslash' END, CASE WHEN regexp_matches(id, '[\x00-\x1f]') THEN 'ContainsControlCharacter' END) AS reason, count(*) AS n_rows
  FROM snapshot_cache_rows WHERE regexp_matches(id, '[\\\x00-\x1f]') GROUP BY ALL""")
def view_import_skipped(spark, folder):
    """Rows of snapshots that an import has to skip for their id, by run, node and document."""
    bad = quarantine(table(spark, folder, "snapshot_cache_rows").where(F.col("id").isNotNull()), "id")[1]
    return bad.groupBy("run_id", "from_node", F.col("id").alias("document_id"), "reason").agg(F.count(F.lit(1)).alias("n_rows"))


@query(r"""SELECT run_id, count(DISTINCT from_node) AS n_nodes, count(*) AS n_rows, count(*) FILTER (id IS NULL OR regexp_matches(id, '[\\\x00-\x1f]')) AS n_skipped, count(DISTINCT from_node) = (SELECT count(DISTINCT from_node) FROM snapshot_cache_rows) AS is_complete
  FROM snapshot_cache_rows GROUP BY 1""")
def import_aggregates(spark, folder):
    """What each run's snapshots give an import: nodes, rows, rows to skip, and whether all nodes are there."""
    rows = table(spark, folder, "snapshot_cache_rows")
    nodes = rows.agg(F.countDistinct("from_node").alias("n")).scalar()
    unsafe = F.col("id").isNull() | replicas.has_unsafe_characters(F.col("id"))
    return rows.groupBy("run_id").agg(
        F.countDistinct("from_node").alias("n_nodes"), F.count(F.lit(1)).alias("n_rows"), F.count_if(unsafe).alias("n_skipped")
    ).withColumn("is_complete", F.col("n_nodes") == nodes)


# caches


@query("""SELECT run_id, from_node, segment_id, page_number, row_id // 8192 AS part, count(*) AS n_rows, min(id) AS first_id, max(id) AS last_id,
  upper(sha256(string_agg(coalesce(id, '') || chr(9) || coalesce(cv, '') || chr(9) || coalesce(c, ''), chr(10) ORDER BY row_id))) AS digest FROM snapshot_cache_rows GROUP BY 1, 2, 3, 4, 5""")
def cache_page_index(spark, folder):
    """The pages of snapshot caches, in parts of at most 8192 rows, with a digest of what is in them, in order."""
    rows = table(spark, folder, "snapshot_cache_rows").withColumn("part", F.floor(F.col("row_id") / 8192))
    return page_index(rows, ["run_id", "from_node", "segment_id", "page_number", "part"], "row_id", ["id", "cv", "c"])


@query("SELECT id, cv, c, lm FROM snapshot_cache_rows")
def cache_round_trip(spark, folder):
    """All snapshot rows written as compressed segments and read again."""
    path = scratch(spark, "cache")
    write_cache(table(spark, folder, "snapshot_cache_rows"), path)
    return pages.read_cache(spark, path).select("id", "cv", "c", "lm")


# streams


@query(problems.P3_FOUND_SQL)
def stream_feed_state(spark, folder):
    """The documents that nodes hold at the end of their feeds, as p3_found gives them, the feed being read as a stream whose
    batches are appended to a table of puts and deletes."""
    whole = table(spark, folder, "iteration_items")
    state = problems.feed_table(spark, scratch(spark, "streamed-feed"))
    source = f"{folder}/iteration_items.parquet"
    items = read_feed(spark, f"{folder}/iteration_item[s].parquet" if os.path.isfile(source) else source, whole.schema)
    append_feed(items, state, problems.feed_entries, scratch(spark, "feed-cursor")).awaitTermination()
    return state.read()


# names


@query(r"""SELECT r.run_id, regexp_replace(r.run_id, '[<>:"/\\|?*\x00-\x1f]', '_', 'g') AS file_name, 'runs/' || strftime(started_at, '%Y%m%d-%H%M%S%f') || '0' AS id_by_start, format('{:,}', coalesce(repairs_planned, 0)) AS planned,
  rtrim(node_url || '//', '/') AS base_url, regexp_matches(node_url, '^https?://[^/\s?#]+') AS is_url, printf('segment-%06d', coalesce(source_node_index, 0)) AS segment
  FROM runs r LEFT JOIN node_config n ON n.node_idx = r.source_node_index""")
def run_names(spark, folder):
    """Runs as names of files, ids and addresses."""
    nodes = table(spark, folder, "node_config").select("node_idx", "node_url")
    runs = table(spark, folder, "runs").join(nodes, F.col("node_idx") == F.col("source_node_index"), "left")
    return runs.select(
        "run_id", scalars.file_name(F.col("run_id")).alias("file_name"), scalars.run_id(F.col("started_at")).alias("id_by_start"),
        scalars.thousands(F.coalesce("repairs_planned", F.lit(0))).alias("planned"), scalars.base_url(F.concat("node_url", F.lit("//"))).alias("base_url"),
        scalars.is_url(F.col("node_url")).alias("is_url"), scalars.numbered("segment-", F.coalesce("source_node_index", F.lit(0)), 6).alias("segment"),
    )
