"""The queries p1 to p5 over the project's tables, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwise import fixed
from driftwise.functions.vectors import blank, key, normalize, parse_long, strip
from driftwise.operators.change_feed import EqualityDeleteTable
from driftwise.operators.copy_diff import diff_copies
from driftwise.operators.delivery_dedup import deduplicate
from driftwise.operators.eager_aggregate import aggregate_join, heavy_groups
from driftwise.operators.snapshot_changes import snapshot_changes, validity_intervals
from driftwise.plans.sqltext import cv_norm, present
from driftwise.session import cut, scratch
from driftwise.sources.tables import table
from driftwise.streaming.deliveries import DeliveryStore

#: A repair group is heavy if it holds one in so many rows.
HEAVY_ONE_IN = 20
#: Hours of a time bucket of deliveries.
BUCKET_HOURS = 12
#: Delivery rounds that a store accepts as one batch.
ROUNDS_A_BATCH = 8


# 1. A few keys holding most records


def _grouped_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "mismatches")
    return rows.where(~blank(F.col("collection")) & ~blank(F.col("winner_node")))


def repair_groups(spark: SparkSession, folder: str) -> DataFrame:
    rows, replicas = _grouped_mismatches(spark, folder), table(spark, folder, "node_document_snapshots")
    return aggregate_join(
        rows, replicas, key(F.col("document_id")), key(F.col("original_document_id")), {c: F.col(c) for c in ("collection", "winner_node")}
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    # one row a group, read twice: for the total and for the share of it
    groups = cut(repair_groups(spark, folder))
    return heavy_groups(groups, groups.agg(F.sum("n_rows")), HEAVY_ONE_IN).select("collection", "winner_node")


def p1_repair_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every group with its rows, its distinct documents, and the replica rows that its mismatches stand for."""
    groups = repair_groups(spark, folder)
    return groups.select(
        "collection", "winner_node", "n_rows", F.col("n_keys").alias("n_documents"), F.col("n_matched").alias("n_replica_rows")
    )


P1_GROUPS_SQL = f"""
WITH m AS (SELECT * FROM mismatches WHERE {present("collection")} AND {present("winner_node")}),
r AS (SELECT upper(original_document_id) AS k, count(*) AS n FROM node_document_snapshots GROUP BY 1)
SELECT m.collection, m.winner_node, count(*) AS n_rows, count(DISTINCT upper(m.document_id)) AS n_documents,
  CAST(sum(coalesce(r.n, 0)) AS BIGINT) AS n_replica_rows
FROM m LEFT JOIN r ON upper(m.document_id) = r.k GROUP BY 1, 2"""
P1_FOUND_SQL = f"""
WITH m AS (SELECT collection, winner_node FROM mismatches WHERE {present("collection")} AND {present("winner_node")})
SELECT collection, winner_node FROM m GROUP BY 1, 2 HAVING count(*) * {HEAVY_ONE_IN} >= (SELECT count(*) FROM m)"""


# 4. Messages delivered more than once (before 2, which compares what it keeps)


def time_bucket(at: Column) -> Column:
    return F.datediff(F.to_date(at), F.lit("1970-01-01")) * (24 // BUCKET_HOURS) + F.floor(F.hour(at) / BUCKET_HOURS).cast("int")


def kept_deliveries(rows: DataFrame) -> DataFrame:
    """``delivery_id`` of the latest row of each physical id; of equally late ones of the first that was delivered."""
    rank = [F.col("last_modified"), -F.col("delivery_id")]
    return deduplicate(rows, "id", time_bucket(F.col("received_at")), rank, ["delivery_id"])


def kept_snapshots(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted``, a part of ``rows``, that are kept. Deduplication moves ids and times only; the other columns are
    moved once, by the unique delivery_id, of the rows that are wanted."""
    return wanted.join(kept_deliveries(rows), "delivery_id", "left_semi")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "node_document_snapshots")
    return rows.select("delivery_id").join(kept_deliveries(rows), "delivery_id", "left_anti")


def p4_deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "node_document_snapshots")
    return kept_snapshots(rows, rows).select(
        "delivery_id", "batch_no", "id", "original_document_id", "from_node", "change_vector", "collection", "last_modified"
    )


def p4_first_accepted(spark: SparkSession, folder: str) -> DataFrame:
    """``delivery_id`` of what a store accepts that gets the rounds as they arrive: the first copy of each id. Every batch is
    screened by the filters of the buckets stored before, and possible repeats are looked up in the bucket folders that these
    name."""
    rows = table(spark, folder, "node_document_snapshots").select("delivery_id", "batch_no", "id", "received_at")
    store = DeliveryStore(
        spark, scratch(spark, "deliveries"), rows.schema, "id", lambda: time_bucket(F.col("received_at")), ["delivery_id"]
    )
    batch = F.floor(F.col("batch_no") / ROUNDS_A_BATCH)
    # a fixed number, whatever the number of rows; rows without a round come first
    for r in rows.select(batch.alias("b")).distinct().orderBy("b").collect():
        of = F.col("batch_no").isNull() if r["b"] is None else F.col("batch_no").between(r["b"] * ROUNDS_A_BATCH, (r["b"] + 1) * ROUNDS_A_BATCH - 1)
        store.accept("none" if r["b"] is None else f"{r['b']:08d}", rows.where(of))
    return store.rows().select("delivery_id")


P4_RANKED = "SELECT *, row_number() OVER (PARTITION BY upper(id) ORDER BY last_modified DESC NULLS LAST, delivery_id) AS rn FROM node_document_snapshots"
P4_FOUND_SQL = f"SELECT delivery_id FROM ({P4_RANKED}) WHERE rn > 1"
P4_FIRST_SQL = f"""SELECT delivery_id FROM (SELECT *, row_number() OVER (PARTITION BY upper(id) ORDER BY batch_no // {ROUNDS_A_BATCH} NULLS FIRST, delivery_id) AS rn
  FROM node_document_snapshots) WHERE rn = 1 OR id IS NULL"""
P4_KEPT_SQL = f"SELECT delivery_id, batch_no, id, original_document_id, from_node, change_vector, collection, last_modified FROM ({P4_RANKED}) WHERE rn = 1"


# 2. Differences between two copies of data

P2_FIELDS = ("change_vector", "collection", "last_modified")


def compared(rows: DataFrame) -> DataFrame:
    """Rows of nodes A (left) and B (right) compared by document key; see :func:`diff_copies`."""
    held = rows.select(
        key(F.col("original_document_id")).alias("document_key"),
        "from_node",
        normalize(F.col("change_vector")).alias("change_vector"),
        F.when(~blank(F.col("collection")), key(F.col("collection"))).alias("collection"),
        "last_modified",
    )
    return diff_copies(held, "document_key", list(P2_FIELDS), F.col("from_node") == "A")


def replica_differences(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "node_document_snapshots")
    return compared(kept_snapshots(rows, rows.where(F.col("from_node").isin("A", "B"))))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    diff = replica_differences(spark, folder)
    # a surplus row of a document that the other node has too is no missing document
    missing = F.when(
        (F.col("side") == "left") & (F.col("n_right") == 0), F.array(F.lit("missing_on_b"))
    ).when((F.col("side") == "right") & (F.col("n_left") == 0), F.array(F.lit("missing_on_a")))
    return diff.select("document_key", F.explode(F.coalesce(missing, "differing")).alias("difference")).distinct()


def p2_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Each leftover row or pair of nodes A and B with the values on either side, field by field."""
    diff = replica_differences(spark, folder)
    values = [
        F.col(side)[c].alias(f"{c}_{node}") for c in (
            "change_vector", "collection", "last_modified"
        ) for side, node in (("l", "a"), ("r", "b"))
    ]
    return diff.select("document_key", "side", F.array_join("differing", ",").alias("differing"), "pairing", *values)


def p2_copies(spark: SparkSession, folder: str) -> DataFrame:
    """All rows that nodes A and B delivered, repeated ones too, as copies of the same keys: how many rows of each document pair
    up though they differ, in how many fields in all, and how many have no partner."""
    rows = table(spark, folder, "node_document_snapshots").where(F.col("from_node").isin("A", "B"))
    return compared(rows).groupBy("document_key").agg(
        F.count_if(F.col("side") == "both").alias("n_pairs"), F.count_if(F.col("side") == "left").alias("n_left"), F.count_if(F.col("side") == "right").alias("n_right"),
        F.coalesce(F.sum(F.size("differing")), F.lit(0)).alias("n_differing"),
    )


# by brute force for keys with up to three rows on one side; by counting where no row shares more than one value with the other
# side, but for what all rows of the key have
P2_COPIES_SQL = f"""
WITH rows AS (SELECT from_node = 'A' AS is_a, upper(original_document_id) AS k, {cv_norm("change_vector")} AS v, CASE WHEN {present("collection")} THEN upper(collection) END AS c, last_modified AS t
  FROM node_document_snapshots WHERE from_node IN ('A', 'B')),
cells AS (SELECT k, v, c, t, sum(CASE WHEN is_a THEN 1 ELSE -1 END) AS net FROM rows GROUP BY ALL HAVING net <> 0),
n AS (SELECT k, coalesce(sum(net) FILTER (net > 0), 0) AS l, -coalesce(sum(net) FILTER (net < 0), 0) AS r,
  CAST(count(DISTINCT v) + CAST(count(v) < count(*) AS INT) = 1 AS INT) AS cv, CAST(count(DISTINCT c) + CAST(count(c) < count(*) AS INT) = 1 AS INT) AS cc, CAST(count(DISTINCT t) + CAST(count(t) < count(*) AS INT) = 1 AS INT) AS ct FROM cells GROUP BY 1),
long AS (SELECT k, i, net, unnest([CASE WHEN cv = 0 THEN {{'f': 'v', 'x': v}} END, CASE WHEN cc = 0 THEN {{'f': 'c', 'x': c}} END, CASE WHEN ct = 0 THEN {{'f': 't', 'x': CAST(t AS VARCHAR)}} END]) AS s
  FROM (SELECT *, row_number() OVER () AS i FROM cells) JOIN n USING (k)),
shared AS (SELECT k, s, sum(net) FILTER (net > 0) AS a, -sum(net) FILTER (net < 0) AS b FROM long WHERE s IS NOT NULL GROUP BY 1, 2 HAVING min(sign(net)) < max(sign(net))),
agreed AS (SELECT k, sum(least(a, b)) AS agree FROM shared GROUP BY 1),
woven AS (SELECT DISTINCT l.k FROM long l JOIN shared s ON l.k = s.k AND l.s = s.s GROUP BY l.k, l.i HAVING count(*) > 1),
u AS (SELECT k, v, c, t, (net > 0) = (l <= r) AS few, row_number() OVER (PARTITION BY k, net > 0 ORDER BY v, c, t) AS i FROM (SELECT *, unnest(range(CAST(abs(net) AS BIGINT))) AS copy FROM cells JOIN n USING (k) WHERE least(l, r) BETWEEN 1 AND 3)),
w AS (SELECT a.k, a.i, b.i AS j, CAST(a.v IS DISTINCT FROM b.v AS INT) + CAST(a.c IS DISTINCT FROM b.c AS INT) + CAST(a.t IS DISTINCT FROM b.t AS INT) AS cost FROM u a JOIN u b ON a.k IS NOT DISTINCT FROM b.k AND a.few AND NOT b.few),
best AS (SELECT a.k, min(a.cost + coalesce(b.cost, 0) + coalesce(c.cost, 0)) AS cost FROM w a JOIN n ON n.k IS NOT DISTINCT FROM a.k LEFT JOIN w b ON b.k IS NOT DISTINCT FROM a.k AND b.i = 2 AND b.j <> a.j
  LEFT JOIN w c ON c.k IS NOT DISTINCT FROM a.k AND c.i = 3 AND c.j <> a.j AND c.j <> b.j WHERE a.i = 1 AND (b.i IS NOT NULL OR least(l, r) < 2) AND (c.i IS NOT NULL OR least(l, r) < 3) GROUP BY 1)
SELECT n.k AS document_key, CAST(least(l, r) AS BIGINT) AS n_pairs, CAST(l - least(l, r) AS BIGINT) AS n_left, CAST(r - least(l, r) AS BIGINT) AS n_right,
  CAST(CASE WHEN least(l, r) = 0 THEN 0 WHEN best.cost IS NOT NULL THEN best.cost WHEN n.k NOT IN (SELECT k FROM woven) THEN least(l, r) * (3 - cv - cc - ct) - coalesce(agree, 0) END AS BIGINT) AS n_differing
FROM n LEFT JOIN best ON best.k IS NOT DISTINCT FROM n.k LEFT JOIN agreed ON agreed.k = n.k"""
P2_COPIES = f"""
WITH kept AS (SELECT * FROM ({P4_RANKED}) WHERE rn = 1 AND from_node IN ('A', 'B')),
held AS (SELECT from_node, upper(original_document_id) AS document_key, {cv_norm("change_vector")} AS change_vector,
  CASE WHEN {present("collection")} THEN upper(collection) END AS collection, last_modified FROM kept),
a AS (SELECT * FROM held WHERE from_node = 'A'), b AS (SELECT * FROM held WHERE from_node = 'B'),
ab AS (SELECT coalesce(a.document_key, b.document_key) AS document_key, a.from_node IS NOT NULL AS on_a, b.from_node IS NOT NULL AS on_b,
  a.change_vector AS change_vector_a, b.change_vector AS change_vector_b, a.collection AS collection_a, b.collection AS collection_b,
  a.last_modified AS last_modified_a, b.last_modified AS last_modified_b FROM a FULL JOIN b ON a.document_key = b.document_key)"""
P2_FOUND_SQL = (
    P2_COPIES
    + " SELECT document_key, 'missing_on_a' AS difference FROM ab WHERE NOT on_a UNION SELECT document_key, 'missing_on_b' FROM ab WHERE NOT on_b"
    + "".join(f" UNION SELECT document_key, '{f}' FROM ab WHERE on_a AND on_b AND {f}_a IS DISTINCT FROM {f}_b" for f in P2_FIELDS)
)
P2_DIFFERENCES_SQL = (
    P2_COPIES
    + " SELECT document_key, CASE WHEN on_a AND on_b THEN 'both' WHEN on_a THEN 'left' ELSE 'right' END AS side, CASE WHEN on_a AND on_b THEN concat_ws(',', "
    + ", ".join(f"CASE WHEN {f}_a IS DISTINCT FROM {f}_b THEN '{f}' END" for f in P2_FIELDS)
    + ") END AS differing, 'exact' AS pairing, "
    + ", ".join(f"{f}_{n}" for f in P2_FIELDS for n in "ab")
    + " FROM ab WHERE NOT (on_a AND on_b) OR "
    + " OR ".join(f"{f}_a IS DISTINCT FROM {f}_b" for f in P2_FIELDS)
)


# 3. Applying a stream of inserts, updates, deletes


def feed_effect(item_type: Column, flags: Column) -> Column:
    """What an item does to its document: put, delete, or nothing (null)."""
    kind = key(strip(item_type))
    has = lambda flag: F.coalesce(F.exists(F.split(flags, ","), lambda f: key(strip(f)) == flag), F.lit(False))
    document = kind == fixed.DOCUMENT
    return F.when(document & ~has(fixed.CONFLICTED) & ~has(fixed.DELETE_REVISION), "put").when(
        (document & ~has(fixed.CONFLICTED)) | (kind == fixed.TOMBSTONE), "delete"
    )


def feed_entries(items: DataFrame) -> DataFrame:
    """The puts and deletes of a page feed, for an equality-delete table: ``kind``, node_url, document_key and etag. Items
    without id, vector, type or readable etag have no effect, nor have items of other types."""
    usable = items.where(~blank(F.col("id")) & ~blank(F.col("change_vector")) & ~blank(F.col("item_type")))
    entries = usable.select(
        feed_effect(F.col("item_type"), F.col("flags")).alias("kind"),
        "node_url",
        key(F.col("id")).alias("document_key"),
        parse_long(F.col("etag")).alias("etag"),
    )
    return entries.where(F.col("kind").isNotNull() & F.col("etag").isNotNull())


def feed_table(spark: SparkSession, path: str) -> EqualityDeleteTable:
    return EqualityDeleteTable(spark, path, "node_url string, document_key string", "etag")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    state = feed_table(spark, scratch(spark, "feed"))
    state.append("all", feed_entries(table(spark, folder, "iteration_items")))
    return state.read()


P3_FOUND_SQL = rf"""
WITH i AS (SELECT node_url, upper(id) AS document_key, CASE WHEN regexp_full_match(etag, '\s*\+?[0-9]+\s*') THEN try_cast(trim(etag) AS BIGINT) END AS etag,
  upper(trim(item_type)) AS kind, list_transform(string_split(upper(coalesce(flags, '')), ','), lambda f: trim(f)) AS fl
  FROM iteration_items WHERE {present("id")} AND {present("change_vector")} AND {present("item_type")}),
e AS (SELECT *, CASE WHEN kind = 'TOMBSTONE' THEN 0 WHEN kind = 'DOCUMENT' AND NOT list_contains(fl, 'CONFLICTED')
  THEN CASE WHEN list_contains(fl, 'DELETEREVISION') THEN 0 ELSE 1 END END AS put FROM i WHERE etag IS NOT NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY node_url, document_key ORDER BY etag DESC, put DESC) AS rn FROM e WHERE put IS NOT NULL)
SELECT node_url, document_key, etag FROM l WHERE rn = 1 AND put = 1"""


# 5. What changed between full snapshots


def _snapshot_terms() -> dict:
    return {
        "owner": F.col("from_node"), "snapshot": F.col("run_id"), "key": key(F.col("id")),
        "content": [normalize(F.col("cv")), F.col("lm")], "rank": [F.col("lm"), -F.col("row_id")],
    }


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    changes = snapshot_changes(table(spark, folder, "snapshot_cache_rows"), **_snapshot_terms())
    return changes.select(
        F.col("snapshot").alias("run_id"), F.col("owner").alias("from_node"), F.col("key").alias("document_key"), "change"
    )


def p5_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """The intervals of snapshots, by position among the node's, in which a document was held unchanged."""
    spans = validity_intervals(table(spark, folder, "snapshot_cache_rows"), **_snapshot_terms())
    return spans.select(
        F.col("owner").alias("from_node"),
        F.col("key").alias("document_key"),
        F.col("first").alias("first_snapshot"),
        F.col("last").alias("last_snapshot"),
    )


P5_ROWS = f"""
WITH runs_of AS (SELECT from_node, run_id, row_number() OVER (PARTITION BY from_node ORDER BY run_id) AS i FROM (SELECT DISTINCT from_node, run_id FROM snapshot_cache_rows)),
one AS (SELECT * FROM (SELECT *, upper(id) AS document_key, row_number() OVER (PARTITION BY from_node, run_id, upper(id) ORDER BY lm DESC NULLS LAST, row_id) AS rn FROM snapshot_cache_rows) WHERE rn = 1),
s AS (SELECT o.from_node, o.document_key, r.i, {cv_norm("o.cv")} AS nv, o.lm FROM one o JOIN runs_of r ON o.from_node = r.from_node AND o.run_id = r.run_id)"""
P5_FOUND_SQL = (
    P5_ROWS
    + """, c AS (SELECT coalesce(n.from_node, p.from_node) AS from_node, coalesce(n.document_key, p.document_key) AS document_key, coalesce(n.i, p.i + 1) AS i,
  CASE WHEN p.i IS NULL THEN 'added' WHEN n.i IS NULL THEN 'removed' WHEN n.nv IS DISTINCT FROM p.nv OR n.lm IS DISTINCT FROM p.lm THEN 'changed' END AS change
  FROM s n FULL JOIN s p ON n.from_node = p.from_node AND n.document_key = p.document_key AND n.i = p.i + 1)
SELECT r.run_id, c.from_node, c.document_key, c.change FROM c JOIN runs_of r ON c.from_node = r.from_node AND c.i = r.i WHERE c.change IS NOT NULL AND c.i > 1"""
)
P5_INTERVALS_SQL = (
    P5_ROWS
    + """, m AS (SELECT *, i - row_number() OVER (PARTITION BY from_node, document_key, nv, lm ORDER BY i) AS island FROM s)
SELECT from_node, document_key, min(i) AS first_snapshot, max(i) AS last_snapshot FROM m GROUP BY from_node, document_key, nv, lm, island"""
)


QUERIES = {
    "p1_found": p1_found, "p1_repair_groups": p1_repair_groups, "p2_found": p2_found, "p2_differences": p2_differences, "p2_copies": p2_copies, "p3_found": p3_found,
    "p4_found": p4_found, "p4_deduplicated": p4_deduplicated, "p4_first_accepted": p4_first_accepted, "p5_found": p5_found, "p5_intervals": p5_intervals,
}
SQL = {
    "p1_found": P1_FOUND_SQL, "p1_repair_groups": P1_GROUPS_SQL, "p2_found": P2_FOUND_SQL, "p2_differences": P2_DIFFERENCES_SQL, "p2_copies": P2_COPIES_SQL, "p3_found": P3_FOUND_SQL,
    "p4_found": P4_FOUND_SQL, "p4_deduplicated": P4_KEPT_SQL, "p4_first_accepted": P4_FIRST_SQL, "p5_found": P5_FOUND_SQL, "p5_intervals": P5_INTERVALS_SQL,
}
