"""Replicas of documents on several nodes: the latest row of each, aligned by document, evaluated, and indexed.

Alignment is one aggregation by document with one maximum for each configured node: a single shuffle of states that are
combined on the map side, whatever the number of rows of a document. A row of the result has one state for each node, in
node order, so everything after it is an expression over a short array and needs neither joins nor further shuffles.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwise import fixed
from driftwise.functions.vectors import blank, components, dominates, key, let, normalize, segments


@dataclass(frozen=True)
class Node:
    index: int
    alias: str
    label: str
    url: str


def nodes_of(config: DataFrame) -> list[Node]:
    """The configured nodes in node order; the alias of the n-th is the n-th letter. A configuration has a handful."""
    rows = config.select("node_idx", "node_label", "node_url").orderBy("node_idx").collect()
    return [Node(r["node_idx"], chr(65 + r["node_idx"]), r["node_label"], r["node_url"]) for r in rows]


def has_unsafe_characters(document_id: Column) -> Column:
    """A backslash or a control character."""
    return document_id.rlike(r"[\\\x00-\x1f]")


def unsafe_reason(document_id: Column) -> Column:
    """What makes an id unsafe, or 'None'; null for a null id."""
    reasons = F.concat_ws(
        ",",
        F.when(F.contains(document_id, F.lit("\\")), F.lit(fixed.BACKSLASH)),
        F.when(document_id.rlike(r"[\x00-\x1f]"), F.lit(fixed.CONTROL)),
    )
    return F.when(document_id.isNull(), F.lit(None)).when(reasons == "", fixed.SAFE).otherwise(reasons)


def physical_id(document_id: Column, alias: Column) -> Column:
    """The id of a document's row of a node: readable, or a digest where the document's id is unsafe."""
    digest = F.concat(F.lit(fixed.DIGEST_PREFIX), alias, F.lit("/"), F.upper(F.sha2(document_id, 256)))
    return F.when(has_unsafe_characters(document_id), digest).otherwise(F.concat(document_id, F.lit("/"), alias))


def version_hash(document_id: Column, vector: Column) -> Column:
    """Digest of a version: the id and the normalised vector."""
    return F.upper(F.sha2(F.concat(document_id, F.lit("\n"), vector), 256))


def latest(rows: DataFrame, by: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """The ``keep`` columns of the latest row of each ``by``: greatest last_modified (null least), then greatest vector
    (ignoring case), then the first delivered."""
    order = F.struct(
        F.col("last_modified"),
        key(F.coalesce("change_vector", F.lit(""))).alias("v"),
        (-F.col("delivery_id")).alias("d"),
        F.struct(*keep).alias("row"),
    )
    names = [f"b{i}" for i in range(len(by))]
    return rows.groupBy(*[c.alias(n) for c, n in zip(by, names, strict=True)]).agg(F.max(order).alias("w")).select("w.row.*")


def align(rows: DataFrame, nodes: Sequence[Node]) -> DataFrame:
    """One row for each document that a configured node holds: ``document_key``, ``document_id`` (the least spelling) and
    ``states``, an array in node order of node_idx, node, node_url, present, collection, change_vector, last_modified.

    Of several rows of a document and node the latest counts (see :func:`latest`). Null vectors are empty ones. Rows of
    other nodes are left out, so are null document ids."""
    state = F.struct(
        F.col("last_modified").alias("lm"),
        key(F.coalesce("change_vector", F.lit(""))).alias("v"),
        (-F.col("delivery_id")).alias("d"),
        F.col("collection").alias("c"),
        F.coalesce("change_vector", F.lit("")).alias("cv"),
    )
    held = rows.where(F.col("original_document_id").isNotNull() & F.col("from_node").isin([n.alias for n in nodes]))
    best = held.groupBy(key(F.col("original_document_id")).alias("document_key")).agg(
        F.min("original_document_id").alias("document_id"), *[
            F.max(F.when(F.col("from_node") == n.alias, state)).alias(f"n{n.index}") for n in nodes
        ]
    )
    cell = lambda n: F.struct(
        F.lit(n.index).alias("node_idx"), F.lit(n.alias).alias("node"), F.lit(n.url).alias("node_url"), F.col(f"n{n.index}").isNotNull().alias("present"),
        F.col(f"n{n.index}.c").alias("collection"), F.col(f"n{n.index}.cv").alias("change_vector"), F.col(f"n{n.index}.lm").alias("last_modified"),
    )
    return best.select("document_key", "document_id", F.array(*map(cell, nodes)).alias("states"))


def evaluate(aligned: DataFrame, ignored: Iterable[str] = ()) -> DataFrame:
    """Mismatches of aligned documents: ``document_key``, ``document_id``, ``collection``, ``mismatch_type``, ``winner_node``,
    ``winner_cv`` (as written), ``affected_nodes`` (urls, comma-joined, in order) and ``states``. Consistent documents have
    no row, nor have documents that no node holds.

    The winner is the replica whose vector is the element-wise maximum of all: where one vector dominates every other it is
    that maximum, so no pair of replicas has to be compared. Database ids in ``ignored`` don't count.

    A row number that the filter at the end reads keeps the optimizer from computing the vectors a second time below it."""
    ignored = list(ignored)
    differs = lambda f: F.size(F.array_distinct(F.transform("states", f))) > 1
    # most documents are held everywhere in one spelling, hence consistent, which needs no vector to be read
    suspects = aligned.where(
        F.exists("states", lambda s: s.present) & (
            F.exists("states", lambda s: ~s.present) | differs(lambda s: s.change_vector) | differs(lambda s: key(s.collection))
        )
    )
    # normalised once a replica, in an array of its own: every later expression reads it
    held = suspects.withColumn(
        "p",
        F.transform(
            F.filter("states", lambda s: s.present), lambda s: F.struct(
                key(s.node_url).alias("u"),
                s.node_idx.alias("i"),
                s.node_url.alias("url"),
                s.collection.alias("c"),
                s.change_vector.alias("cv"),
                normalize(s.change_vector, ignored).alias("nv"),
            )
        ),
    )
    sized = held.select(
        "*",
        F.transform(F.filter("p", lambda s: ~blank(s.c)), lambda s: s.c).alias("named"),
        F.size(F.array_distinct(F.transform("p", lambda s: key(s.nv)))).alias("n_versions"),
        normalize(F.array_join(F.transform("p", lambda s: s.cv), ","), ignored).alias("top"),
    )
    winners = F.filter("p", lambda s: (F.col("n_versions") == 1) | (s.nv == F.col("top")))
    judged = sized.select(
        "*",
        F.array_min(winners).alias("w"),
        F.size(F.array_distinct(F.transform("named", key))).alias("n_collections"),
        (F.size("p") < F.size("states")).alias("missing"),
        F.monotonically_increasing_id().alias("_row"),
    )
    kind = (
        F.when(F.col("n_collections") > 1, fixed.COLLECTION_MISMATCH)
        .when(~F.col("missing") & (F.col("n_versions") == 1), F.lit(None))
        .when(F.col("w").isNull(), fixed.AMBIGUOUS_CV)
        .when(F.col("missing"), fixed.MISSING)
        .otherwise(fixed.CV_MISMATCH)
    )
    urls = F.array_sort(F.array_distinct(F.transform("states", lambda s: F.struct(key(s.node_url).alias("u"), s.node_url.alias("url")))))
    affected = F.transform(F.filter(urls, lambda x: F.col("w").isNull() | (x.u != F.col("w.u"))), lambda x: x.url)
    return judged.select(
        "document_key", "document_id", F.when(
            F.col("n_collections") == 1, F.get("named", F.lit(0))
        ).otherwise(F.get("p", F.lit(0)).c).alias("collection"), kind.alias("mismatch_type"),
        F.col("w.url").alias("winner_node"), F.col("w.cv").alias("winner_cv"), F.array_join(affected, ",").alias("affected_nodes"), "states", "_row",
    ).where(F.col("mismatch_type").isNotNull() & (F.col("_row") >= 0)).drop("_row")


def alignment_rows(aligned: DataFrame) -> DataFrame:
    """Aligned states as rows, one for each document and node."""
    return aligned.select("document_key", F.explode("states").alias("s")).select("document_key", "s.*")


def looked_up(ids: DataFrame, aligned: DataFrame, nodes: Sequence[Node]) -> DataFrame:
    """States of wanted documents (``document_key``, each once) on every node, as :func:`alignment_rows` gives them; what a node, or
    every node, hasn't is there as absent."""
    absent = F.array(*[
        F.struct(F.lit(n.index).alias("node_idx"), F.lit(n.alias).alias("node"), F.lit(n.url).alias("node_url"), F.lit(False).alias("present")) for n in nodes
    ])
    states = aligned.select(F.col("document_key").alias("_k"), "states")
    of = states.schema["states"].dataType
    gone = F.transform(absent, lambda s: F.struct(s.node_idx, s.node, s.node_url, s.present, *[F.lit(None).cast(f.dataType).alias(f.name) for f in of.elementType.fields[4:]]))
    joined = ids.join(states, F.col("document_key") == F.col("_k"), "left")
    return alignment_rows(joined.select("document_key", F.coalesce("states", gone.cast(of)).alias("states")))


def problem_candidates(rows: DataFrame, n_nodes: int) -> DataFrame:
    """Documents held by fewer than ``n_nodes`` rows or in more than one version, as written: ``document_key``, ``n_rows``,
    ``from_nodes``, ``n_nodes``, ``change_vectors`` (their number). ``rows``: one for each physical id.

    The sets of a document have at most as many members as it has physical rows, which is the number of nodes."""
    index = rows.groupBy(key(F.col("original_document_id")).alias("document_key")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.array_join(F.sort_array(F.collect_set("from_node")), ",").alias("from_nodes"), F.size(F.collect_set("from_node")).alias("n_nodes"), F.size(
            F.collect_set(key(F.coalesce("change_vector", F.lit(""))))
        ).alias("n_vectors")
    )
    return index.where((F.col("n_rows") < n_nodes) | (F.col("n_vectors") > 1))


def segment_pivot(aligned: DataFrame, nodes: Sequence[Node], ignored: Iterable[str] = ()) -> DataFrame:
    """Etags by database id (rows) and node (columns named by alias in lower case), and whether all nodes have the same."""
    cells = aligned.select("document_key", F.explode("states").alias("s")).select(
        "document_key", "s.node", F.explode(components(F.col("s.change_vector"), ignored)).alias("x")
    )
    wide = cells.groupBy("document_key", F.col("x.d").alias("db_id")).pivot("node", [n.alias for n in nodes]).agg(F.max("x.e"))
    names = [n.alias.lower() for n in nodes]
    renamed = wide.withColumnsRenamed({n.alias: n.alias.lower() for n in nodes})
    same = F.lit(True)
    for n in names[1:]:
        same = same & F.col(n).eqNullSafe(F.col(names[0]))
    return renamed.withColumn("all_same", same)


def dominance(aligned: DataFrame) -> DataFrame:
    """For each two replicas that a document has on different nodes, in either order, whether the left dominates the right.
    As many rows for a document as there are ordered pairs of configured nodes, at most."""
    pairs = F.flatten(
        F.transform(
            "h", lambda a: F.transform(
                F.filter("h", lambda b: b.node != a.node), lambda b: F.struct(
                    a.node.alias("node_l"), b.node.alias("node_r"), a.change_vector.alias("l"), b.change_vector.alias("r")
                )
            )
        )
    )
    held = aligned.select("document_key", F.filter("states", lambda s: s.present).alias("h"))
    return held.select("document_key", F.explode(pairs).alias("x")).select(
        "document_key", "x.node_l", "x.node_r", dominates(F.col("x.l"), F.col("x.r")).alias("dominates")
    )


def vector_segments(rows: DataFrame, row_id: str, vector: Column) -> DataFrame:
    """Segments of vectors by database id: ``row_id``, ``db_id``, ``tag`` (of the first segment with the id) and the greatest
    ``etag``."""
    each = let(
        segments(vector), lambda a: F.transform(
            F.array_distinct(F.transform(a, lambda x: x.d)), lambda d: let(
                F.filter(a, lambda x: x.d == d), lambda g: F.struct(
                    d.alias("db_id"), F.get(g, F.lit(0)).t.alias("tag"), F.array_max(F.transform(g, lambda x: x.e)).alias("etag")
                )
            )
        )
    )
    return rows.select(row_id, F.explode(each).alias("x")).select(row_id, "x.*")


def potential_unused_ids(rows: DataFrame, explicit: Iterable[str] = ()) -> DataFrame:
    """Database ids that occur in vectors and are neither current nor in ``explicit``: ``db_id`` and the number of vectors.

    The current id of a node is the one most often written under the node's alias as tag (the least of equally frequent
    ones)."""
    parts = rows.select(
        F.col("from_node"), F.explode(segments(F.col("change_vector"), explicit)).alias("x")
    ).groupBy(F.col("x.d").alias("db_id"), F.col("x.t").alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    nodes = rows.select(F.col("from_node").alias("tag")).distinct()
    current = parts.join(nodes, "tag", "left_semi").groupBy("tag").agg(
        F.min(F.struct((-F.col("n")).alias("n"), "db_id")).alias("w")
    ).select(F.col("w.db_id").alias("db_id"))
    return parts.groupBy("db_id").agg(F.sum("n").alias("n")).join(current, "db_id", "left_anti")
