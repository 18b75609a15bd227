"""The queries p6 to p8 over documents, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwise.llm.mixing import ALL, mix, mix_shares
from driftwise.llm.packing import pack
from driftwise.llm.splitting import split_spans, split_texts, split_tokens
from driftwise.llm.tokens import bpe_tokens, byte_tokens
from driftwise.session import cut
from driftwise.sources.tables import table

#: Tokens (bytes) of a container and of the largest piece, and of the overlap of consecutive pieces.
CAPACITY, LIMIT, OVERLAP = 8192, 8192, 256
#: Tokens of a container for BPE sizes, and of the largest piece and the overlap.
BPE_CAPACITY, BPE_LIMIT, BPE_OVERLAP = 2048, 2048, 64
SEED = 20260101


def bpe_vocabulary(spark: SparkSession) -> str:
    """Path of the BPE ranks: the session's driftwise.bpe.vocabulary, else where this box has them."""
    return spark.conf.get("driftwise.bpe.vocabulary", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def _sized(spark: SparkSession, folder: str, tokens: Column | None = None) -> DataFrame:
    """Ids, sources and sizes, in the shared folder: operators read them several times, and the texts once."""
    tokens = byte_tokens(F.col("text")) if tokens is None else tokens
    return cut(table(spark, folder, "documents").select("doc_id", "source", tokens.alias("n_tokens")))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_sized(spark, folder), "doc_id", "n_tokens", CAPACITY)


def p6_containers_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_sized(spark, folder, bpe_tokens(F.col("text"), bpe_vocabulary(spark))), "doc_id", "n_tokens", BPE_CAPACITY)


def p6_container_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full containers are: for each number of tokens used, the containers with it."""
    used = p6_containers(spark, folder).where(F.col("container_id").isNotNull()).groupBy("container_id").agg(
        F.sum("n_tokens").alias("tokens_used")
    )
    return used.groupBy("tokens_used").agg(F.count(F.lit(1)).alias("n_containers"))


def p6_bpe_facts(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the containers of BPE tokens, in one row: documents, containers over the capacity, documents that fit but
    were cut, documents whose pieces leave a gap, documents without a container, and whether at most a fifth is left unused."""
    placed = cut(p6_containers_bpe(spark, folder))
    documents = placed.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.count("container_id").alias("held")
    ).agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= BPE_CAPACITY)).alias("n_cut_needlessly"),
        F.count_if(F.col("end") != F.col("tokens")).alias("n_with_gaps"),
        F.count_if(F.col("held") == 0).alias("n_without_container"),
    )
    containers = placed.where(F.col("container_id").isNotNull()).groupBy("container_id").agg(F.sum("n_tokens").alias("used")).agg(
        F.count_if(F.col("used") > BPE_CAPACITY).alias("n_overfull"),
        F.coalesce(F.sum("used") >= F.lit(0.8) * BPE_CAPACITY * (F.count(F.lit(1)) - 1), F.lit(True)).alias("tight"),
    )
    return documents.join(containers)  # one row each


P6_PARTS = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(strlen(text), 0) AS n FROM documents),
parts AS (SELECT doc_id, piece, piece * {CAPACITY} AS first_token, least({CAPACITY}, n - piece * {CAPACITY}) AS length FROM (SELECT doc_id, n, unnest(range((n + {CAPACITY - 1}) // {CAPACITY})) AS piece FROM d)),
hist AS (SELECT length, count(*) AS n, row_number() OVER (ORDER BY length DESC) AS i FROM parts GROUP BY 1),
plan AS (
  SELECT CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS made, CAST(0 AS BIGINT) AS s, CAST([] AS STRUCT(gap BIGINT, s BIGINT, first BIGINT, n BIGINT)[]) AS gaps,
    CAST([] AS STRUCT(length BIGINT, lo BIGINT, hi BIGINT, first BIGINT, each BIGINT, fill BIGINT)[]) AS steps
  UNION ALL
  SELECT CASE WHEN done THEN i + 1 ELSE i END, CASE WHEN done THEN 0 ELSE r + fit * each END, made, s + 3,
    list_filter(list_concat(rest, [{{'gap': gap - each * length, 's': s + 1, 'first': first, 'n': fit}}, {{'gap': gap - extra * length, 's': s + 2, 'first': first + fit, 'n': CASE WHEN extra > 0 THEN 1 ELSE 0 END}},
      {{'gap': gap, 's': s + 3, 'first': first + fit + CASE WHEN extra > 0 THEN 1 ELSE 0 END, 'n': there - fit - CASE WHEN extra > 0 THEN 1 ELSE 0 END}}]), lambda x: x.gap > 0 AND x.n > 0),
    list_filter([{{'length': length, 'lo': r, 'hi': r + fit * each - 1, 'first': first, 'each': each, 'fill': {CAPACITY} - gap}},
      {{'length': length, 'lo': r + fit * each, 'hi': r + fit * each + extra - 1, 'first': first + fit, 'each': each, 'fill': {CAPACITY} - gap}}], lambda x: x.hi >= x.lo)
  FROM (SELECT *, CASE WHEN fit < there THEN n - r - fit * each ELSE 0 END AS extra, fit < there OR r + fit * each = n AS done FROM (
    SELECT *, least(there, (n - r) // each) AS fit FROM (
      SELECT *, gap // length AS each FROM (
        SELECT p.i, p.r, p.s, h.length, h.n, coalesce(c.gap, {CAPACITY}) AS gap, coalesce(c.first, p.made) AS first,
          coalesce(c.n, (h.n - p.r + {CAPACITY} // h.length - 1) // ({CAPACITY} // h.length)) AS there,
          CASE WHEN c IS NULL THEN p.made + (h.n - p.r + {CAPACITY} // h.length - 1) // ({CAPACITY} // h.length) ELSE p.made END AS made,
          CASE WHEN c IS NULL THEN p.gaps ELSE list_filter(p.gaps, lambda x: x.s <> c.s) END AS rest
        FROM (SELECT *, list_filter(gaps, lambda x: x.gap = tight AND x.s = list_max(list_transform(list_filter(gaps, lambda y: y.gap = tight), lambda y: y.s)))[1] AS c
          FROM (SELECT q.*, list_min(list_transform(list_filter(q.gaps, lambda x: x.gap >= g.length), lambda x: x.gap)) AS tight FROM plan q JOIN hist g ON g.i = q.i)) p JOIN hist h ON h.i = p.i))))),
steps AS (SELECT unnest(steps, recursive := true) FROM plan),
ranked AS (SELECT *, row_number() OVER (PARTITION BY length ORDER BY doc_id, piece) - 1 AS rank FROM parts),
placed AS (SELECT r.doc_id, r.piece, r.first_token, r.length AS n_tokens, s.first + (r.rank - s.lo) // s.each AS container_id, s.fill + (r.rank - s.lo) % s.each * r.length AS container_offset
  FROM ranked r JOIN steps s ON s.length = r.length AND r.rank BETWEEN s.lo AND s.hi
  UNION ALL SELECT doc_id, 0, 0, 0, NULL, NULL FROM d WHERE n = 0)"""
P6_SQL = P6_PARTS + " SELECT * FROM placed"
P6_FILL_SQL = P6_PARTS + """ SELECT tokens_used, count(*) AS n_containers FROM (SELECT CAST(sum(n_tokens) AS BIGINT) AS tokens_used FROM placed
  WHERE container_id IS NOT NULL GROUP BY container_id) GROUP BY 1"""
P6_BPE_FACTS_SQL = """SELECT count(*) AS n_documents, 0 AS n_cut_needlessly, 0 AS n_with_gaps, count(*) FILTER (coalesce(text, '') = '') AS n_without_container,
  0 AS n_overfull, true AS tight FROM documents"""


def _mixed(spark: SparkSession, folder: str, total: str | None) -> DataFrame:
    return mix(_sized(spark, folder), "doc_id", "source", "n_tokens", table(spark, folder, "mix_targets"), seed=SEED, total=total)


def _shares(spark: SparkSession, folder: str, total: str | None) -> DataFrame:
    got = mix_shares(_sized(spark, folder), "doc_id", "source", "n_tokens", table(spark, folder, "mix_targets"), seed=SEED, total=total)
    return got.withColumns({c: F.round(c, 9) for c in ("rate", "actual_share")})


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """A mix of as many tokens as the sources with a target hold: small sources are repeated, up to their caps."""
    return _mixed(spark, folder, ALL)


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """What each source got in it."""
    return _shares(spark, folder, ALL)


def p7_even_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The largest mix in which every source has its share and no cap is exceeded."""
    return _mixed(spark, folder, None)


def p7_even_shares(spark: SparkSession, folder: str) -> DataFrame:
    """What each source got in it."""
    return _shares(spark, folder, None)


def _p7_drawn(room: str) -> str:
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(strlen(text), 0) AS n_tokens FROM documents),
h AS (SELECT source, count(*) AS n_records, CAST(sum(n_tokens) AS BIGINT) AS n_tokens FROM d WHERE source IS NOT NULL GROUP BY 1),
k AS (SELECT t.source, t.target_share, t.max_repeats, coalesce(h.n_records, 0) AS n_records, coalesce(h.n_tokens, 0) AS n_tokens
  FROM mix_targets t LEFT JOIN h ON t.source = h.source),
room AS (SELECT {room} AS room FROM k WHERE n_tokens > 0),
r AS (SELECT k.*, CASE WHEN n_tokens > 0 THEN least(CAST(max_repeats AS DOUBLE), target_share * room / n_tokens) ELSE 0.0 END AS rate FROM k, room),
c AS (SELECT d.doc_id, d.source, d.n_tokens, CAST(floor(r.rate) AS BIGINT) + CASE WHEN
  CAST(('0x' || substr(md5('{SEED}:' || d.doc_id), 1, 8)) AS BIGINT) / 4294967296.0 < r.rate - floor(r.rate) THEN 1 ELSE 0 END AS copies
  FROM d JOIN r ON d.source = r.source)"""


def _p7_sql(room: str) -> tuple[str, str]:
    drawn = _p7_drawn(room)
    return drawn + " SELECT doc_id, source, n_tokens, unnest(range(1, copies + 1)) AS copy FROM c WHERE copies > 0", drawn + """,
g AS (SELECT source, CAST(sum(copies) AS BIGINT) AS mixed_records, CAST(sum(copies * n_tokens) AS BIGINT) AS mixed_tokens FROM c GROUP BY 1)
SELECT r.* REPLACE (round(rate, 9) AS rate), coalesce(g.mixed_records, 0) AS mixed_records, coalesce(g.mixed_tokens, 0) AS mixed_tokens,
  round(coalesce(g.mixed_tokens, 0) / (SELECT sum(mixed_tokens) FROM g), 9) AS actual_share FROM r LEFT JOIN g ON r.source = g.source"""


P7_MIX_SQL, P7_SHARES_SQL = _p7_sql("sum(n_tokens) / sum(target_share)")
P7_EVEN_MIX_SQL, P7_EVEN_SHARES_SQL = _p7_sql("min(max_repeats * n_tokens / target_share)")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Oversized documents, one row for the first piece of each, and whether they have a stretch too long for a piece."""
    pieces = split_spans(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text", LIMIT, OVERLAP)
    return pieces.where(F.col("piece") == 0).select("doc_id", F.when(F.col("unbroken"), "hard").otherwise("boundary").alias("cut"))


def p8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_texts(table(spark, folder, "documents"), "doc_id", "text", LIMIT, OVERLAP)


def p8_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The texts put together again from what is new in each of their pieces: length, digest, and whether no piece is over the
    limit, no overlap over what is wanted, and no word cut that fits."""
    fresh = F.substring(F.col("piece_text").cast("binary"), F.col("new_byte") - F.col("first_byte") + 1, F.col("n_tokens")).cast("string")
    parts = p8_pieces(spark, folder).select("doc_id", "piece", "n_tokens", "cut", (F.col("new_byte") - F.col("first_byte")).alias("overlap"), fresh.alias("fresh"))
    # a group is one text, which was one row before
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "fresh"))), lambda p: p.fresh), "")
    return parts.groupBy("doc_id").agg(
        F.sum(F.col("n_tokens") - F.col("overlap")).cast("bigint").alias("n_bytes"),
        F.md5(whole.cast("binary")).alias("digest"),
        (F.max("n_tokens") <= LIMIT).alias("fits"),
        (F.max("overlap") <= OVERLAP).alias("overlaps"),
        (F.count_if(F.col("cut") == "hard") > 0).alias("cuts_words"),
    )


def p8_bpe_facts(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the pieces by BPE tokens of each text: the bytes that they cover one after the other, and whether none is
    over the limit."""
    pieces = split_tokens(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text", BPE_LIMIT, BPE_OVERLAP, bpe_vocabulary(spark))
    return pieces.groupBy("doc_id").agg(
        F.sum(F.col("end_byte") - F.col("new_byte")).cast("bigint").alias("n_bytes"),
        F.max("end_byte").cast("bigint").alias("end"),
        (F.max("n_tokens") <= BPE_LIMIT).alias("fits"),
        (F.count_if((F.col("piece") > 0) & (F.col("end_byte") <= F.col("new_byte"))) == 0).alias("all_new"),
    )


P8_BPE_FACTS_SQL = """SELECT doc_id, strlen(text) AS n_bytes, strlen(text) AS "end", true AS fits, true AS all_new FROM documents WHERE text IS NOT NULL"""
LONGEST = r"list_max(list_transform(regexp_split_to_array(text, '[ \t\r\n]'), lambda w: strlen(w)))"
P8_FOUND_SQL = f"SELECT doc_id, CASE WHEN {LONGEST} > {LIMIT} THEN 'hard' ELSE 'boundary' END AS cut FROM documents WHERE strlen(text) > {LIMIT}"
P8_ROUND_TRIP_SQL = f"""SELECT doc_id, strlen(text) AS n_bytes, md5(text) AS digest, true AS fits, true AS overlaps, strlen(text) > {LIMIT} AND {LONGEST} > {LIMIT} AS cuts_words
  FROM documents WHERE text IS NOT NULL"""

QUERIES = {
    "p6_containers": p6_containers, "p6_container_fill": p6_container_fill, "p6_containers_bpe": p6_containers_bpe, "p6_bpe_facts": p6_bpe_facts,
    "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_even_mix": p7_even_mix, "p7_even_shares": p7_even_shares,
    "p8_found": p8_found, "p8_pieces": p8_pieces, "p8_round_trip": p8_round_trip, "p8_bpe_facts": p8_bpe_facts,
}
SQL = {
    "p6_containers": P6_SQL, "p6_container_fill": P6_FILL_SQL, "p6_bpe_facts": P6_BPE_FACTS_SQL, "p7_mix": P7_MIX_SQL, "p7_shares": P7_SHARES_SQL,
    "p7_even_mix": P7_EVEN_MIX_SQL, "p7_even_shares": P7_EVEN_SHARES_SQL, "p8_found": P8_FOUND_SQL, "p8_round_trip": P8_ROUND_TRIP_SQL, "p8_bpe_facts": P8_BPE_FACTS_SQL,
}
