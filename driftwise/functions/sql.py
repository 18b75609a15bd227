"""The functions on version vectors for use in SQL text, as temporary SQL functions.

They are expressions that the optimizer inlines, so a query that uses them is planned as if it were written out."""

from __future__ import annotations

from pyspark.sql import SparkSession

SPACES = r"' \t\n\u000b\f\r'"
SEGMENTS = rf"""
filter(transform(filter(transform(transform(split(coalesce(cv, ''), ','), s -> btrim(s, {SPACES})), s -> named_struct('s', s, 'c', instr(s, ':'), 'h', locate('-', s, instr(s, ':') + 1))),
  x -> x.c > 1 AND x.h > 0), x -> named_struct('d', substring(x.s, x.h + 1), 'e', CASE WHEN substring(x.s, x.c + 1, x.h - x.c - 1) RLIKE '^\\s*\\+?[0-9]+\\s*$' THEN try_cast(substring(x.s, x.c + 1, x.h - x.c - 1) AS BIGINT) END)),
  x -> x.e IS NOT NULL)"""
#: name: (parameters, result type, body). The greatest etag of an id is the last of it in the sorted list.
FUNCTIONS = {
    "cv_components": (
        "cv STRING",
        "ARRAY<STRUCT<d: STRING, e: BIGINT>>",
        f"transform(array(sort_array({SEGMENTS})), a -> filter(a, (x, i) -> NOT (get(a, i + 1).d <=> x.d)))[0]",
    ),
    "cv_norm": ("cv STRING", "STRING", "array_join(transform(cv_components(cv), x -> concat(x.d, ':', x.e)), ',')"),
    "cv_ceiling": ("vectors ARRAY<STRING>", "STRING", "cv_norm(array_join(vectors, ','))"),
    "cv_dominates": ("l STRING, r STRING", "BOOLEAN", "cv_norm(concat_ws(',', l, r)) = cv_norm(l)"),
    "version_hash": ("id STRING, cv STRING", "STRING", r"upper(sha2(concat(id, '\n', cv_norm(cv)), 256))"),
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session, in place of earlier ones of the same names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
