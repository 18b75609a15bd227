"""Fragments of DuckDB SQL shared by the oracle queries.

They restate the semantics of :mod:`driftwise.functions.vectors` in plain SQL, so that the Spark plans are compared with an
independent formulation rather than with a copy of themselves.
"""

from __future__ import annotations

from collections.abc import Iterable


def quoted(values: Iterable[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def cv_segments(col: str, ignored: Iterable[str] = ()) -> str:
    """List of the readable segments of a version vector: struct(t tag, e etag text, d database id)."""
    skip = f" AND x.d NOT IN ({quoted(ignored)})" if list(ignored) else ""
    return (
        f"list_filter(list_transform(string_split(coalesce({col}, ''), ','), lambda s: "
        r"regexp_extract(regexp_replace(s, '^\s+|\s+$', '', 'g'), '(?s)^([^:]+):([^-]*)-(.*)$', ['t', 'e', 'd'])), lambda x: "
        r"regexp_full_match(x.e, '\s*\+?[0-9]+\s*') AND try_cast(trim(x.e) AS BIGINT) IS NOT NULL" + skip + ")"
    )


def cv_norm(col: str, ignored: Iterable[str] = ()) -> str:
    """Canonical text of a version vector: ``id:etag`` by id in binary order, the greatest etag of each id."""
    seg = cv_segments(col, ignored)
    return (
        f"(SELECT coalesce(string_agg(d || ':' || m, ',' ORDER BY d), '') FROM (SELECT u.s.d AS d, max(CAST(trim(u.s.e) AS BIGINT)) AS m "
        f"FROM (SELECT unnest({seg}) AS s) u GROUP BY 1))"
    )


def blank(col: str) -> str:
    return f"({col} IS NULL OR trim({col}) = '')"


def present(col: str) -> str:
    return f"({col} IS NOT NULL AND trim({col}) <> '')"
