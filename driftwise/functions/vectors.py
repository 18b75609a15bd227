"""Version vectors as column expressions.

A version vector is text: comma-separated segments ``TAG:ETAG-DBID``. The tag is ignored when vectors are compared, the
database id identifies a component, and the greatest etag of an id counts. Every function here takes and returns Spark
columns built from JVM expressions only; none needs a shuffle or a Python worker.

Unreadable segments (no colon, empty tag, no dash after the colon, an etag that is no 64-bit integer) are skipped; null and
blank vectors have no components and the canonical text ``''``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGER = r"^\s*\+?[0-9]+\s*$"
SPACES = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, wherever the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at either end (``trim`` alone takes spaces only)."""
    return F.btrim(c, F.lit(SPACES))


def blank(c: Column) -> Column:
    """Null, or nothing but spaces. Never null itself."""
    return c.isNull() | (F.trim(c) == "")


def key(c: Column) -> Column:
    """What identifiers and collections are compared by: case doesn't count, in equality or order."""
    return F.upper(c)


def parse_long(c: Column) -> Column:
    """A 64-bit integer: digits, spaces around and one leading plus; everything else is null."""
    return F.when(c.rlike(INTEGER), c.try_cast("bigint"))


def segments(cv: Column, ignored: Iterable[str] = ()) -> Column:
    """array<struct<d: database id, e: etag, t: tag>> of the readable segments, in the order written."""
    cut = F.transform(F.split(cv, ","), strip)
    cut = F.transform(cut, lambda s: F.struct(s.alias("s"), F.instr(s, ":").alias("c")))
    # the first dash after the first colon ends the etag
    cut = F.transform(
        cut, lambda x: F.struct(x.s.alias("s"), x.c.alias("c"), F.call_function("locate", F.lit("-"), x.s, x.c + 1).alias("h"))
    )
    cut = F.filter(cut, lambda x: (x.c > 1) & (x.h > 0))
    parts = F.transform(
        cut,
        lambda x: F.struct(
            F.substring(x.s, x.h + 1, F.length(x.s)).alias("d"),
            parse_long(F.substring(x.s, x.c + 1, x.h - x.c - 1)).alias("e"),
            F.substring(x.s, F.lit(1), x.c - 1).alias("t"),
        ),
    )
    skip = list(ignored)
    ok = (lambda x: x.e.isNotNull() & ~x.d.isin(skip)) if skip else (lambda x: x.e.isNotNull())
    return F.coalesce(F.filter(parts, ok), F.array().cast("array<struct<d:string,e:bigint,t:string>>"))


def components(cv: Column, ignored: Iterable[str] = ()) -> Column:
    """array<struct<d, e>>: one entry for each database id with its greatest etag, by id in binary order."""
    pairs = F.sort_array(F.transform(segments(cv, ignored), lambda x: F.struct(x.d.alias("d"), x.e.alias("e"))))
    return let(pairs, lambda a: F.filter(a, lambda x, i: ~F.get(a, i + 1).d.eqNullSafe(x.d)))


def normalize(cv: Column, ignored: Iterable[str] = ()) -> Column:
    """Canonical text: ``id:etag`` joined by commas, by id in binary order; ``''`` without components. Never null."""
    return F.array_join(F.transform(components(cv, ignored), lambda x: F.concat(x.d, F.lit(":"), x.e.cast("string"))), ",")


def as_map(cv: Column, ignored: Iterable[str] = ()) -> Column:
    """map<database id, greatest etag>."""
    return F.map_from_entries(components(cv, ignored))


def dominates(left: Column, right: Column, ignored: Iterable[str] = ()) -> Column:
    """Whether every component of ``right`` is in ``left`` with at least its etag (so equal vectors dominate each other)."""
    return let(
        as_map(left, ignored),
        lambda m: F.forall(components(right, ignored), lambda x: F.coalesce(F.try_element_at(m, x.d) >= x.e, F.lit(False))),
    )


def ceiling(vectors: Column, ignored: Iterable[str] = ()) -> Column:
    """Canonical text of the element-wise maximum of an array of vectors.

    Parsing keeps the greatest etag of a repeated id, hence the maximum is the canonical text of all vectors joined."""
    return normalize(F.array_join(vectors, ","), ignored)
