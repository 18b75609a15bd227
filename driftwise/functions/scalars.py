"""Small text and number functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftwise import fixed


def duration_text(seconds: Column) -> Column:
    """``HH:MM:SS`` with as many digits of hours as they need; negative durations are zero."""
    s = F.floor(F.greatest(seconds, F.lit(0))).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint"), s % 60)


def age_text(at: Column, now: Column) -> Column:
    """How long ago ``at`` was, or 'never' for null."""
    return F.when(at.isNull(), "never").otherwise(
        duration_text(F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros(at.cast("timestamp")) / 1e6)
    )


def backoff_seconds(failures: Column, first: int = 30, most: int = 60) -> Column:
    """Wait after so many failures in a row: doubling from ``first``, at most ``most``."""
    return F.least(F.lit(first) * F.pow(F.lit(2.0), failures - 1), F.lit(float(most)))


def csv_field(text: Column) -> Column:
    """A field quoted as RFC 4180 wants it; null is empty."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[,"\r\n]'), quoted).otherwise(text), F.lit(""))


def iso_text(at: Column) -> Column:
    """A UTC timestamp with seven fractional digits and Z."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0Z'")


def parse_iso(text: Column) -> Column:
    """The UTC timestamp of an ISO text: as :func:`iso_text` writes it, with an offset, or with neither, which is taken as
    UTC. Digits after the microsecond don't count; unreadable text is null."""
    short = F.regexp_replace(F.trim(text), r"(\.\d{6})\d*", "$1")
    shifted = F.convert_timezone(F.current_timezone(), F.lit("UTC"), short.try_cast("timestamp").cast("timestamp_ntz"))
    return F.when(short.rlike(r"[+-]\d\d:\d\d$"), shifted).otherwise(F.regexp_replace(short, "Z$", "").try_cast("timestamp_ntz"))


def touch_statement(collection: Column) -> Column:
    """A statement that rewrites the documents of a collection unchanged; null for a blank collection."""
    escaped = F.replace(collection, F.lit('"'), F.lit('""'))
    return F.when(
        collection.isNotNull() & (F.trim(collection) != ""), F.concat(F.lit(fixed.TOUCH_BEFORE), escaped, F.lit(fixed.TOUCH_AFTER))
    )


def base_url(url: Column) -> Column:
    """A URL without slashes at its end."""
    return F.rtrim(url, F.lit("/"))


def file_name(text: Column) -> Column:
    """Text with every character that file names shouldn't have replaced by an underscore."""
    return F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1f]', "_")


def numbered(prefix: str, number: Column, digits: int, suffix: str = "") -> Column:
    """A name with a zero-padded number, as of segments (6 digits) and result files (3)."""
    return F.format_string(f"{prefix}%0{digits}d{suffix}", number)


def thousands(number: Column) -> Column:
    """A whole number with commas."""
    return F.format_number(number, 0)


def run_id(started: Column) -> Column:
    """The id of a run by its UTC start, with seven fractional digits; ids sort as their starts do."""
    return F.concat(F.lit("runs/"), F.date_format(started, "yyyyMMdd-HHmmssSSSSSS"), F.lit("0"))


def is_url(text: Column) -> Column:
    """Whether text is an address with a scheme of the web and a host; null for null."""
    return text.rlike(r"^https?://[^/\s?#]+")
