"""Text to timestamp with a fixed, ordered list of formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Tried in this order, month before day where both are possible.
DATE_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy/MM/dd",
    "M/d/yyyy",
    "M-d-yyyy",
    "d/M/yyyy",
    "MMM d, yyyy",
    "d MMM yyyy",
    "yyyyMMdd",
    "yyyy-MM-dd[' ']['T']HH:mm[:ss][.SSSSSS][XXX]",
    "yyyy/MM/dd HH:mm[:ss]",
    "M/d/yyyy HH:mm[:ss]",
    "MMMM d, yyyy",
    "d MMMM yyyy",
)


def parse_timestamp(c: Column, formats: tuple[str, ...] | list[str] = DATE_FORMATS) -> Column:
    """First format that fits, else NULL. Result has no time zone: a text with one is read in the session's."""
    text = F.trim(c)
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in formats]
    return F.coalesce(*tries).cast("timestamp_ntz")


def parse_utc(c: Column) -> Column:
    """ISO text with ``Z``, an offset or no zone (read as UTC) to an instant; else NULL.

    Assumes the session time zone is UTC, as for every instant in the usage logs.
    """
    text = F.trim(c)
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$")
    return F.when(iso, F.try_to_timestamp(text))


def day_span(first: Column, last: Column) -> Column:
    """Whole 24-hour days between two instants (not calendar days)."""
    return F.timestamp_diff("DAY", first, last)
