"""Normalising text, times and flags for comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    """Null where the text is null or holds white space only; else the text, unchanged."""
    return F.when(c.rlike(r"(?U)\S"), c)


def strip(c: Column) -> Column:
    """Without white space (Unicode's) at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def canonical_text(c: Column) -> Column:
    """CRLF as LF, no outer white space, blank as null: equal texts compare equal."""
    return F.nullif(strip(F.regexp_replace(c, "\r\n", "\n")), F.lit(""))


def instant_us(c: Column) -> Column:
    """Microseconds since the epoch of an ISO time in any spelling; no zone means UTC.

    Null for null, blank and unreadable times. Independent of the session's time zone.
    """
    t = F.regexp_replace(strip(c), r"(\d{2}:\d{2}.*[+-]\d{2})(\d{2})$", "$1:$2")
    zoned = t.rlike(r"(?i)\d{2}:\d{2}.*(z|[+-]\d{2}(:\d{2})?)$")
    dated = t.rlike(r"^\d{4}-\d{2}-\d{2}$")
    full = F.when(dated, F.concat(t, F.lit("T00:00:00Z"))).when(zoned, F.upper(t)).otherwise(F.concat(t, F.lit("Z")))
    return F.unix_micros(F.try_to_timestamp(full))


def canonical_time(c: Column) -> Column:
    """The instant as text; the stripped text itself where it is no time; null where blank."""
    return F.coalesce(instant_us(c).cast("string"), canonical_text(c))


def fix_key(c: Column) -> Column:
    """The id by which the copies of a fix match: outer white space removed, lower case."""
    return F.lower(strip(c))
