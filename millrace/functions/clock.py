"""Tags and times as the operators compare them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space around a tag.
BLANKS = " \t\r\n\f "
HOUR = 3_600_000_000
DAY = 24 * HOUR


def machine(tag: Column) -> Column:
    """A tag as machines are compared: trimmed and upper-cased; blank counts as null."""
    name = F.upper(F.btrim(tag, F.lit(BLANKS)))
    return F.when(F.length(name) > 0, name)


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a date (its midnight) or timestamp, in the session's zone (UTC)."""
    return F.unix_micros(time.cast("timestamp"))
