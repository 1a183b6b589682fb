"""Weekday, hour and minute of a trip time stamp.

Time stamps are zone-free (``timestamp_ntz``): they are the wall-clock text
of the record, so no session time zone or daylight-saving shift may touch
them.  The weekday therefore goes through a ``date`` and the hour through
``hour()``, never through ``date_format`` on the time stamp itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .._cols import as_col


def parse_datetime(text) -> Column:
    """Text ``yyyy-MM-dd HH:mm:ss`` to ``timestamp_ntz``; NULL when malformed.

    The cast alone would also take a date without a time, one-digit parts
    and zone offsets (and drop the offset), so the form is checked first.
    """
    return F.when(as_col(text).rlike(C.DATETIME_FORM), as_col(text).try_cast("timestamp_ntz"))


def weekday_name(ts) -> Column:
    """Lower-case English day name, e.g. ``"monday"``."""
    return F.lower(F.date_format(as_col(ts).cast("date"), "EEEE"))


def hour_text(ts) -> Column:
    """Hour of day as two characters, ``"00"`` to ``"23"``."""
    return hour_number_text(F.hour(as_col(ts)))


def day_number(ts) -> Column:
    """Day of week as 1 (Sunday) to 7 (Saturday): a compact grouping key."""
    return F.dayofweek(as_col(ts))


def weekday_from_number(day) -> Column:
    """Day number from :func:`day_number` → the name :func:`weekday_name` gives."""
    return F.element_at(F.array(*[F.lit(n) for n in C.WEEKDAY_NAMES]), as_col(day))


def hour_number_text(hour) -> Column:
    """Hour number 0..23 → two characters."""
    return F.lpad(as_col(hour).cast("string"), 2, "0")


def minute_of(ts) -> Column:
    """Minute of the hour, 0 to 59."""
    return F.minute(as_col(ts))


def in_last_minutes(ts, from_minute: int) -> Column:
    """True when the time stamp lies at or after ``from_minute`` of its hour."""
    return minute_of(ts) >= F.lit(from_minute)

