from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(c) -> Column:
    """Accept a column name or a Column."""
    return F.col(c) if isinstance(c, str) else c


def typed_once(trips: DataFrame, fields, keep=()) -> DataFrame:
    """``keep`` as it is and ``fields`` computed once per row.

    A filter on a computed column is moved below its projection with a copy of
    the computation, so a parsed field would be parsed again for each test of
    it.  Rows made by a generator (one of each) are tested where they are
    made; filters on other columns still reach the scan.
    """
    return trips.select(*keep, F.inline(F.array(F.struct(*fields))))
