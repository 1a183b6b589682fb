"""Raw trip records → the trip frame every query reads.

Every reader (split lines, plain text, CSV, streams) hands over text fields
and types them here, so a field means the same whatever it was read with.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeparts import parse_datetime
from ..schema import IN_SCAN, RAW_COLUMNS, RAW_FIELDS


def typed_fields(field: Callable[[int, str], Column]) -> list[Column]:
    """The 17 raw fields, cast to their types; ``field(i, name)`` is the text.

    Blanks around a number do not count.  A missing or malformed field (also
    money beyond the decimal's range) is NULL instead of an error, so a bad
    record only loses itself.  An empty text field is NULL too, as delimited
    readers cannot tell it from a missing one.
    """
    out = []
    for i, (name, dtype) in enumerate(RAW_FIELDS):
        text = field(i, name)
        value = F.nullif(text, F.lit("")) if dtype.typeName() == "string" else F.trim(text).try_cast(dtype)
        out.append(value.alias(name))
    return out


def fields_of_array(parts: Column) -> list[Column]:
    """Typed fields of a split line."""
    return typed_fields(lambda i, _: F.get(parts, i))


def typed_records(raw: DataFrame, keep=()) -> DataFrame:
    """A frame read with ``RAW_TEXT_SCHEMA`` with the raw fields' types."""
    typed = typed_fields(lambda _, name: F.col(name))
    return raw.select(*keep, *[F.col(n) if n in IN_SCAN else c for n, c in zip(RAW_COLUMNS, typed)])


def trips_from_records(raw: DataFrame) -> DataFrame:
    """Add zone-free pickup and drop-off time stamps to raw 17-field records."""
    return raw.withColumns(
        {
            "pickup_ts": parse_datetime("pickup_datetime"),
            "dropoff_ts": parse_datetime("dropoff_datetime"),
        }
    )
