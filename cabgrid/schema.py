"""Schemas of the raw trip records."""

from pyspark.sql import types as T

# Money is kept exactly as written, to six decimals.
MONEY = T.DecimalType(20, 6)

# --- fixed values: the 17 comma-separated fields of a raw trip record, no
# header, in this order (must stay exactly as written) ----------------------
RAW_FIELDS = (
    ("medallion", T.StringType()),
    ("hack_license", T.StringType()),
    ("pickup_datetime", T.StringType()),
    ("dropoff_datetime", T.StringType()),
    ("trip_time_in_secs", T.IntegerType()),
    ("trip_distance", T.DoubleType()),
    ("pickup_longitude", T.DoubleType()),
    ("pickup_latitude", T.DoubleType()),
    ("dropoff_longitude", T.DoubleType()),
    ("dropoff_latitude", T.DoubleType()),
    ("payment_type", T.StringType()),
    ("fare_amount", MONEY),
    ("surcharge", MONEY),
    ("mta_tax", MONEY),
    ("tip_amount", MONEY),
    ("tolls_amount", MONEY),
    ("total_amount", MONEY),
)
# ---------------------------------------------------------------------------

RAW_COLUMNS = tuple(n for n, _ in RAW_FIELDS)

# What delimited readers are asked for.  The coordinates, which every filter
# tests, are parsed inside the scan: once per record, and the scan itself can
# drop the record.  Both Spark's reader and its cast hand a number's text to
# the same parser, blanks around it included.  All other fields are text that
# sources.records types.
IN_SCAN = ("pickup_longitude", "pickup_latitude", "dropoff_longitude", "dropoff_latitude")
RAW_TEXT_SCHEMA = T.StructType([T.StructField(n, t if n in IN_SCAN else T.StringType(), True) for n, t in RAW_FIELDS])
