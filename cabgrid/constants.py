"""Fixed values shared by every query.

These numbers define the study area and the 500 m grid used to name areas
and routes.  Results only agree with the original job when they are used
unchanged, so they are kept together here and nowhere else.
"""

# --- fixed values (must stay exactly as written) ---------------------------
# Bounding box of the study area, in degrees; both ends are inclusive.
LON_MIN = -74.916578
LON_MAX = -73.120784
LAT_MIN = 40.129716
LAT_MAX = 41.477183

# Centre of grid cell 1.1 (north-west corner of the grid), in degrees.
GRID_X0 = -74.913585
GRID_Y0 = 41.474937

# Cell side in metres and the change in degrees per metre along each axis.
CELL_METRES = 500
LON_DEGREES_PER_METRE = 0.005986 / 500.0
LAT_DEGREES_PER_METRE = 0.004491556 / 500.0

# Cell indices of the full grid run from 1 to this value on both axes.
GRID_CELLS = 300

# Ranking depth of the two index queries and the k values of the stand sweep.
TOP_N = 10
STAND_KS = (5, 31, 75)

# Minute of the drop-off hour from which a taxi counts as empty, and from
# which its revenue counts towards profitability.
EMPTY_FROM_MINUTE = 30
PROFIT_FROM_MINUTE = 45

# Text form of the trip time stamps: yyyy-MM-dd HH:mm:ss, every part in full.
DATETIME_FORM = "^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"

# Weekday names as reported, in Spark's dayofweek() order (1 = Sunday).
WEEKDAY_NAMES = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
# ---------------------------------------------------------------------------

# Layout of the points that k-means is fitted on, where the caller sets none:
# so many points a partition, and no fewer partitions than this.  It follows
# from the points alone, so that stands do not depend on cores or input splits.
POINTS_PER_PARTITION = 250_000
STAND_PARTITIONS = 8

# Seed for k-means; the original leaves it to Python's hash of the class name.
KMEANS_SEED = 42
