"""DuckDB SQL for every registered query (the correctness oracle).

Each statement runs on the driver's pre-registered tables (only ``events``
is read) and must return the same rows and column names as the Spark query
of the same name.  Literals are cast to DOUBLE (DuckDB reads them as
DECIMAL otherwise) and integer results are cast to match Spark's types.
"""

from __future__ import annotations

from .. import constants as C
from ..functions.geo import LAT_STEP, LON_STEP
from ..schema import RAW_FIELDS


def _d(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def _lon(base: str, mult: int) -> str:
    return (
        f"{_d(C.GRID_X0)} + {_d(LON_STEP)} * ({base} + "
        f"CAST((event_id * {mult}) % 80 - 40 AS DOUBLE) / CAST(100 AS DOUBLE))"
    )


def _lat(base: str, mult: int) -> str:
    return (
        f"{_d(C.GRID_Y0)} - {_d(LAT_STEP)} * ({base} + "
        f"CAST((event_id * {mult}) % 80 - 40 AS DOUBLE) / CAST(100 AS DOUBLE))"
    )


def _edge(n: int) -> str:
    return f"(CAST(60 + event_id % {n} AS DOUBLE) - CAST(0.5 AS DOUBLE))"


_BESIDE = "CAST(event_id % 3 - 1 AS DOUBLE) * CAST(1e-9 AS DOUBLE)"


def _bound(every: int, low: float, high: float, turn: int) -> str:
    return f"CASE WHEN (event_id // {every * turn}) % 2 = 0 THEN {_d(low)} ELSE {_d(high)} END"


_TRIP_TIME = "CAST(60 + (event_id * 37) % 2400 AS INTEGER)"
_DROPOFF = f"ts + INTERVAL '1' SECOND * {_TRIP_TIME}"

TRIPS = f"""trips AS (
  SELECT event_id,
    CAST(user_id AS VARCHAR) AS medallion,
    ts AS pickup_ts,
    {_DROPOFF} AS dropoff_ts,
    {_TRIP_TIME} AS trip_time_in_secs,
    CASE WHEN event_id % 50 = 0 THEN CAST(0 AS DOUBLE)
         WHEN event_id % 47 = 0 THEN CAST(-75.5 AS DOUBLE)
         WHEN event_id % 41 = 0 THEN {_bound(41, C.LON_MIN, C.LON_MAX, 1)}
         WHEN event_id % 43 = 0 THEN {_d(C.GRID_X0)} + {_d(LON_STEP)} * {_edge(170)} + {_BESIDE}
         ELSE {_lon("CASE WHEN event_id % 4 = 0 THEN 150 ELSE 100 + (user_id * 37) % 101 END", 13)} END AS pickup_longitude,
    CASE WHEN event_id % 50 = 0 THEN CAST(0 AS DOUBLE)
         WHEN event_id % 41 = 0 THEN {_bound(41, C.LAT_MIN, C.LAT_MAX, 2)}
         WHEN event_id % 43 = 0 THEN {_d(C.GRID_Y0)} - {_d(LAT_STEP)} * {_edge(190)} + {_BESIDE}
         ELSE {_lat("CASE WHEN event_id % 4 = 0 THEN 160 ELSE 110 + (user_id * 53) % 83 END", 29)} END AS pickup_latitude,
    CASE WHEN event_id % 53 = 0 THEN CAST(0 AS DOUBLE)
         WHEN event_id % 61 = 0 THEN {_bound(61, C.LON_MIN, C.LON_MAX, 1)}
         WHEN event_id % 67 = 0 THEN {_d(C.GRID_X0)} + {_d(LON_STEP)} * {_edge(150)} + {_BESIDE}
         ELSE {_lon("CASE WHEN event_id % 4 = 0 THEN 153 ELSE 120 + (user_id * 11 + event_id % 5) % 97 END", 17)} END AS dropoff_longitude,
    CASE WHEN event_id % 59 = 0 THEN CAST(42.5 AS DOUBLE)
         WHEN event_id % 61 = 0 THEN {_bound(61, C.LAT_MIN, C.LAT_MAX, 2)}
         WHEN event_id % 67 = 0 THEN {_d(C.GRID_Y0)} - {_d(LAT_STEP)} * {_edge(160)} + {_BESIDE}
         ELSE {_lat("CASE WHEN event_id % 4 = 0 THEN 164 ELSE 130 + (user_id * 7 + event_id % 3) % 71 END", 31)} END AS dropoff_latitude,
    CAST(value AS DECIMAL(12,2)) AS fare_amount,
    CAST(CAST(event_id % 7 AS INTEGER) AS DECIMAL(12,2)) AS tip_amount
  FROM events)"""

_TS19 = "substring(CAST({} AS VARCHAR), 1, 19)"

LINES = f"""lines AS (
  SELECT event_id,
    CASE WHEN event_id % 61 = 0 THEN ''
         WHEN event_id % 67 = 0 THEN 'short,row'
         ELSE concat('m', CAST(user_id AS VARCHAR), ',h', CAST(user_id AS VARCHAR), ',',
           CASE WHEN event_id % 101 = 0 THEN substring(CAST(ts AS VARCHAR), 1, 10)
                WHEN event_id % 103 = 0 THEN concat({_TS19.format("ts")}, '+05:00')
                WHEN event_id % 107 = 0 THEN '2013-1-1 5:50:00'
                ELSE {_TS19.format("ts")} END, ',', {_TS19.format(_DROPOFF)}, ',',
           CAST({_TRIP_TIME} AS VARCHAR), ',1.50,',
           CASE WHEN event_id % 50 = 0 THEN '0.000000' WHEN event_id % 71 = 0 THEN 'bad'
                WHEN event_id % 89 = 0 THEN concat(' -73.98', CAST(1000 + event_id % 9000 AS VARCHAR))
                ELSE concat('-73.98', CAST(1000 + event_id % 9000 AS VARCHAR)) END, ',',
           concat('40.75', CAST(1000 + user_id AS VARCHAR)), ',',
           CASE WHEN event_id % 53 = 0 THEN '0.000000'
                ELSE concat('-73.96', CAST(1000 + event_id % 7000 AS VARCHAR)) END, ',',
           concat('40.76', CAST(1000 + event_id % 5000 AS VARCHAR)), ',CSH,',
           CASE WHEN event_id % 73 = 0 THEN concat('  ', CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR), ' ')
                WHEN event_id % 79 = 0 THEN '12.345'
                WHEN event_id % 83 = 0 THEN '12345678901.00'
                ELSE CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) END, ',0.50,0.50,',
           CAST(event_id % 7 AS VARCHAR), '.00,0.00,',
           CAST(CAST(value AS DECIMAL(12,2)) + 1 AS VARCHAR)) END AS line
  FROM events)"""


def _duck_type(dtype) -> str:
    name = dtype.typeName()
    if name == "decimal":
        return f"DECIMAL({dtype.precision},{dtype.scale})"
    return {"integer": "INTEGER", "double": "DOUBLE"}[name]


def _fields(line: str) -> str:
    out = []
    for i, (name, dtype) in enumerate(RAW_FIELDS):
        part = f"string_split({line}, ',')[{i + 1}]"
        if dtype.typeName() == "string":
            part = f"nullif({part}, '')"
        else:
            part = f"TRY_CAST(trim({part}) AS {_duck_type(dtype)})"
        out.append(f"{part} AS {name}")
    return ",\n    ".join(out)


def _datetime(text: str) -> str:
    form = "[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}"
    return f"CASE WHEN regexp_full_match({text}, '{form}') THEN TRY_CAST({text} AS TIMESTAMP) END"


RAW_NAMES = ", ".join(n for n, _ in RAW_FIELDS)

PARSED = f"""parsed AS (
  SELECT event_id,
    {_fields("line")}
  FROM lines WHERE length(line) > 0),
line_trips AS (
  SELECT *, {_datetime("pickup_datetime")} AS pickup_ts, {_datetime("dropoff_datetime")} AS dropoff_ts
  FROM parsed)"""


def _box(lat: str, lon: str) -> str:
    return (
        f"{lon} BETWEEN {_d(C.LON_MIN)} AND {_d(C.LON_MAX)} "
        f"AND {lat} BETWEEN {_d(C.LAT_MIN)} AND {_d(C.LAT_MAX)}"
    )


VALID_PREDICATE = (
    "pickup_longitude <> 0 AND pickup_latitude <> 0 "
    "AND dropoff_longitude <> 0 AND dropoff_latitude <> 0 AND "
    + _box("pickup_latitude", "pickup_longitude")
    + " AND "
    + _box("dropoff_latitude", "dropoff_longitude")
)


def _cell_x(lon: str) -> str:
    return f"CAST(1 + floor(CAST(0.5 AS DOUBLE) + ({lon} - {_d(C.GRID_X0)}) / {_d(LON_STEP)}) AS BIGINT)"


def _cell_y(lat: str) -> str:
    return f"CAST(1 + floor(CAST(0.5 AS DOUBLE) + ({_d(C.GRID_Y0)} - {lat}) / {_d(LAT_STEP)}) AS BIGINT)"


def cell_sql(lat: str, lon: str) -> str:
    return f"(CAST({_cell_x(lon)} AS VARCHAR) || '.' || CAST({_cell_y(lat)} AS VARCHAR))"


def weekday_sql(ts: str) -> str:
    return f"lower(dayname({ts}))"


def hour_sql(ts: str) -> str:
    return f"strftime({ts}, '%H')"


def minute_sql(ts: str) -> str:
    return f"CAST(minute({ts}) AS INTEGER)"


ROUTE = (
    f"{cell_sql('pickup_latitude', 'pickup_longitude')} || '-' || "
    f"{cell_sql('dropoff_latitude', 'dropoff_longitude')}"
)

USABLE = "dropoff_ts IS NOT NULL AND fare_amount IS NOT NULL AND tip_amount IS NOT NULL"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def valid_cte(source: str = "trips") -> str:
    return f"valid AS (SELECT * FROM {source} WHERE {VALID_PREDICATE})"


# --- Q1 building blocks, over a CTE named ``valid`` ---------------------------

ROUTE_KEYS = f"""route_keys AS (
  SELECT {weekday_sql('pickup_ts')} AS weekday, {hour_sql('pickup_ts')} AS hour, {ROUTE} AS route
  FROM valid WHERE pickup_ts IS NOT NULL)"""

ROUTE_COUNTS = """route_counts AS (
  SELECT weekday, hour, route, count(*) AS trip_count FROM route_keys GROUP BY weekday, hour, route)"""

TOP_ROUTES = f"""top_routes AS (
  SELECT * FROM (
    SELECT weekday, hour, route, trip_count,
      CAST(row_number() OVER (PARTITION BY weekday, hour ORDER BY trip_count DESC, route ASC) AS INTEGER) AS rank
    FROM route_counts) WHERE rank <= {C.TOP_N})"""

ROUTES_INDEX = """routes_index AS (
  SELECT weekday, hour, string_agg(route, ',' ORDER BY rank) AS routes FROM top_routes GROUP BY weekday, hour)"""

# --- Q2 building blocks --------------------------------------------------------

DROPOFF_KEYS = f"""dropoff_keys AS (
  SELECT event_id, {weekday_sql('dropoff_ts')} AS weekday, {hour_sql('dropoff_ts')} AS hour,
    {cell_sql('dropoff_latitude', 'dropoff_longitude')} AS cell, {minute_sql('dropoff_ts')} AS minute,
    fare_amount + tip_amount AS revenue
  FROM valid WHERE {USABLE})"""

EMPTY = f"""empty AS (
  SELECT weekday, hour, cell, count(*) AS empty_taxis FROM dropoff_keys
  WHERE minute >= {C.EMPTY_FROM_MINUTE} GROUP BY weekday, hour, cell)"""

MEAN_REVENUE = f"""mean_rev AS (
  SELECT weekday, hour, cell, CAST(sum(revenue) AS DOUBLE) / count(*) AS mean_revenue FROM dropoff_keys
  WHERE minute >= {C.PROFIT_FROM_MINUTE} GROUP BY weekday, hour, cell)"""

PROFIT = """profit AS (
  SELECT e.weekday, e.hour, e.cell, e.empty_taxis, m.mean_revenue,
    m.mean_revenue / e.empty_taxis AS profitability
  FROM empty e JOIN mean_rev m ON e.weekday = m.weekday AND e.hour = m.hour AND e.cell = m.cell)"""

TOP_AREAS = f"""top_areas AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY weekday, hour
                                      ORDER BY profitability DESC, cell ASC) AS INTEGER) AS rank
    FROM profit) WHERE rank <= {C.TOP_N})"""

AREAS_INDEX = """areas_index AS (
  SELECT weekday, hour, string_agg(cell, ',' ORDER BY rank) AS cells FROM top_areas GROUP BY weekday, hour)"""

Q1 = (ROUTE_KEYS, ROUTE_COUNTS, TOP_ROUTES)
Q2 = (DROPOFF_KEYS, EMPTY, MEAN_REVENUE, PROFIT, TOP_AREAS)

_TRIP_COLS = (
    "event_id, medallion, pickup_ts, dropoff_ts, trip_time_in_secs, pickup_longitude, pickup_latitude, "
    "dropoff_longitude, dropoff_latitude, fare_amount, tip_amount"
)

LINE_OUTCOME = f"""CASE WHEN length(line) = 0 THEN 'empty'
       WHEN pickup_ts IS NULL OR dropoff_ts IS NULL OR pickup_longitude IS NULL
         OR pickup_latitude IS NULL OR dropoff_longitude IS NULL OR dropoff_latitude IS NULL
         OR fare_amount IS NULL OR tip_amount IS NULL THEN 'malformed'
       WHEN NOT ({VALID_PREDICATE}) THEN 'outside'
       ELSE 'valid' END"""


# --- Q3 against fixed stands: the mean point of the busiest cells ----------------

_KS = "(SELECT CAST(unnest([" + ", ".join(map(str, C.STAND_KS)) + "]) AS INTEGER) AS k)"

FIXED_CENTRES = f"""cells AS (
  SELECT {cell_sql('pickup_latitude', 'pickup_longitude')} AS cell, count(*) AS n,
    CAST(sum(CAST(floor(pickup_latitude * CAST(1000000 AS DOUBLE)) AS BIGINT)) AS DOUBLE) AS lat,
    CAST(sum(CAST(floor(pickup_longitude * CAST(1000000 AS DOUBLE)) AS BIGINT)) AS DOUBLE) AS lon
  FROM valid GROUP BY 1),
ranked AS (
  SELECT CAST(row_number() OVER (ORDER BY n DESC, cell) - 1 AS INTEGER) AS stand_id,
    lat / n / CAST(1000000 AS DOUBLE) AS latitude, lon / n / CAST(1000000 AS DOUBLE) AS longitude
  FROM cells),
centres AS (SELECT k, stand_id, latitude, longitude FROM ranked, {_KS} WHERE stand_id < k)"""

NEAREST = """costs AS (
  SELECT event_id, k, stand_id,
    (pickup_latitude - latitude) * (pickup_latitude - latitude)
      + (pickup_longitude - longitude) * (pickup_longitude - longitude) AS sq
  FROM valid, centres),
nearest AS (
  SELECT event_id, k, min(sq) AS sq, min_by(stand_id, (sq, stand_id)) AS stand_id FROM costs GROUP BY event_id, k)"""

SUM_COST = "CAST(sum(CAST(floor(sq * CAST(1e12 AS DOUBLE)) AS BIGINT)) AS DOUBLE) / CAST(1e12 AS DOUBLE)"


def statements() -> dict[str, str]:
    """Oracle SQL keyed like :func:`cabgrid.plans.catalog.queries`."""
    ev = _with(TRIPS, valid_cte())
    q = {}
    q["valid_trips"] = ev + f"SELECT {_TRIP_COLS} FROM valid"
    q["grid_cells"] = ev + (
        f"SELECT event_id, {cell_sql('pickup_latitude', 'pickup_longitude')} AS pickup_cell, "
        f"{cell_sql('dropoff_latitude', 'dropoff_longitude')} AS dropoff_cell FROM valid"
    )
    q["trip_routes"] = ev + (
        f"SELECT event_id, {weekday_sql('pickup_ts')} AS weekday, {hour_sql('pickup_ts')} AS hour, "
        f"{ROUTE} AS route FROM valid"
    )
    q["trip_time_parts"] = _with(TRIPS) + (
        f"SELECT event_id, {weekday_sql('pickup_ts')} AS pickup_weekday, {hour_sql('pickup_ts')} AS pickup_hour, "
        f"{weekday_sql('dropoff_ts')} AS dropoff_weekday, {hour_sql('dropoff_ts')} AS dropoff_hour, "
        f"{minute_sql('dropoff_ts')} AS dropoff_minute FROM trips"
    )
    q["last_half_hour_dropoffs"] = ev + (
        f"SELECT {_TRIP_COLS} FROM valid WHERE {minute_sql('dropoff_ts')} >= {C.EMPTY_FROM_MINUTE}"
    )
    q["last_quarter_hour_dropoffs"] = ev + (
        f"SELECT {_TRIP_COLS} FROM valid WHERE {minute_sql('dropoff_ts')} >= {C.PROFIT_FROM_MINUTE}"
    )
    q["trip_revenue"] = _with(TRIPS, valid_cte(), DROPOFF_KEYS) + (
        "SELECT event_id, weekday, hour, cell, minute, revenue FROM dropoff_keys"
    )
    q["route_counts"] = _with(TRIPS, valid_cte(), ROUTE_KEYS, ROUTE_COUNTS) + "SELECT * FROM route_counts"
    q["top_routes"] = _with(TRIPS, valid_cte(), *Q1) + "SELECT * FROM top_routes"
    q["top_routes_index"] = _with(TRIPS, valid_cte(), *Q1, ROUTES_INDEX) + "SELECT * FROM routes_index"
    q["route_preview"] = q["top_routes_index"] + " ORDER BY weekday, hour LIMIT 2"
    q["empty_taxis"] = _with(TRIPS, valid_cte(), DROPOFF_KEYS, EMPTY) + "SELECT * FROM empty"
    q["mean_revenue"] = _with(TRIPS, valid_cte(), DROPOFF_KEYS, MEAN_REVENUE) + "SELECT * FROM mean_rev"
    profit = _with(TRIPS, valid_cte(), DROPOFF_KEYS, EMPTY, MEAN_REVENUE, PROFIT) + "SELECT * FROM profit"
    q["area_profitability_join"] = profit
    q["area_profitability"] = profit
    q["profitable_areas"] = _with(TRIPS, valid_cte(), *Q2) + "SELECT * FROM top_areas"
    q["profitable_areas_index"] = _with(TRIPS, valid_cte(), *Q2, AREAS_INDEX) + "SELECT * FROM areas_index"
    q["area_preview"] = q["profitable_areas_index"] + " ORDER BY weekday, hour LIMIT 10"
    q["stand_points"] = ev + (
        "SELECT event_id, pickup_latitude AS latitude, pickup_longitude AS longitude FROM valid"
    )

    fixed = _with(TRIPS, valid_cte(), FIXED_CENTRES)
    q["fixed_stand_centres"] = fixed + "SELECT k, stand_id, latitude, longitude FROM centres"
    near = _with(TRIPS, valid_cte(), FIXED_CENTRES, NEAREST)
    q["fixed_stand_assignment"] = near + (
        f"SELECT k, stand_id, count(*) AS trips, {SUM_COST} AS sse FROM nearest GROUP BY k, stand_id"
    )
    q["fixed_stand_sse"] = near + f"SELECT k, {SUM_COST} AS sse FROM nearest GROUP BY k"
    line = "printf('%.8f,%.8f', latitude, longitude) AS line"
    q["fixed_stand_lines"] = fixed + f"SELECT k, stand_id, {line} FROM centres"
    q["fixed_stand_files"] = fixed + f"SELECT k, {line} FROM centres"
    q["stand_sweep_facts"] = ev + (
        f"SELECT k, CAST(k AS BIGINT) AS stands, (SELECT count(*) FROM valid) AS trips, true AS all_nearest, "
        f"true AS no_worse_than_one FROM {_KS}"
    )

    # Raw text lines.
    lines = _with(LINES, PARSED)
    line_cols = RAW_NAMES + ", pickup_ts, dropoff_ts"
    q["parse_trip_lines"] = lines + f"SELECT {line_cols} FROM line_trips"
    cell = "CASE WHEN {0}_latitude IS NOT NULL AND {0}_longitude IS NOT NULL THEN {1} END AS {0}_cell"
    q["trip_rows_from_lines"] = lines + (
        "SELECT pickup_datetime, dropoff_datetime, trip_time_in_secs, trip_distance, pickup_longitude, "
        "pickup_latitude, dropoff_longitude, dropoff_latitude, fare_amount, tip_amount, total_amount, "
        + cell.format("pickup", cell_sql("pickup_latitude", "pickup_longitude")) + ", "
        + cell.format("dropoff", cell_sql("dropoff_latitude", "dropoff_longitude"))
        + ", medallion AS taxi_id FROM parsed"
    )
    q["filter_trip_lines"] = lines + f"SELECT {line_cols} FROM line_trips WHERE {VALID_PREDICATE}"
    q["trip_line_outcomes"] = _with(
        LINES,
        PARSED,
        "outcomes AS (SELECT "
        + LINE_OUTCOME
        + " AS outcome FROM lines l LEFT JOIN line_trips t USING (event_id))",
    ) + "SELECT outcome, count(*) AS lines FROM outcomes GROUP BY outcome"
    q["top_routes_from_lines"] = _with(LINES, PARSED, valid_cte("line_trips"), *Q1) + "SELECT * FROM top_routes"
    q["profitable_areas_from_lines"] = (
        _with(LINES, PARSED, valid_cte("line_trips"), *Q2) + "SELECT * FROM top_areas"
    )
    q["top_routes_streaming"] = q["top_routes_from_lines"]
    q["profitable_areas_streaming"] = q["profitable_areas_from_lines"]
    q["text_roundtrip"] = lines + f"SELECT {RAW_NAMES} FROM parsed"
    q["csv_roundtrip"] = lines + f"SELECT {RAW_NAMES} FROM parsed"
    q["route_index_roundtrip"] = q["top_routes_index"]
    q["area_index_roundtrip"] = q["profitable_areas_index"]
    return q
