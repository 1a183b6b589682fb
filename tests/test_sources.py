"""Raw record sources on a hand-written file with faulty lines."""

import os

from cabgrid.functions import valid_trips
from cabgrid.operators import top_routes
from cabgrid.sources import read_trip_csv, read_trips_csv, read_trips_text
from cabgrid.sources.text import line_outcomes

GOOD = (
    "a,b,2013-01-01 00:00:00,2013-01-01 00:02:00,120,0.44,-73.956528,40.716976,"
    "-73.962440,40.715008,CSH,3.50,0.50,0.50,0.00,0.00,4.50"
)
LINES = [
    GOOD,
    "",
    "short,row",
    "   ",
    GOOD.replace("-73.956528", "abc"),
    GOOD.replace("-73.956528,40.716976", "0,0"),
    GOOD.replace("40.715008", "42.5"),
    GOOD.replace(",120,", ",soon,"),
]


def _write(path):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "trips.csv"), "w") as f:
        f.write("\n".join(LINES) + "\n")
    return path


def test_csv_reader_keeps_bad_fields_as_null(spark, scratch):
    path = _write(scratch)
    raw = read_trip_csv(spark, path)
    assert raw.count() == 6  # empty and blank lines are skipped
    short = raw.where("medallion = 'short'").first()
    assert short.hack_license == "row" and short.pickup_longitude is None


def test_csv_and_text_agree_on_valid_trips(spark, scratch):
    path = _write(scratch)
    for read in (read_trips_csv, read_trips_text):
        kept = valid_trips(read(spark, path)).orderBy("trip_time_in_secs").collect()
        assert len(kept) == 2, read.__name__
        assert kept[0].trip_time_in_secs is None and kept[1].trip_time_in_secs == 120
        assert str(kept[1].fare_amount) == "3.500000"


def test_route_of_the_good_line(spark, scratch):
    path = _write(scratch)
    got = top_routes(valid_trips(read_trips_csv(spark, path))).collect()
    assert [(r.weekday, r.hour, r.trip_count, r.rank) for r in got] == [("tuesday", "00", 2, 1)]


def test_line_outcomes(spark, scratch):
    path = _write(scratch)
    lines = spark.read.text(path)
    counts = {r.outcome: r["count"] for r in line_outcomes(lines).groupBy("outcome").count().collect()}
    assert counts == {"valid": 2, "empty": 1, "malformed": 3, "outside": 2}


def test_text_ignores_quotes_csv_honours_them(spark, scratch):
    from cabgrid.sources import parse_trip_lines, read_trip_records_text

    quoted = '"m,1",' + GOOD.split(",", 1)[1] + ",extra"
    os.makedirs(scratch, exist_ok=True)
    with open(os.path.join(scratch, "q.csv"), "w") as f:
        f.write(quoted + "\n")
    text = read_trip_records_text(spark, scratch).first()
    split = parse_trip_lines(spark.read.text(scratch)).first()
    # plain comma split, as the original text path: the quote is just a character
    assert (text.medallion, text.hack_license) == ('"m', '1"') == (split.medallion, split.hack_license)
    assert text.pickup_longitude == split.pickup_longitude == 0.44  # shifted by one field
    csv = read_trip_csv(spark, scratch).first()
    assert csv.medallion == "m,1" and csv.pickup_longitude == -73.956528


ODD = [
    GOOD.replace(",3.50,", ",  3.50 ,").replace(",-73.956528,", ", -73.956528  ,").replace(",120,", ", 120 ,"),
    GOOD.replace(",3.50,", ",12.345,"),
    GOOD.replace(",3.50,", ",12345678901.00,"),
    GOOD.replace(",3.50,", ",1" + "0" * 20 + ","),
    GOOD.replace("2013-01-01 00:00:00", "2013-01-01"),
    GOOD.replace("2013-01-01 00:00:00", "2013-01-01 00:00:00+05:00"),
    GOOD.replace("2013-01-01 00:00:00", "2013-1-1 5:50:00"),
    GOOD.replace("2013-01-01 00:00:00", "2013-13-01 00:00:00"),
    GOOD.replace("a,b,", ",,"),
    GOOD.replace(",3.50,", ",,"),
]


def test_all_readers_agree_on_odd_fields(spark, scratch):
    from cabgrid.sources import parse_trip_lines, trips_from_records
    from cabgrid.streaming import stream_trips

    os.makedirs(scratch, exist_ok=True)
    with open(os.path.join(scratch, "odd.csv"), "w") as f:
        f.write("\n".join(ODD) + "\n")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    split = rows(trips_from_records(parse_trip_lines(spark.read.text(scratch))))
    assert rows(read_trips_text(spark, scratch)) == split == rows(read_trips_csv(spark, scratch))
    got = []
    for fmt in ("text", "csv"):
        query = stream_trips(spark, scratch, fmt).writeStream.format("memory").queryName(f"odd_{fmt}")
        query.trigger(availableNow=True).start().awaitTermination()
        got.append(rows(spark.table(f"odd_{fmt}")))
    assert got == [split, split]

    fares = {str(r.fare_amount) for r in read_trips_text(spark, scratch).collect()}
    assert fares == {"3.500000", "12.345000", "12345678901.000000", "None"}
    assert read_trips_text(spark, scratch).where("pickup_ts IS NULL").count() == 4
    counts = {r.outcome: r["count"] for r in line_outcomes(spark.read.text(scratch)).groupBy("outcome").count().collect()}
    assert counts == {"valid": 4, "malformed": 6}


def test_coordinates_are_parsed_in_the_scan_once(spark, scratch):
    """Odd spellings of numbers mean the same in the scan and in split lines."""
    from cabgrid.sources import parse_trip_lines

    odd = ["1e2", " 1.5", "1.5 ", "\t1.5", "+1.5", "1.5d", "1.5f", ".5", "5.", "0x1p3", "1,5", "--1", "1 5", " ", "-73.956528"]
    os.makedirs(scratch, exist_ok=True)
    with open(os.path.join(scratch, "odd.csv"), "w") as f:
        f.write("\n".join(GOOD.replace("-73.956528", v) for v in odd) + "\n")
    seen = lambda df: sorted((r.pickup_longitude for r in df.select("pickup_longitude").collect()), key=str)
    split = seen(parse_trip_lines(spark.read.text(scratch)))
    assert seen(read_trips_text(spark, scratch)) == split == seen(read_trips_csv(spark, scratch))
    assert 1.5 in split and None in split

    plan = valid_trips(read_trips_text(spark, scratch)).select("pickup_longitude")._jdf.queryExecution().toString()
    optimized = plan[plan.index("== Optimized") :]
    assert "try_cast" not in optimized and "IsNotNull(pickup_longitude)" in optimized


def test_numbers_that_are_not_finite_are_outside(spark, scratch):
    from cabgrid.sources import parse_trip_lines

    lines = [GOOD.replace("-73.956528", v) for v in ("inf", "Inf", "-Infinity", "NaN", "nan")] + [GOOD]
    os.makedirs(scratch, exist_ok=True)
    with open(os.path.join(scratch, "odd.csv"), "w") as f:
        f.write("\n".join(lines) + "\n")
    for df in (parse_trip_lines(spark.read.text(scratch)), read_trips_text(spark, scratch), read_trips_csv(spark, scratch)):
        assert [r.pickup_longitude for r in valid_trips(df).collect()] == [-73.956528]


def test_trip_rows_have_cells_and_taxi(spark, scratch):
    from cabgrid.sources import trip_rows

    got = trip_rows(spark.read.text(_write(scratch))).collect()
    assert len(got[0]) == 14 and got[0].taxi_id == "a"
    assert got[0].pickup_cell == "161.170" and got[0].dropoff_cell == "160.170"
    bad = [r for r in got if r.pickup_longitude is None]
    assert bad and all(r.pickup_cell is None for r in bad)


def test_every_text_field_is_parsed_once(spark, tmp_path):
    from conftest import plan_text

    from cabgrid.plans import frequent_routes, profitable_areas

    path = _write(str(tmp_path / "in"))
    fields = {frequent_routes: ["pickup_datetime"], profitable_areas: ["dropoff_datetime", "fare_amount", "tip_amount"]}
    for question, parsed in fields.items():
        for read in (read_trips_text, read_trips_csv):
            plan = plan_text(question(read(spark, path)), "extended")
            logical = plan.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
            assert logical.count("try_cast(") == len(parsed)
            for name in parsed:
                assert logical.count(f"try_cast({name}#") + logical.count(f"try_cast(trim({name}#") == 1
            # the coordinates still reach the scan
            pushed = [ln for ln in plan.splitlines() if "PushedFilters" in ln]
            assert pushed and "IsNotNull(pickup_longitude)" in pushed[0]
