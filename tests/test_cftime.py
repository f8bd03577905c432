import random
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from labarr.functions import cftime as C


def iso(x):
    return C.iso(x) if isinstance(x, datetime) else x


@pytest.mark.parametrize(
    ("value", "units", "calendar", "expected"),
    [
        (60, "days since 2000-01-01", "noleap", "2000-03-02T00:00:00.000Z"),
        (60, "days since 2000-01-01", "NOLEAP", "2000-03-02T00:00:00.000Z"),
        (59, "days since 2000-01-01", "360_day", "2000-02-30T00:00:00"),
        (31, "days since 1582-10-01", "standard", "1582-11-11T00:00:00.000Z"),
        (3, "days since 1582-10-01", "standard", "1582-10-04T00:00:00.000Z"),
        (4, "days since 1582-10-01", "gregorian", "1582-10-15T00:00:00.000Z"),
        (0, "days since 1582-10-10", "standard", None),
        (1, "months since 2000-01-01", "noleap", None),
        (1, "years since 2000-01-01", "360_day", None),
        (0, "seconds since 2000-01-01T00:00:00.9995", "standard", "2000-01-01T00:00:00.999500"),
        (0, "seconds since 2000-01-01T00:00:00.5", "standard", "2000-01-01T00:00:00.500Z"),
        (0.0015, "seconds since 2000-01-01", "standard", "2000-01-01T00:00:00.001500"),
        (1500, "microseconds since 2000-01-01", "standard", "2000-01-01T00:00:00.001500"),
        (1, "ms since 2000-01-01", "standard", "2000-01-01T00:00:00.001Z"),
        (0, "h since 2000-01-01 00:00:00 -06", "standard", "2000-01-01T06:00:00.000Z"),
        (0, "days since 2000-01-01 00:00:00 garbage", "standard", None),
        (float("nan"), "days since 2000-01-01", "standard", None),
        (1, "days since 2000-01-01", "lunar", None),
        (59, "days since 1850-01-01", "all_leap", "1850-02-29T00:00:00"),
    ],
)
def test_decode(value, units, calendar, expected):
    assert iso(C.decode(value, units, calendar)) == expected


def test_default_calendars_differ():
    assert iso(C.decode(1, "days since 1582-10-04")) == "1582-10-15T00:00:00.000Z"
    assert iso(C.cf_time_to_date(1, "days since 1582-10-04")) == "1582-10-05T00:00:00.000Z"
    assert C.cf_time_to_date(59, "days since 2000-01-01", "360_day") is None


def test_encode_inverts():
    assert C.encode("1582-10-15", "days since 1582-10-01") == 4
    for cal in set(C.CALENDARS.values()):
        for v in (-1000, 0, 58, 59, 60, 12345.25):
            back = C.decode(v, "days since 2001-03-01", cal)
            assert C.encode(back, "days since 2001-03-01", cal) == v
    assert C.encode("2021-02-30", "days since 2000-01-01") is None


def test_units():
    assert C.parse_cf_time_units("hours since 1990-01-01T00:00:00Z")["unit"] == "hour"
    assert C.parse_cf_time_units("DAYS since 2000-01-01")["reference_date"] == datetime(2000, 1, 1, tzinfo=timezone.utc)
    assert C.parse_cf_time_units("days since 2000-01-01 12:00:00 +630")["reference_date"] == datetime(2000, 1, 1, 5, 30, tzinfo=timezone.utc)
    for bad in ("days", "furlongs since 2000-01-01", "days since nothing", ""):
        assert C.parse_cf_time_units(bad) is None
    assert C.unit_of("wks") == "week" and C.unit_of("ss") is None


def test_day_numbers_agree_with_python_dates_and_invert():
    rng = random.Random(1)
    for _ in range(3000):
        d = date.fromordinal(rng.randrange(1, 3_000_000))
        assert C.day_number(d.year, d.month, d.day, "proleptic_gregorian") == (d - date(1970, 1, 1)).days
        n = rng.randrange(-800_000, 800_000)
        for cal in set(C.CALENDARS.values()):
            assert C.day_number(*C.date_of(n, cal), cal) == n


def test_display():
    assert C.format_coordinate(60, {"units": "days since 2000-01-01", "calendar": "noleap"}) == "2000-03-02T00:00:00"
    assert C.format_coordinate(59, {"units": "days since 2000-01-01", "calendar": "360_day"}) == "2000-02-30T00:00:00"
    assert C.format_coordinate(1, {"units": "months since 2000-01-01"}) == "1"
    assert C.format_date(datetime(2021, 5, 6, 7, 8, 9), False) == "2021-05-06"
    assert C.is_time({"units": "hours since 2000-01-01"}) and C.is_time({"standard_name": "Time"}) and not C.is_time({}) and not C.is_time(None)


def test_columns_equal_the_python_versions(spark):
    rng = random.Random(2)
    units = [("days since 1582-10-01", 400.0), ("hours since 2000-02-28 12:30:00", 1e6), ("seconds since 1970-01-01", 1e9), ("microseconds since 2000-01-01", 1e7), ("days since 0004-01-01", 9e5)]
    for calendar in sorted(set(C.CALENDARS.values())):
        for unit, most in units:
            values = [float(rng.randrange(int(-most), int(most))) for _ in range(20)] + [0.0, 0.25, float("nan"), float("inf"), None]
            df = spark.createDataFrame([(v,) for v in values], "v double")
            got = [r[0] for r in df.select(C.decode_column(F.col("v"), unit, calendar)).collect()]
            for v, text in zip(values, got, strict=True):
                us = None if v is None else C.micros(v, unit, calendar)
                assert text == (None if us is None else C.text_of(us, C.calendar_of(calendar))), (calendar, unit, v)


def test_encode_column(spark):
    days = [datetime(1990, 1, 1) + timedelta(days=37 * i, hours=i) for i in range(60)]
    df = spark.createDataFrame([(d,) for d in days], "t timestamp")
    for calendar in sorted(set(C.CALENDARS.values())):
        got = [r[0] for r in df.select(C.encode_column(F.col("t"), "hours since 1995-01-01", calendar)).collect()]
        want = [C.encode(d.replace(tzinfo=timezone.utc), "hours since 1995-01-01", calendar) for d in days]
        assert got == pytest.approx(want) if None not in want else [g is None for g in got] == [w is None for w in want]
