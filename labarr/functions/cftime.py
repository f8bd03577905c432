"""CF time: units, calendars, decoding and encoding, as Python values and as Columns.

Instants are counted in microseconds of a calendar's own days, so that dates which other
calendars lack (30 February of 360_day) keep their place.
"""

from __future__ import annotations

import math
import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000
#: Names of units and their microseconds.
UNITS = (
    (("microsecond", "microsec", "usec", "us"), "microsecond", 1),
    (("millisecond", "millisec", "msec", "ms"), "millisecond", 1_000),
    (("second", "sec", "s"), "second", 1_000_000),
    (("minute", "min"), "minute", 60_000_000),
    (("hour", "hr", "h"), "hour", 3_600_000_000),
    (("day", "d"), "day", DAY),
    (("week", "wk"), "week", 7 * DAY),
    (("month", "mon"), "month", None),
    (("year", "yr"), "year", None),
)
_ONLY_ONE = {"us", "ms", "s", "h", "d"}  # symbols have no plural
#: Names of calendars.
CALENDARS = {"standard": "standard", "gregorian": "standard", "proleptic_gregorian": "proleptic_gregorian", "julian": "julian", "noleap": "noleap", "365_day": "noleap", "all_leap": "all_leap", "366_day": "all_leap", "360_day": "360_day"}
_MONTHS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
_DATE = re.compile(r"([+-]?\d{1,6})-(\d{1,2})-(\d{1,2})(?:[Tt ]\s*(\d{1,2})(?::(\d{1,2})(?::(\d{1,2})(?:\.(\d+))?)?)?)?\s*([Zz]|[+-]\d{1,2}(?::?\d{2})?)?")
#: First Gregorian day of the standard calendar, as a day number from 1970-01-01.
CUTOVER = -141427


def unit_of(name: str) -> str | None:
    name = name.lower()
    for names, unit, _ in UNITS:
        if name in names or (name[-1:] == "s" and name[:-1] in names and name[:-1] not in _ONLY_ONE):
            return unit
    return None


def calendar_of(name: str | None) -> str | None:
    return CALENDARS.get((name or "standard").lower())


def unit_micros(unit: str, calendar: str) -> int | None:
    """Microseconds of a unit; a month lasts 30 days in 360_day only, a year is never fixed."""
    if unit == "month":
        return 30 * DAY if calendar == "360_day" else None
    return next(us for _, u, us in UNITS if u == unit)


def leap(year: int, calendar: str) -> bool:
    if calendar in ("noleap", "all_leap"):
        return calendar == "all_leap"
    if calendar == "julian" or (calendar == "standard" and year < 1582):
        return year % 4 == 0
    return year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)


def valid_date(y: int, m: int, d: int, calendar: str) -> bool:
    if not 1 <= m <= 12:
        return False
    if calendar == "360_day":
        return 1 <= d <= 30
    if calendar == "standard" and (y, m) == (1582, 10) and 5 <= d <= 14:
        return False
    return 1 <= d <= _MONTHS[m - 1] + (m == 2 and leap(y, calendar))


def _civil(y: int, m: int, d: int, julian: bool) -> int:
    """Days from 1970-01-01 of a Gregorian (or Julian) date, in years that begin in March."""
    y, m = (y, m - 3) if m > 2 else (y - 1, m + 9)
    n = 365 * y + y // 4 + (153 * m + 2) // 5 + d - 1
    return n - 719470 if julian else n - y // 100 + y // 400 - 719468


def _uncivil(n: int, julian: bool) -> tuple[int, int, int]:
    if julian:
        n += 719470
        cycle, day = divmod(n, 1461)
        of = min(day // 365, 3)
        y, day = 4 * cycle + of, day - 365 * of
    else:
        n += 719468
        era, day = divmod(n, 146097)
        of = (day - day // 1460 + day // 36524 - day // 146096) // 365
        y, day = 400 * era + of, day - (365 * of + of // 4 - of // 100)
    m = (5 * day + 2) // 153
    return (y + (m > 9), m + 3 if m < 10 else m - 9, day - (153 * m + 2) // 5 + 1)


def day_number(y: int, m: int, d: int, calendar: str) -> int:
    """Days of the calendar: from 1970-01-01 for real ones, from year 0 for regular ones."""
    if calendar == "360_day":
        return 360 * y + 30 * (m - 1) + d - 1
    if calendar in ("noleap", "all_leap"):
        months = [x + (k == 1 and calendar == "all_leap") for k, x in enumerate(_MONTHS)]
        return sum(months) * y + sum(months[: m - 1]) + d - 1
    julian = calendar == "julian" or (calendar == "standard" and (y, m, d) < (1582, 10, 15))
    return _civil(y, m, d, julian)


def date_of(n: int, calendar: str) -> tuple[int, int, int]:
    if calendar == "360_day":
        return n // 360, n % 360 // 30 + 1, n % 30 + 1
    if calendar in ("noleap", "all_leap"):
        months = [x + (k == 1 and calendar == "all_leap") for k, x in enumerate(_MONTHS)]
        y, day = divmod(n, sum(months))
        m = 0
        while day >= months[m]:
            day, m = day - months[m], m + 1
        return y, m + 1, day + 1
    return _uncivil(n, calendar == "julian" or (calendar == "standard" and n < CUTOVER))


def parse_label(text: str, calendar: str = "proleptic_gregorian") -> int | None:
    """Microseconds of the calendar of a date label, UTC unless it has an offset; None if
    it is no date of the calendar or has anything else in it."""
    found = _DATE.fullmatch(text.strip())
    if not found:
        return None
    y, m, d = (int(x) for x in found.group(1, 2, 3))
    h, mi, s = (int(x or 0) for x in found.group(4, 5, 6))
    if not valid_date(y, m, d, calendar) or h > 23 or mi > 59 or s > 59:
        return None
    us = int((found[7] or "").ljust(6, "0")[:6] or 0)
    offset = 0
    if found[8] and found[8] not in "Zz":
        digits = found[8][1:].replace(":", "")
        hours, minutes = (int(digits), 0) if len(digits) <= 2 else (int(digits[:-2]), int(digits[-2:]))
        if hours > 23 or minutes > 59:
            return None
        offset = (hours * 60 + minutes) * 60_000_000 * (-1 if found[8][0] == "-" else 1)
    return day_number(y, m, d, calendar) * DAY + ((h * 60 + mi) * 60 + s) * 1_000_000 + us - offset


def parse_units(units: str) -> tuple[str, str] | None:
    """(unit, reference text) of "<unit> since <reference>"."""
    found = re.fullmatch(r"\s*([A-Za-z]+)\s+since\s+(.+?)\s*", units or "", re.IGNORECASE)
    unit = unit_of(found[1]) if found else None
    return (unit, found[2]) if unit else None


def parse_cf_time_units(units: str) -> dict | None:
    """{unit, reference_date} with an aware datetime; None if not understood."""
    got = parse_units(units)
    at = parse_label(got[1]) if got else None
    when = _datetime(at) if at is not None else None
    return None if when is None else {"unit": got[0], "reference_date": when}


def _datetime(us: int) -> datetime | None:
    try:
        return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us)
    except OverflowError:
        return None


def _scale(units: str, calendar: str | None) -> tuple[str, int, int] | None:
    """Calendar, microseconds of the unit and of the reference."""
    cal, got = calendar_of(calendar), parse_units(units)
    if cal is None or got is None:
        return None
    each, at = unit_micros(got[0], cal), parse_label(got[1], cal)
    return None if each is None or at is None else (cal, each, at)


def micros(value: float, units: str, calendar: str | None = "standard") -> int | None:
    """Microseconds of the calendar that a number of units since a reference means."""
    scale = _scale(units, calendar)
    if scale is None or not math.isfinite(value):
        return None
    _, each, at = scale
    whole = math.floor(value)
    # whole units exactly; the fraction to the nearest microsecond
    return at + whole * each + math.floor((value - whole) * each + 0.5)


def text_of(us: int, calendar: str) -> str:
    y, m, d = date_of(us // DAY, calendar)
    rest = us % DAY
    h, mi, s, f = rest // 3_600_000_000, rest // 60_000_000 % 60, rest // 1_000_000 % 60, rest % 1_000_000
    sign = "-" if y < 0 else ""
    return f"{sign}{abs(y):04d}-{m:02d}-{d:02d}T{h:02d}:{mi:02d}:{s:02d}" + (f".{f:06d}" if f else "")


def decode(value: float, units: str, calendar: str | None = "standard") -> datetime | str | None:
    """An aware datetime where the date exists in the Gregorian calendar and is in whole
    milliseconds, else its text; None if it can not be decoded."""
    us = micros(value, units, calendar)
    if us is None:
        return None
    cal = calendar_of(calendar)
    text = text_of(us, cal)
    same = parse_label(text)
    if us % 1000 == 0 and same is not None and (when := _datetime(same)) is not None:
        return when
    return text


def encode(value: datetime | str, units: str, calendar: str | None = "standard") -> float | None:
    """The number of units since the reference; texts are read in the calendar itself."""
    scale = _scale(units, calendar)
    if scale is None:
        return None
    cal, each, at = scale
    us = parse_label(iso_micros(value) if isinstance(value, datetime) else value, cal)
    return None if us is None else (us - at) / each


def cf_time_to_date(value: float, units: str, calendar: str | None = "proleptic_gregorian") -> datetime | None:
    got = decode(value, units, calendar)
    return got if isinstance(got, datetime) else None


def iso(when: datetime) -> str:
    """ISO text with milliseconds and Z; zone-less datetimes are UTC."""
    when = (when if when.tzinfo else when.replace(tzinfo=timezone.utc)).astimezone(timezone.utc)
    return f"{when.year:04d}-" + when.strftime("%m-%dT%H:%M:%S.") + f"{when.microsecond // 1000:03d}Z"


def iso_micros(when: datetime) -> str:
    """ISO text with microseconds and Z."""
    return iso(when)[:19] + f".{when.microsecond:06d}Z"


def format_date(when: datetime, include_time: bool = True) -> str:
    return iso(when)[:19] if include_time else iso(when)[:10]


def is_time(attrs: dict | None) -> bool:
    text = lambda k: str((attrs or {}).get(k) or "").lower()
    return text("standard_name") == "time" or text("long_name") == "time" or "since" in text("units")


def format_coordinate(value, attrs: dict | None = None) -> str:
    if isinstance(value, datetime):
        return format_date(value)
    if isinstance(value, (int, float)) and not isinstance(value, bool) and attrs and is_time(attrs) and attrs.get("units"):
        got = decode(float(value), attrs["units"], attrs.get("calendar") or "standard")
        if got is not None:
            return format_date(got) if isinstance(got, datetime) else got
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


# --- the same on columns: integer arithmetic in the JVM, no Python -----------------------


def micros_column(value: Column, units: str, calendar: str | None = "standard") -> Column:
    """As ``micros``; null where the value is null or not finite, or the units are unknown."""
    scale = _scale(units, calendar)
    if scale is None:
        return F.lit(None).cast("long")
    _, each, at = scale
    v = value.cast("double")
    whole = F.floor(v)
    us = F.lit(at) + whole * F.lit(each).cast("long") + F.floor((v - whole) * float(each) + 0.5)
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None).cast("long")).otherwise(us)


def _div(a: Column, b: int) -> Column:
    """Integer division towards minus infinity."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ymd(y: Column, m: Column, d: Column) -> Column:
    return F.struct(y.cast("long").alias("y"), m.cast("long").alias("m"), d.cast("long").alias("d"))


def date_column(day: Column, calendar: str) -> Column:
    """struct<y, m, d> of a column of day numbers (see ``day_number``)."""
    if calendar == "360_day":
        return _let(day, lambda n: _ymd(_div(n, 360), _div(F.pmod(n, F.lit(360)), 30) + 1, F.pmod(n, F.lit(30)) + 1))
    if calendar in ("noleap", "all_leap"):
        months = [x + (k == 1 and calendar == "all_leap") for k, x in enumerate(_MONTHS)]
        ends = F.array(*(F.lit(sum(months[:k])) for k in range(12)))

        def regular(n: Column) -> Column:
            of = F.pmod(n, F.lit(sum(months)))
            return _let(F.size(F.filter(ends, lambda e: e <= of)), lambda m: _ymd(_div(n, sum(months)), m, of - F.get(ends, m - 1) + 1))

        return _let(day, regular)

    def gregorian(n: Column) -> Column:
        return _let(n + 719468, lambda k: _let(F.struct(_div(k, 146097).alias("era"), F.pmod(k, F.lit(146097)).alias("of")), lambda e: _let(F.struct(e["era"].alias("era"), e["of"].alias("of"), _div(e["of"] - _div(e["of"], 1460) + _div(e["of"], 36524) - _div(e["of"], 146096), 365).alias("year")), lambda x: _march(x["era"] * 400 + x["year"], x["of"] - (x["year"] * 365 + _div(x["year"], 4) - _div(x["year"], 100))))))

    def julian(n: Column) -> Column:
        return _let(n + 719470, lambda k: _let(F.struct(_div(k, 1461).alias("era"), F.pmod(k, F.lit(1461)).alias("of")), lambda x: _march(x["era"] * 4 + F.least(_div(x["of"], 365), F.lit(3)), x["of"] - F.least(_div(x["of"], 365), F.lit(3)) * 365)))

    if calendar == "standard":
        return _let(day, lambda n: F.when(n < CUTOVER, julian(n)).otherwise(gregorian(n)))
    return julian(day) if calendar == "julian" else gregorian(day)


def _march(year: Column, of: Column) -> Column:
    """Date of a day in a year that begins in March."""
    return _let(F.struct(year.alias("y"), of.alias("of"), _div(of * 5 + 2, 153).alias("m")), lambda x: _ymd(x["y"] + (x["m"] > 9).cast("int"), F.when(x["m"] < 10, x["m"] + 3).otherwise(x["m"] - 9), x["of"] - _div(x["m"] * 153 + 2, 5) + 1))


def decode_column(value: Column, units: str, calendar: str | None = "standard") -> Column:
    """The text of ``text_of`` for each value; null where ``decode`` gives None."""
    cal = calendar_of(calendar)
    if cal is None or _scale(units, calendar) is None:
        return F.lit(None).cast("string")
    pad = lambda c, n: F.lpad(c.cast("long").cast("string"), n, "0")

    def text(us: Column) -> Column:
        rest, fraction = F.pmod(us, F.lit(DAY)), F.pmod(us, F.lit(1_000_000))
        clock = F.concat_ws(":", pad(_div(rest, 3_600_000_000), 2), pad(F.pmod(_div(rest, 60_000_000), F.lit(60)), 2), pad(F.pmod(_div(rest, 1_000_000), F.lit(60)), 2))

        def whole(x: Column) -> Column:
            year = F.concat(F.when(x["y"] < 0, F.lit("-")).otherwise(F.lit("")), F.when(F.abs(x["y"]) > 9999, F.abs(x["y"]).cast("string")).otherwise(pad(F.abs(x["y"]), 4)))
            return F.concat(year, F.lit("-"), pad(x["m"], 2), F.lit("-"), pad(x["d"], 2), F.lit("T"), clock, F.when(fraction > 0, F.concat(F.lit("."), pad(fraction, 6))).otherwise(F.lit("")))

        return F.when(us.isNotNull(), _let(date_column(_div(us, DAY), cal), whole))

    return _let(micros_column(value, units, calendar), text)


def encode_column(when: Column, units: str, calendar: str | None = "proleptic_gregorian") -> Column:
    """Units since the reference of a timestamp column, by its Gregorian date and time."""
    scale = _scale(units, calendar)
    if scale is None:
        return F.lit(None).cast("double")
    cal, each, at = scale
    y, m, d = F.year(when).cast("long"), F.month(when).cast("long"), F.dayofmonth(when).cast("long")
    us = F.pmod(F.unix_micros(when.cast("timestamp")), F.lit(DAY))
    if cal == "360_day":
        day, ok = y * 360 + (m - 1) * 30 + d - 1, d <= 30
    elif cal in ("noleap", "all_leap"):
        months = [x + (k == 1 and cal == "all_leap") for k, x in enumerate(_MONTHS)]
        before = F.element_at(F.array(*(F.lit(sum(months[:k])) for k in range(12))), m.cast("int"))
        day = y * sum(months) + before + d - 1
        ok = ~((m == 2) & (d == 29)) if cal == "noleap" else F.lit(True)
    else:
        gregorian = F.datediff(when.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
        yy, mm = F.when(m > 2, y).otherwise(y - 1), F.when(m > 2, m - 3).otherwise(m + 9)
        julian = yy * 365 + _div(yy, 4) + _div(mm * 153 + 2, 5) + d - 1 - 719470
        day = gregorian if cal == "proleptic_gregorian" else julian if cal == "julian" else F.when(gregorian < CUTOVER, julian).otherwise(gregorian)
        ok = F.lit(True) if cal != "standard" else ~gregorian.between(CUTOVER - 10, CUTOVER - 1)
    return F.when(ok & when.isNotNull(), (day * F.lit(DAY) + us - F.lit(at)) / F.lit(float(each)))
