"""What the step between two labels is called."""

from __future__ import annotations

from datetime import datetime, timezone

from . import cftime

#: Base unit -> (step in base units, name, output unit, base units of the
#: output unit, or None where the output is always 1). A step within a tenth matches.
_STEPS = {
    "second": ((3600, "hourly", "hours", 3600), (10800, "3-hourly", "hours", 3600), (21600, "6-hourly", "hours", 3600), (86400, "daily", "days", 86400)),
    "minute": ((60, "hourly", "hours", 60), (1440, "daily", "days", 1440)),
    "hour": ((1, "hourly", "hours", 1), (3, "3-hourly", "hours", 1), (6, "6-hourly", "hours", 1), (24, "daily", "days", 24)),
    "day": ((1, "daily", "days", 1), (7, "weekly", "days", 1), (30, "monthly", "months", None), (31, "monthly", "months", None), (365, "yearly", "years", None), (366, "yearly", "years", None)),
    "month": ((1, "monthly", "months", 1), (12, "yearly", "years", None)),
    "year": ((1, "yearly", "years", 1),),
}


def time_resolution(first, second, units: str | None) -> dict | None:
    """{value, type, unit} of a step between numeric or datetime labels; None for others."""
    ends = [(x if x.tzinfo else x.replace(tzinfo=timezone.utc)).timestamp() if isinstance(x, datetime) else x for x in (first, second)]
    if any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in ends):
        return None
    step = abs(ends[1] - ends[0])
    parsed = cftime.parse_cf_time_units(units) if units else None
    base = parsed["unit"] if parsed else "seconds"
    for size, name, unit, per in _STEPS.get(base, ()):
        if abs(step - size) / size < 0.1:
            return {"value": 1 if per is None else step / per, "type": name, "unit": unit}
    return {"value": step, "type": "custom", "unit": base + "s" if base in _STEPS else base}


def spatial_resolution(first, second, dim: str, units: str | None) -> dict | None:
    """{resolution, unit} of a numeric step, rounded to 6 decimals; unit by name of the dimension."""
    if any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in (first, second)):
        return None
    low = dim.lower()
    unit = "degrees_north" if "lat" in low or low == "y" else "degrees_east" if "lon" in low or low == "x" else units or "unknown"
    import math

    return {"resolution": math.floor(abs(second - first) * 1e6 + 0.5) / 1e6, "unit": unit}
