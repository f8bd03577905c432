"""Labels of one dimension, kept on the driver, and the lookup of labels in them."""

from __future__ import annotations

import math
from datetime import datetime, timezone
from functools import cached_property

import numpy as np

from ..functions import cftime

METHODS = ("nearest", "ffill", "pad", "bfill", "backfill")
#: Labels match exactly within so many units in the last place of the largest magnitude.
_ULPS = 8


class LabelError(KeyError):
    """A label that is not found. ``str`` is the plain message."""

    def __str__(self) -> str:
        return str(self.args[0]) if self.args else ""


def shown(value) -> str:
    if isinstance(value, datetime):
        return cftime.iso(value)
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


class Index:
    """Immutable labels: numbers, strings or datetimes, with the attributes of their dimension.

    An evenly spaced numeric index can be given as ``Index.range(start, step, n)`` and
    then needs no memory per label.
    """

    def __init__(self, labels, attrs: dict | None = None):
        self._given = labels if isinstance(labels, np.ndarray) and labels.dtype.kind in "if" else list(labels)
        self.attrs, self.step = attrs or {}, None

    @classmethod
    def range(cls, n: int, start: float = 0, step: float = 1, attrs: dict | None = None) -> Index:
        made = cls.__new__(cls)
        made._given, made.attrs, made.step = None, attrs or {}, (start, step, n)
        return made

    def __len__(self) -> int:
        return self.step[2] if self.step else len(self._given)

    def __getitem__(self, i: int):
        if self.step:
            start, step, n = self.step
            if not -n <= i < n:
                raise IndexError(i)
            return start + step * (i if i >= 0 else n + i)
        got = self._given[i]
        return got.item() if isinstance(got, np.generic) else got

    def __iter__(self):
        return (self[i] for i in range(len(self)))

    def __eq__(self, other) -> bool:
        return isinstance(other, Index) and len(self) == len(other) and (self is other or (self.step is not None and self.step == other.step) or [_same(x) for x in self] == [_same(x) for x in other])

    __hash__ = None

    @property
    def labels(self) -> list:
        return list(self)

    def with_attrs(self, attrs: dict) -> Index:
        made = Index.__new__(Index)
        made._given, made.attrs, made.step = self._given, attrs, self.step
        return made

    def take(self, pick) -> Index:
        """Labels at a slice, range or array of positions."""
        if isinstance(pick, (slice, range)):
            r = pick if isinstance(pick, range) else range(*pick.indices(len(self)))
            if self.step:
                return Index.range(len(r), self.step[0] + self.step[1] * r.start, self.step[1] * r.step, self.attrs)
            return Index([self[i] for i in r] if r.step < 0 else self._given[r.start : r.stop : r.step], self.attrs)
        return Index([self[int(i)] for i in pick], self.attrs)

    @cached_property
    def kind(self) -> str:
        """number, time or string."""
        if self.step or isinstance(self._given, np.ndarray):
            return "number"
        if not self._given:
            return "number"
        if all(isinstance(x, (int, float, np.number)) and not isinstance(x, bool) for x in self._given):
            return "number"
        if any(isinstance(x, datetime) for x in self._given):
            return "time"
        return "time" if self._texts is not None else "string"

    @cached_property
    def _calendar(self) -> tuple[str, str] | None:
        """Units and calendar of a CF time dimension."""
        units = self.attrs.get("units")
        return (units, self.attrs.get("calendar") or "standard") if units and cftime.is_time(self.attrs) else None

    @cached_property
    def _texts(self) -> list[int] | None:
        """Instants of labels that all are dates, in the dimension's calendar."""
        cal = cftime.calendar_of(self._calendar[1]) if self._calendar else "proleptic_gregorian"
        out = []
        for x in self._given:
            text = cftime.iso_micros(x) if isinstance(x, datetime) else x
            us = cftime.parse_label(text, cal or "proleptic_gregorian") if isinstance(text, str) else None
            if us is None:
                return None
            out.append(us)
        return out

    @cached_property
    def keys(self) -> np.ndarray | None:
        """Labels as numbers: themselves, or microseconds; None for strings."""
        if self.step:
            start, step, n = self.step
            return start + step * np.arange(n, dtype=np.float64)
        if self.kind == "number":
            return np.asarray(self._given, np.float64)
        return np.asarray(self._texts, np.int64) if self.kind == "time" and self._texts is not None else None

    @cached_property
    def _lookup(self) -> dict:
        out: dict = {}
        for i, x in enumerate(self):
            out.setdefault(_same(x), i)
        return out

    @cached_property
    def _order(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys in order, equal ones by position, and their positions."""
        at = np.argsort(self.keys, kind="stable")
        return self.keys[at], at

    @cached_property
    def direction(self) -> int:
        """1 ascending, -1 descending, 0 unsorted; repeated labels are in order."""
        d = np.diff(self.keys) if self.keys is not None else np.array([-1, 1])
        return 1 if (d >= 0).all() else -1 if (d <= 0).all() else 0

    def _key(self, value) -> float | int | None:
        """What a label is looked up as; None if it can not be among these."""
        if self.kind == "number":
            if isinstance(value, (int, float, np.number)) and not isinstance(value, bool):
                return float(value)
            if self._calendar and isinstance(value, (str, datetime)):
                return cftime.encode(value, *self._calendar)
            return None
        if self.kind == "time":
            text = cftime.iso_micros(value) if isinstance(value, datetime) else value
            cal = cftime.calendar_of(self._calendar[1]) if self._calendar else "proleptic_gregorian"
            if isinstance(text, str):
                return cftime.parse_label(text, cal or "proleptic_gregorian")
            if self._calendar and isinstance(text, (int, float)):
                return cftime.micros(float(text), *self._calendar)
        return None

    def find(self, value, dim: str = "", method: str | None = None, tolerance: float | None = None) -> int:
        """Position of a label.

        Exact without a method (numbers up to rounding noise; with a tolerance the nearest
        within it). ``nearest`` takes the lower position of two equally near; ``ffill`` and
        ``bfill`` the closest label before and after in the order of the dimension, so
        that in descending labels ``ffill`` looks at larger ones. Distances of times are in
        milliseconds, of CF numbers in their units.
        """
        if method is not None and method not in METHODS:
            raise ValueError(f"unknown method {method}")
        lost = LabelError(f"Coordinate value '{shown(value)}' not found in dimension '{dim}'")
        if method is not None and (self.kind == "string" or self.keys is None):
            raise TypeError("Nearest neighbor lookup requires numeric or Date coordinates")
        if self.kind == "string":
            if _same(value) not in self._lookup:
                raise lost
            return self._lookup[_same(value)]
        key = self._key(value)
        if key is None or (isinstance(key, float) and math.isnan(key)) or not len(self):
            raise lost
        if method in ("ffill", "pad", "bfill", "backfill"):
            at = self._fill(key, method in ("ffill", "pad"))
            if at is None:
                raise LabelError(f"No coordinate {'<=' if method in ('ffill', 'pad') else '>='} {shown(value)} in dimension '{dim}'")
        else:
            at = self._nearest(key)
        off = abs(float(self.keys[at] - key)) / (1000 if self.kind == "time" else 1)
        if tolerance is not None and off > tolerance:
            raise LabelError(f"No coordinate within tolerance {tolerance} of {shown(value)} in dimension '{dim}'") if method else lost
        if method is None and tolerance is None and not self._equal(key, at):
            raise lost
        return at

    def _equal(self, key, at: int) -> bool:
        if self.kind == "time":
            return int(self.keys[at]) == key
        if self.keys[at] == key:
            return True
        largest = max(abs(key), float(np.abs(self._order[0][[0, -1]]).max()))
        return abs(self.keys[at] - key) <= _ULPS * 2.0**-52 * largest and math.isfinite(largest)

    def _nearest(self, key) -> int:
        if self.step and self.step[1] and self.step[2]:
            start, step, n = self.step
            exact = (key - start) / step if math.isfinite(key) else math.copysign(n, key * step)
            low = min(max(math.ceil(exact) - 1, 0), n - 1)
            return min(range(max(0, low - 1), min(n, low + 3)), key=lambda i: (abs(self[i] - key), i))
        keys, at = self._order
        k = int(np.searchsorted(keys, key, side="left"))
        found = [j for j in (k - 1, k) if 0 <= j < len(keys)]
        best = min(abs(keys[j] - key) for j in found)
        same = [keys[j] for j in found if abs(keys[j] - key) == best]
        # of equal labels the first stands first
        return min(int(at[int(np.searchsorted(keys, v, side="left"))]) for v in same)

    def _fill(self, key, forward: bool) -> int | None:
        keys, at = self._order
        below = forward if self.direction >= 0 else not forward
        if below:
            k = int(np.searchsorted(keys, key, side="right")) - 1
            if k < 0:
                return None
        else:
            k = int(np.searchsorted(keys, key, side="left"))
            if k == len(keys):
                return None
        same = at[int(np.searchsorted(keys, keys[k], side="left")) : int(np.searchsorted(keys, keys[k], side="right"))]
        return int(same.max() if forward else same.min())


def _same(x):
    """What labels are compared by."""
    if isinstance(x, datetime):
        return (x if x.tzinfo else x.replace(tzinfo=timezone.utc)).astimezone(timezone.utc)
    return float(x) if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else x
