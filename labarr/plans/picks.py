"""Which positions of a dimension are looked at, and in what order.

A pick is a ``range``, an integer (the dimension goes) or an array of positions (any
order, repeats allowed). Picks of chained selections compose on the driver, so that one
filter reaches the source.
"""

from __future__ import annotations

import operator

import numpy as np

Pick = range | int | np.ndarray


def normalize(pick, size: int, dim: str) -> Pick:
    """A position, list of positions or slice as a pick of ``size`` positions."""
    if isinstance(pick, range):
        return pick
    if isinstance(pick, slice):
        return range(*pick.indices(size))
    if isinstance(pick, (list, tuple, np.ndarray)):
        at = np.array([normalize(x, size, dim) for x in pick], np.int64)
        if len(at) and (np.diff(at) == 1).all():
            return range(int(at[0]), int(at[-1]) + 1)
        return at if len(at) else range(0)
    if isinstance(pick, float) and pick.is_integer():
        pick = int(pick)
    try:
        i = operator.index(pick)
    except TypeError:
        raise IndexError(f"position {pick!r} of dimension '{dim}' is not an integer") from None
    if not -size <= i < size:
        raise IndexError(f"position {i} is out of range for dimension '{dim}' with size {size}")
    return i % size


def compose(outer: Pick, inner: Pick) -> Pick:
    """``inner``, which picks among the positions of ``outer``, as a pick of the source."""
    if isinstance(outer, range):
        if isinstance(inner, (range, int)):
            return outer[inner.start : inner.stop : inner.step] if isinstance(inner, range) and _forward(inner) else _gather(outer, inner)
        return np.asarray(inner) * outer.step + outer.start
    if isinstance(inner, int):
        return int(outer[inner])
    return outer[np.asarray(inner, np.int64)] if len(inner) else range(0)


def _forward(r: range) -> bool:
    return r.step > 0


def _gather(outer: range, inner: range | int) -> Pick:
    if isinstance(inner, int):
        return outer[inner]
    return np.array([outer[i] for i in inner], np.int64) if len(inner) else range(0)


def hull(pick: Pick) -> range:
    """The smallest forward range that holds all positions of a pick."""
    if isinstance(pick, int):
        return range(pick, pick + 1)
    if len(pick) == 0:
        return range(0)
    return range(int(min(pick)), int(max(pick)) + 1) if not isinstance(pick, range) else range(min(pick[0], pick[-1]), max(pick[0], pick[-1]) + 1)


def wanted(pick: Pick) -> np.ndarray:
    """The distinct positions of a pick, in order."""
    return np.unique(np.array([pick] if isinstance(pick, int) else pick, np.int64))


def covers(pick: Pick, size: int) -> bool:
    return isinstance(pick, range) and pick == range(size)
