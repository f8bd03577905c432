"""Nested and flat arrays: helpers for driver data, and the same on array columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: codecs that encrypt.
ZARR_ENCODINGS = frozenset({"xchacha20poly1305"})

#: Bytes of data types by what their names contain, first match first.
_BYTES = ((("float64", "f8"), 8), (("float32", "f4"), 4), (("float16", "f2"), 2), (("int64", "i8", "u8"), 8), (("int32", "i4", "u4"), 4), (("int16", "i2", "u2"), 2), (("int8", "i1", "u1"), 1))


def bytes_per_element(dtype: str | None) -> int:
    """Bytes of a named data type; 4 if unknown."""
    name = (dtype or "").lower()
    return next((n for names, n in _BYTES if any(x in name for x in names)), 4)


def get_shape(nested) -> list[int]:
    """Shape along first elements; ragged input is an error."""
    if not isinstance(nested, (list, tuple)):
        return []
    inner = [get_shape(x) for x in nested]
    if any(x != inner[0] for x in inner):
        raise ValueError("nested data is ragged")
    return [len(nested), *(inner[0] if inner else [])]


def flatten(nested) -> list:
    """All elements in row-major order."""
    if not isinstance(nested, (list, tuple)):
        return [nested]
    out: list = []
    for x in nested:
        out.extend(flatten(x) if isinstance(x, (list, tuple)) else [x])
    return out


def reshape(flat: list, shape: list[int]):
    """Nested lists of a shape; an empty shape gives the only element."""
    if len(flat) != math.prod(shape):
        raise ValueError(f"{len(flat)} elements do not fill shape {list(shape)}")
    out = list(flat)
    for n in reversed(shape[1:]):
        out = [out[i : i + n] for i in range(0, len(out), n)] if n else [[] for _ in range(math.prod(shape[: shape.index(n)]))]
    return out if shape else out[0]


def get_at(nested, at):
    """Element or sub-array at a list of positions; too many positions are an error."""
    for i in at:
        if not isinstance(nested, (list, tuple)):
            raise IndexError("more positions than dimensions")
        nested = nested[i]
    return nested


def set_at(nested, at, value):
    """A copy with one element replaced."""
    if not at:
        return value
    out = list(nested)
    out[at[0]] = set_at(out[at[0]], at[1:], value)
    return out


def arrays_equal(a, b) -> bool:
    """Same nesting and strictly equal elements (NaN differs from itself, 1 from True)."""
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(arrays_equal(x, y) for x, y in zip(a, b, strict=True))
    return isinstance(a, bool) == isinstance(b, bool) and not isinstance(a, (list, tuple)) and not isinstance(b, (list, tuple)) and a == b


def shape_column(c: Column, rank: int) -> Column:
    """Sizes along first elements of a nested array column."""
    sizes = []
    for _ in range(rank):
        sizes.append(F.size(c))
        c = F.get(c, F.lit(0))
    return F.array(*sizes)


def flatten_column(c: Column, rank: int) -> Column:
    for _ in range(rank - 1):
        c = F.flatten(c)
    return c


def reshape_column(c: Column, shape: list[int]) -> Column:
    """A flat array column in a shape: inner dimensions are cut from the end."""
    for n in reversed(shape[1:]):
        c = _rows(c, n)
    return c


def _rows(c: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.call_function("div", F.size(c), F.lit(n)).cast("int") - 1, F.lit(0))), lambda k: F.slice(c, k * n + 1, F.lit(n)))


def at_column(c: Column, at) -> Column:
    """Element at positions; null beyond the end."""
    for i in at:
        c = F.get(c, F.lit(i))
    return c


def set_at_column(c: Column, i: int, value: Column) -> Column:
    return F.transform(c, lambda x, k: F.when(k == i, value).otherwise(x))
