"""Element-wise operations over operands that are broadcast by dimension name."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import exprs
from ..plans.source import FrameSource, position

#: What an operand's cells may count to be sent to every executor instead of shuffled.
SMALL = 1 << 20


def _scalar_type(x) -> S.DataType:
    if isinstance(x, bool):
        return S.BooleanType()
    return S.StringType() if isinstance(x, str) else S.DoubleType()


def _literal(x) -> Column:
    kind = _scalar_type(x)
    return F.lit(float(x) if isinstance(kind, S.DoubleType) and x is not None else x).cast(kind)


def apply(operands: list, value: Callable[[list[Column], list[S.DataType]], tuple[Column, S.DataType]]):
    """A DataArray over all dimensions of the operands, first seen first.

    Operands over the same frame and the same cells become one projection. Others meet in
    an equi-join on the dimensions they share; what shares none is an outer product.
    """
    from .dataarray import DataArray

    arrays = [x for x in operands if isinstance(x, DataArray)]
    for x in operands:
        if isinstance(x, (list, tuple, dict)) or hasattr(x, "__array__"):
            raise TypeError("operands must be DataArrays or scalars")
    if not arrays:
        raise TypeError("at least one operand must be a DataArray")
    coords: dict = {}
    for a in arrays:
        for d, index in a.indexes.items():
            if d in coords and coords[d] != index:
                raise ValueError(f"Coordinate mismatch for dimension '{d}'")
            coords.setdefault(d, index)
    dims = tuple(coords)
    shape = tuple(len(coords[d]) for d in dims)
    types = [x.dtype if isinstance(x, DataArray) else _scalar_type(x) for x in operands]

    first = arrays[0]
    if all(isinstance(a._source, FrameSource) and a._source.frame is first._source.frame and _same_picks(a, first) for a in arrays):
        made, kind = value([x._source.value if isinstance(x, DataArray) else _literal(x) for x in operands], types)
        return DataArray(first._source.with_value(made, kind), first.indexes, {}, None, first._picks)

    df, names, held = None, [], ()
    for k, a in enumerate(arrays):
        own = a.cells.withColumnRenamed("value", f"__v{k}")
        names.append(F.col(f"__v{k}"))
        if df is None:
            df, held = own, a.dims
            continue
        shared = [position(d) for d in a.dims if d in held]
        left = math.prod(shape[dims.index(d)] for d in held)
        # the smaller side goes to all executors if its number of cells allows
        if a.size <= min(SMALL, max(left, 1)):
            own = F.broadcast(own)
        elif left <= SMALL:
            df = F.broadcast(df)
        df = df.join(own, shared) if shared else df.crossJoin(own)
        held = (*held, *(d for d in a.dims if d not in held))
    columns, left = [], iter(names)
    for x in operands:
        columns.append(next(left) if isinstance(x, DataArray) else _literal(x))
    made, kind = value(columns, types)
    df = df.select(*(F.col(f"`{position(d)}`") for d in dims), made.cast(kind).alias("value"))
    return DataArray(FrameSource(df, dims, shape, "value", kind), coords, {}, None)


def _same_picks(a, b) -> bool:
    import numpy as np

    return a._source.dims == b._source.dims and all(type(a._picks[d]) is type(b._picks[d]) and (np.array_equal(a._picks[d], b._picks[d]) if isinstance(a._picks[d], np.ndarray) else a._picks[d] == b._picks[d]) for d in a._source.dims)


def binary(op: str, left, right, strict: bool, keep_attrs):
    """Arithmetic keeps the left operand's attributes and name, a comparison no attributes."""
    if op in exprs.ARITHMETIC:
        f = exprs.ARITHMETIC[op]
        out = apply([left, right], lambda c, t: (f(exprs.operand(c[0], t[0], strict, op), exprs.operand(c[1], t[1], strict, op)), S.DoubleType()))
    else:
        out = apply([left, right], lambda c, t: (exprs.compare(op, c[0], t[0], c[1], t[1], strict), S.BooleanType()))
    attrs = keep_attrs({"left": left, "right": right}) if callable(keep_attrs) else getattr(left, "attrs", {}) if keep_attrs else {}
    out.attrs, out.name = dict(attrs or {}), getattr(left, "name", None)
    return out


def where(cond, x, y, keep_attrs=False, prefer_name_from: str | None = None):
    """keep_attrs: True or 'x', 'y', or a function of {cond, x, y}; default none. The name
    is that of x, else y, else cond, unless another is preferred."""

    def value(c: list[Column], t: list[S.DataType]) -> tuple[Column, S.DataType]:
        kinds = [k for k, given in zip(t[1:], (x, y), strict=True) if given is not None]
        of = {exprs.kind(k) for k in kinds}
        if len(of) > 1:
            raise TypeError("where needs values of one kind")
        kind = S.StringType() if of == {"string"} else S.BooleanType() if of == {"boolean"} else kinds[0] if len(set(map(str, kinds))) == 1 else S.DoubleType()
        return F.when(exprs.truthy(c[0], t[0]), c[1].cast(kind)).otherwise(c[2].cast(kind)), kind

    out = apply([cond, x, y], value)
    given = {"cond": cond, "x": x, "y": y}
    keep = "x" if keep_attrs is True else keep_attrs
    attrs = keep(given) if callable(keep) else getattr(given.get(keep), "attrs", {}) if keep else {}
    order = ([prefer_name_from] if prefer_name_from else []) + ["x", "y", "cond"]
    out.attrs, out.name = dict(attrs or {}), next((n for k in order if (n := getattr(given[k], "name", None))), None)
    return out
