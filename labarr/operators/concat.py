"""Two arrays one after the other along a dimension."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.index import Index
from ..plans.picks import Pick, hull
from ..plans.source import Source, position
from .dataarray import DataArray


class ConcatSource(Source):
    """Reads only the operand that holds wanted positions, each with its own range."""

    def __init__(self, first: DataArray, second: DataArray, dim: str):
        self.first, self.second, self.dim = first, second, dim
        self.at = first.shape[first.dims.index(dim)]
        self.dims, self.spark, self.dtype = first.dims, first.spark, first.dtype
        self.shape = tuple(n + second.shape[k] if d == dim else n for k, (d, n) in enumerate(zip(first.dims, first.shape, strict=True)))

    def _part(self, array: DataArray, picks: dict[str, Pick], shift: int) -> DataFrame | None:
        """Cells of one operand at positions of the whole; None if none is wanted."""
        spans = {}
        for d, n in zip(array.dims, array.shape, strict=True):
            span = hull(picks.get(d, range(n + shift if d == self.dim else n)))
            if d == self.dim:
                span = range(max(0, span.start - shift), min(n, span.stop - shift))
            if len(span) == 0 and n:
                return None
            spans[d] = span
        df = array.isel({d: slice(s.start, s.stop) for d, s in spans.items()}).cells
        for d, s in spans.items():
            move = s.start + (shift if d == self.dim else 0)
            if move:
                df = df.withColumn(position(d), F.col(f"`{position(d)}`") + F.lit(move))
        return df

    def read(self, picks: dict[str, Pick]) -> DataFrame:
        found = [x for x in (self._part(self.first, picks, 0), self._part(self.second, picks, self.at)) if x is not None]
        if not found:
            return self.first.cells.filter(F.lit(False))
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def concat_arrays(first: DataArray, second: DataArray, dim: str, attrs: dict | None = None) -> DataArray:
    """All of ``first``, then all of ``second``. Dimensions and the other sizes must agree;
    labels of other dimensions, attributes and the name are the first's."""
    if first.dims != second.dims:
        raise ValueError(f"Cannot concatenate: dimensions differ ({first.dims} and {second.dims})")
    if dim not in first.dims:
        raise ValueError(f"Cannot concatenate: dimension '{dim}' not found")
    for d, a, b in zip(first.dims, first.shape, second.shape, strict=True):
        if d != dim and a != b:
            raise ValueError(f"Cannot concatenate: size of dimension '{d}' differs ({a} and {b})")
    if type(first.dtype) is not type(second.dtype):
        raise TypeError("Cannot concatenate cells of different types")
    a, b = first.indexes[dim], second.indexes[dim]
    labels = np.concatenate([a.keys, b.keys]) if a.kind == b.kind == "number" and len(a) and len(b) else [*a, *b]
    coords = first.indexes | {dim: Index(labels, a.attrs)}
    return DataArray(ConcatSource(first, second, dim), coords, dict(attrs if attrs is not None else first.attrs), first.name)
