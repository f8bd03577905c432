"""Named arrays that share dimensions and labels."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from ..functions.arrays import ZARR_ENCODINGS, bytes_per_element
from ..functions.cftime import is_time
from ..functions.resolution import spatial_resolution
from ..plans.index import Index
from ..plans.source import position
from .concat import concat_arrays
from .dataarray import DataArray, json_ready

#: Decimals of a dataset's numeric labels. Selections use the arrays' own, unrounded ones.
DECIMALS = 6


def _rounded(index: Index) -> Index:
    if index.kind != "number":
        return index
    f = 10**DECIMALS
    if index.step and all(float(x).is_integer() for x in index.step[:2]):
        return index
    return Index([math.floor(x * f + 0.5) / f if isinstance(x, (int, float)) and math.isfinite(x) else x for x in index], index.attrs)


class Dataset:
    """An ordered map of variables; sizes of shared dimensions must agree, of labels the
    first variable's count."""

    def __init__(self, data_vars: dict[str, DataArray] | None = None, coords: dict | None = None, attrs: dict | None = None, coord_attrs: dict | None = None):
        self._vars: dict[str, DataArray] = {}
        self.attrs, self.coord_attrs = attrs if attrs is not None else {}, coord_attrs if coord_attrs is not None else {}
        self._coords = {d: _rounded(x if isinstance(x, Index) else Index(x, self.coord_attrs.get(d))) for d, x in (coords or {}).items()}
        self._encrypted: bool | None = None
        for name, array in (data_vars or {}).items():
            self.add_variable(name, array)

    # --- introspection -----------------------------------------------------------------

    @property
    def data_vars(self) -> list[str]:
        return list(self._vars)

    @property
    def dims(self) -> list[str]:
        return list(dict.fromkeys(d for a in self._vars.values() for d in a.dims))

    @property
    def coords(self) -> dict[str, list]:
        return {d: x.labels for d, x in self._coords.items()}

    @property
    def sizes(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for name, a in self._vars.items():
            for d, n in zip(a.dims, a.shape, strict=True):
                if out.setdefault(d, n) != n:
                    raise ValueError(f"Inconsistent size of dimension '{d}' in variable '{name}': {n} and {out[d]}")
        return out

    @property
    def is_encrypted(self) -> bool:
        return self.detect_encryption() if self._encrypted is None else self._encrypted

    def detect_encryption(self) -> bool:
        """Whether any variable's codecs encrypt; looked up anew at each call."""
        self._encrypted = any(isinstance(c, dict) and c.get("name") in ZARR_ENCODINGS for a in self._vars.values() for c in a.attrs.get("codecs") or ())
        return self._encrypted

    def __repr__(self) -> str:
        lines = ["<labarr.Dataset>", "Dimensions: " + ", ".join(f"{d}: {n}" for d, n in self.sizes.items())]
        lines += [f"  {name} ({', '.join(a.dims)}) {a.dtype.simpleString()}" for name, a in self._vars.items()]
        return "\n".join(lines + [f"Attributes: {len(self.attrs)}"])

    # --- variables ---------------------------------------------------------------------

    def add_variable(self, name: str, array: DataArray) -> None:
        sizes = {d: len(x) for d, x in self._coords.items()} | self.sizes
        for d, n in zip(array.dims, array.shape, strict=True):
            if sizes.get(d, n) != n:
                raise ValueError(f"Dimension '{d}' has size {n} in variable '{name}' and {sizes[d]} in the dataset")
        for d, x in array.indexes.items():
            self._coords.setdefault(d, _rounded(x))
        self._vars[name] = array

    def remove_variable(self, name: str) -> bool:
        return self._vars.pop(name, None) is not None

    def has_variable(self, name: str) -> bool:
        return name in self._vars

    def get_variable(self, name: str) -> DataArray:
        if name not in self._vars:
            raise KeyError(f"Variable '{name}' not found in dataset")
        return self._vars[name]

    def get(self, names: str | list[str]):
        """One variable, or a dataset of some with the labels they use."""
        if isinstance(names, str):
            return self.get_variable(names)
        return self._with({n: self.get_variable(n) for n in names})

    __getitem__ = get

    def _with(self, variables: dict[str, DataArray], coords: dict[str, Index] | None = None) -> Dataset:
        used = {d for a in variables.values() for d in a.dims}
        given = coords if coords is not None else {d: x for d, x in self._coords.items() if d in used}
        return Dataset(variables, given, dict(self.attrs), {d: v for d, v in self.coord_attrs.items() if d in given or coords is not None})

    def drop_vars(self, names: str | list[str]) -> Dataset:
        gone = {names} if isinstance(names, str) else set(names)
        if not gone & set(self._vars):
            return self
        return self._with({n: a for n, a in self._vars.items() if n not in gone})

    def rename(self, names: dict[str, str]) -> Dataset:
        for old in names:
            self.get_variable(old)
        to = [names.get(n, n) for n in self._vars]
        if len(set(to)) < len(to):
            raise ValueError("Cannot rename: two variables would have one name")
        return self._with(dict(zip(to, self._vars.values(), strict=True)), dict(self._coords))

    def assign_coords(self, coords: dict) -> Dataset:
        for d in coords:
            if d not in self._coords:
                raise ValueError(f"Dimension '{d}' not found in dataset")
        made = {n: a.assign_coords({d: x for d, x in coords.items() if d in a.dims}) for n, a in self._vars.items()}
        fresh = {d: x for a in made.values() for d, x in a.indexes.items() if d in coords}
        return self._with(made, self._coords | fresh)

    def map(self, f: Callable[[DataArray, str], DataArray]) -> Dataset:
        """A dataset of ``f(variable, name)``; runs at plan time."""
        return Dataset({n: f(a, n) for n, a in self._vars.items()}, None, dict(self.attrs), dict(self.coord_attrs))

    def merge(self, other: Dataset) -> Dataset:
        """Variables of both; labels and attributes of ``other`` win. No alignment."""
        both = set(self._vars) & set(other._vars)
        if both:
            raise ValueError(f"Variable '{sorted(both)[0]}' exists in both datasets")
        return Dataset(self._vars | other._vars, self._coords | other._coords, self.attrs | other.attrs, self.coord_attrs | other.coord_attrs)

    def squeeze(self) -> Dataset:
        return self._with({n: a.squeeze() for n, a in self._vars.items()})

    def compute(self) -> Dataset:
        return self._with({n: a.compute() for n, a in self._vars.items()}, dict(self._coords))

    def wide(self, names: list[str] | None = None) -> DataFrame:
        """One row per position and a column per variable of the same dimensions.

        Variables over one frame are one projection; others are joined on positions.
        """
        from pyspark.sql import functions as F

        from ..plans.source import FrameSource
        from .combine import _same_picks

        arrays = {n: self.get_variable(n) for n in names or self._vars}
        first = next(iter(arrays.values()))
        if any(a.dims != first.dims or a.shape != first.shape for a in arrays.values()):
            raise ValueError("variables must have the same dimensions")
        at = [position(d) for d in first.dims]
        if all(isinstance(a._source, FrameSource) and a._source.frame is first._source.frame and _same_picks(a, first) for a in arrays.values()):
            df = first._source.narrowed(first._picks).select(*(F.col(f"`{position(d)}`") for d in first._source.dims), *(a._source.value.alias(n) for n, a in arrays.items()))
            return first._placed(df).select(*(F.col(f"`{c}`") for c in at), *(F.col(f"`{n}`") for n in arrays))
        out = None
        for n, a in arrays.items():
            one = a.cells.withColumnRenamed("value", n)
            out = one if out is None else out.join(one, at, "full_outer") if at else out.crossJoin(one)
        return out

    # --- selection ---------------------------------------------------------------------

    def sel(self, selection: dict, method: str | None = None, tolerance: float | None = None) -> Dataset:
        made = {n: a.sel(selection, method, tolerance) for n, a in self._vars.items()}
        return self._selected(made)

    def isel(self, selection: dict) -> Dataset:
        return self._selected({n: a.isel(selection) for n, a in self._vars.items()})

    def _selected(self, made: dict[str, DataArray]) -> Dataset:
        return Dataset(made, None, dict(self.attrs), dict(self.coord_attrs))

    def sel_stream(self, selection: dict | None = None, chunk_size: float = 100, dimension: str | None = None, method: str | None = None, tolerance: float | None = None) -> Iterator:
        from ..streaming.chunks import stream_dataset

        return stream_dataset(self, selection or {}, chunk_size, dimension, method, tolerance)

    def where(self, cond, other=None, keep_attrs=False) -> Dataset:
        """Per variable. A dataset ``cond`` must have the variable; a dataset ``other`` that
        lacks it gives null."""
        made = {}
        for n, a in self._vars.items():
            c = cond.get_variable(n) if isinstance(cond, Dataset) else cond
            o = (other._vars.get(n) if isinstance(other, Dataset) else other)
            made[n] = a.where(c, o, keep_attrs)
        return self._selected(made)

    def rolling(self, dim: str, window: float, center: bool = False, min_periods: int | None = None) -> DatasetRolling:
        if dim not in self.dims:
            raise ValueError(f"Dimension '{dim}' not found in dataset")
        return DatasetRolling(self, dim, window, center, min_periods)

    def concat(self, other: Dataset, dim: str) -> Dataset:
        """All variables along ``dim``. Both must have the dimension and the same variables;
        variables without the dimension are the first's. Labels are the arrays' own."""
        for d in (self, other):
            if dim not in d.dims:
                raise ValueError(f"Cannot concatenate: dimension '{dim}' not found")
        if set(self._vars) != set(other._vars):
            raise ValueError("Cannot concatenate: variables differ")
        a, b = self.sizes, other.sizes
        if set(a) != set(b):
            raise ValueError("Cannot concatenate: dimensions differ")
        for d in a:
            if d != dim and a[d] != b[d]:
                raise ValueError(f"Cannot concatenate: size of dimension '{d}' differs ({a[d]} and {b[d]})")
        made = {n: concat_arrays(v, other._vars[n], dim) if dim in v.dims else v for n, v in self._vars.items()}
        return Dataset(made, {d: x for d, x in self._coords.items() if d != dim}, dict(self.attrs), dict(self.coord_attrs))

    # --- sinks and what labels say -----------------------------------------------------

    def to_records(self, name: str, precision: int = 6) -> DataFrame:
        return self.get_variable(name).records(precision)

    def to_object(self) -> dict:
        return {"dataVars": {n: a.to_object() for n, a in self._vars.items()}, "coords": self.coords, "attrs": self.attrs, "dims": self.dims, "sizes": self.sizes}

    def to_json(self) -> str:
        return json.dumps(json_ready(self.to_object()))

    def get_size_estimation(self, name: str, selection: dict | None = None) -> int:
        """Bytes of a variable, or of a selection of positions (``stop`` is exclusive)."""
        a = self.get_variable(name)
        n = 1
        for d, size in zip(a.dims, a.shape, strict=True):
            want = (selection or {}).get(d)
            if want is None:
                n *= size
            elif isinstance(want, dict):
                n *= want["stop"] - want["start"]
            elif isinstance(want, (list, tuple)):
                n *= want[1] - want[0]
        return n * bytes_per_element(a.attrs.get("_zarr_data_type"))

    def calculate_coordinate_resolutions(self) -> dict[str, dict]:
        """Step of each dimension's first labels; also noted in ``coord_attrs``."""
        out: dict[str, dict] = {}
        for d in self.dims:
            index = self._coords.get(d)
            if index is None or len(index) < 2:
                continue
            attrs = self.coord_attrs.get(d, {})
            if is_time(attrs):
                found = (a.calculate_time_resolution(d) for a in self._vars.values() if d in a.dims)
                got = next((x for x in found if x), None)
                note = got and {"resolution": got["value"], "resolution_type": got["type"], "resolution_unit": got["unit"]}
            else:
                got = spatial_resolution(index[0], index[1], d, attrs.get("units"))
                note = got and {"resolution": got["resolution"], "resolution_unit": got["unit"]}
            if got:
                out[d] = got
                self.coord_attrs[d] = attrs | note
        return out


class DatasetRolling:
    """``mean`` and ``sum`` per variable; those without the dimension pass through."""

    def __init__(self, dataset: Dataset, dim: str, window: float, center: bool, min_periods: int | None):
        self.dataset, self.dim, self.args = dataset, dim, (window, center, min_periods)

    def _each(self, how: str) -> Dataset:
        made = {n: getattr(a.rolling(self.dim, *self.args), how)() if self.dim in a.dims else a for n, a in self.dataset._vars.items()}
        return self.dataset._with(made, dict(self.dataset._coords))

    def mean(self) -> Dataset:
        return self._each("mean")

    def sum(self) -> Dataset:
        return self._each("sum")
