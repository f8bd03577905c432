"""A labelled N-dimensional array whose cells are rows of a DataFrame."""

from __future__ import annotations

import copy
import json
import math
from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import cftime, exprs
from ..functions.arrays import flatten, get_shape
from ..plans.index import Index
from ..plans.picks import Pick, compose, covers, normalize
from ..plans.source import FrameSource, Source, mapping, position
from . import combine, rolling

#: Cells of an operand that is broadcast to all executors, at most.
BROADCAST_CELLS = 1 << 20


def _index(labels, n: int, dim: str, attrs: dict | None) -> Index:
    index = labels if isinstance(labels, Index) else Index.range(n, attrs=attrs) if labels is None else Index(labels, attrs)
    if len(index) != n:
        raise ValueError(f"Coordinate length mismatch for dimension '{dim}': {len(index)} labels for size {n}")
    return index


class DataArray:
    """Dimensions, labels and attributes over a source of cells.

    Nothing runs until a sink (``to_numpy``, ``item``, ``collect_records``, ``compute``)
    asks for values: selections compose on the driver, all else is a logical plan.
    """

    def __init__(self, source: Source, coords: dict[str, Index], attrs: dict | None = None, name: str | None = None, picks: dict[str, Pick] | None = None):
        self._source = source
        self._picks = picks if picks is not None else {d: range(n) for d, n in zip(source.dims, source.shape, strict=True)}
        self.dims = tuple(d for d in source.dims if not isinstance(self._picks[d], int))
        self.shape = tuple(len(self._picks[d]) for d in self.dims)
        self._coords = {d: coords[d] for d in self.dims}
        self.attrs, self.name = attrs if attrs is not None else {}, name
        self._cached = False

    # --- sources -----------------------------------------------------------------------

    @classmethod
    def from_nested(cls, spark: SparkSession, data, dims=None, coords: dict | None = None, attrs: dict | None = None, name: str | None = None) -> DataArray:
        """From nested lists, a scalar or a numpy array (driver data)."""
        shape = tuple(data.shape) if isinstance(data, np.ndarray) else tuple(get_shape(data))
        flat = data.reshape(-1).tolist() if isinstance(data, np.ndarray) else flatten(data) if shape else [data]
        return cls.from_flat(spark, flat, shape, dims, coords, attrs, name, data.dtype if isinstance(data, np.ndarray) else None)

    @classmethod
    def from_flat(cls, spark: SparkSession, data, shape, dims=None, coords: dict | None = None, attrs: dict | None = None, name: str | None = None, dtype=None) -> DataArray:
        """From a row-major buffer and its shape; typed buffers keep their type."""
        shape = tuple(shape)
        if any(not isinstance(n, (int, np.integer)) or n < 0 for n in shape):
            raise ValueError(f"shape {shape} must be non-negative integers")
        size = math.prod(shape)
        if len(data) != size:
            raise ValueError(f"Data length {len(data)} does not match shape {shape} ({size} cells)")
        dims = tuple(dims) if dims is not None else tuple(f"dim_{k}" for k in range(len(shape)))
        if len(dims) != len(shape):
            raise ValueError(f"Number of dimensions ({len(dims)}) does not match data dimensions ({len(shape)})")
        for d in coords or {}:
            if d not in dims:
                raise ValueError(f"Coordinate dimension '{d}' not found in dimensions")
        kind = _spark_type(data, dtype)
        values = [None if v is None else _plain(v, kind) for v in data]
        at = np.indices(shape).reshape(len(shape), -1) if shape else np.zeros((0, 1), np.int64)
        rows = [(*(int(x) for x in at[:, k]), values[k]) for k in range(size)]
        schema = S.StructType([S.StructField(position(d), S.LongType(), False) for d in dims] + [S.StructField("value", kind)])
        given = {d: _index((coords or {}).get(d), n, d, _attrs_of(attrs, d)) for d, n in zip(dims, shape, strict=True)}
        return cls(FrameSource(spark.createDataFrame(rows, schema), dims, shape, "value", kind), given, attrs, name)

    @classmethod
    def from_cells(cls, frame: DataFrame, dims, shape, coords: dict | None = None, value: Column | str = "value", attrs: dict | None = None, name: str | None = None) -> DataArray:
        """From a DataFrame that has one row per cell and position columns ``__i_<dim>``."""
        given = {d: _index((coords or {}).get(d), n, d, _attrs_of(attrs, d)) for d, n in zip(dims, shape, strict=True)}
        return cls(FrameSource(frame, tuple(dims), tuple(shape), value), given, attrs, name)

    # --- introspection -----------------------------------------------------------------

    @property
    def spark(self) -> SparkSession:
        return self._source.spark

    @property
    def dtype(self) -> S.DataType:
        return self._source.dtype

    @property
    def ndim(self) -> int:
        return len(self.dims)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def coords(self) -> dict[str, list]:
        return {d: x.labels for d, x in self._coords.items()}

    @property
    def indexes(self) -> dict[str, Index]:
        return dict(self._coords)

    @property
    def is_lazy(self) -> bool:
        return not self._cached

    def __repr__(self) -> str:
        sizes = ", ".join(f"{d}: {n}" for d, n in zip(self.dims, self.shape, strict=True))
        lines = [f"<labarr.DataArray {self.name or ''} ({sizes}) {self.dtype.simpleString()}>"]
        for d, x in self._coords.items():
            head = [cftime.format_coordinate(x[i], x.attrs) for i in range(min(3, len(x)))]
            lines.append(f"  * {d}: {', '.join(head)}{' ...' if len(x) > 3 else ''}")
        return "\n".join(lines)

    # --- the plan ----------------------------------------------------------------------

    @property
    def cells(self) -> DataFrame:
        """One row per cell: a position column for each dimension, and ``value``."""
        df = self._placed(self._source.read(self._picks))
        return df.select(*(F.col(f"`{position(d)}`") for d in self.dims), "value")

    def _placed(self, df: DataFrame) -> DataFrame:
        """Exact filters, and this array's own positions instead of the source's."""
        for d, n in zip(self._source.dims, self._source.shape, strict=True):
            pick, name = self._picks[d], position(d)
            c = F.col(f"`{name}`")
            if isinstance(pick, int):
                df = df.filter(c == pick).drop(name)
            elif isinstance(pick, range):
                if not covers(pick, n):
                    df = df.filter(c.between(min(pick[0], pick[-1]), max(pick[0], pick[-1]))) if len(pick) else df.filter(F.lit(False))
                    moved = c - pick.start
                    if abs(pick.step) != 1:
                        df, moved = df.filter(F.pmod(moved, F.lit(abs(pick.step))) == 0), F.call_function("div", moved, F.lit(pick.step))
                    elif pick.step == -1:
                        moved = -moved
                    df = df.withColumn(name, moved.cast("long"))
            else:
                table = mapping(df.sparkSession, pick, name, "__new")
                df = df.join(F.broadcast(table) if len(pick) <= BROADCAST_CELLS else table, name).drop(name).withColumnRenamed("__new", name)
        return df

    def _like(self, picks: dict[str, Pick], coords: dict[str, Index], **more) -> DataArray:
        made = DataArray(self._source, coords, more.get("attrs", self.attrs), more.get("name", self.name), picks)
        return made

    def _from(self, df: DataFrame, dims: tuple[str, ...], shape: tuple[int, ...], coords: dict[str, Index], attrs: dict, name: str | None) -> DataArray:
        return DataArray(FrameSource(df, dims, shape), {d: coords[d] for d in dims}, attrs, name)

    def compute(self) -> DataArray:
        """Cells cached on the executors; a no-op if they are."""
        if self._cached:
            return self
        df = self.cells.cache()
        df.count()
        made = self._from(df, self.dims, self.shape, self._coords, self.attrs, self.name)
        made._cached = True
        return made

    # --- selection ---------------------------------------------------------------------

    def sel(self, selection: dict, method: str | None = None, tolerance: float | None = None) -> DataArray:
        """By label: a label (drops the dimension), a list of labels (points, in that
        order) or a {start, stop} dict or slice (inclusive, either end optional). Both ends
        are looked up like any label. Dimensions that the array lacks are ignored."""
        picked = {}
        for d, index in self._coords.items():
            if d not in selection or selection[d] is None:
                continue
            want = selection[d]
            find = lambda v, d=d, index=index: index.find(v, d, method, tolerance)
            if isinstance(want, slice):
                want = {"start": want.start, "stop": want.stop}
            if isinstance(want, dict):
                a = 0 if want.get("start") is None else find(want["start"])
                b = len(index) - 1 if want.get("stop") is None else find(want["stop"])
                picked[d] = range(a, max(a, b + 1))
            elif isinstance(want, (list, tuple, np.ndarray)):
                picked[d] = normalize([find(v.item() if isinstance(v, np.generic) else v) for v in want], len(index), d)
            else:
                picked[d] = find(want)
        return self._at(picked)

    def isel(self, selection: dict) -> DataArray:
        """By position: an integer (drops the dimension), a list or a slice; negative
        positions count from the end. Unknown dimensions are ignored."""
        return self._at({d: normalize(selection[d], n, d) for d, n in zip(self.dims, self.shape, strict=True) if d in selection and selection[d] is not None})

    def _at(self, picked: dict[str, Pick]) -> DataArray:
        picks = self._picks | {d: compose(self._picks[d], p) for d, p in picked.items()}
        coords = {d: x.take(picked[d]) if d in picked else x for d, x in self._coords.items() if not isinstance(picked.get(d), int)}
        return self._like(picks, coords)

    def original_index(self, dim: str, i: int) -> int:
        """Position in the source of position ``i`` of a dimension."""
        return int(compose(self._picks[dim], int(i)))

    def squeeze(self) -> DataArray:
        return self._at({d: 0 for d, n in zip(self.dims, self.shape, strict=True) if n == 1})

    def assign_coords(self, coords: dict) -> DataArray:
        """Other labels for some dimensions: lists, or 1-d arrays on that dimension."""
        made = dict(self._coords)
        for d, labels in coords.items():
            if d not in self._coords:
                raise ValueError(f"Dimension '{d}' not found in DataArray")
            if isinstance(labels, DataArray):
                if labels.dims != (d,):
                    raise ValueError(f"Coordinate for '{d}' must be one-dimensional along '{d}'")
                labels = labels.to_numpy().tolist()
            made[d] = _index(labels, len(self._coords[d]), d, self._coords[d].attrs)
        return self._like(self._picks, made)

    def clone_with(self, coords: dict | None = None, attrs: dict | None = None, name: str | None = None) -> DataArray:
        made = self.assign_coords(coords) if coords else self._like(self._picks, dict(self._coords))
        made.attrs = attrs if attrs is not None else copy.deepcopy(self.attrs)
        made.name = name if name is not None else self.name
        return made

    # --- reductions --------------------------------------------------------------------

    def sum(self, dim: str | None = None) -> DataArray:
        """Of all cells, missing ones skipped; along ``dim`` NaN is not skipped, null is 0."""
        if dim is None:
            return self._reduce(None, exprs.total)
        return self._reduce(dim, exprs.total_along, 0.0, refuse="sum")

    def mean(self, dim: str | None = None) -> DataArray:
        """Of the cells that are not missing; NaN of none."""
        return self._reduce(dim, exprs.average, math.nan)

    def count(self, dim: str | None = None) -> DataArray:
        """Number of cells that are not missing."""
        return self._reduce(dim, exprs.valid, 0)

    def reduce(self, dim: str | None, how: str | Callable[[Column], Column]) -> DataArray:
        """``sum``, ``max``, ``min`` or ``product`` of the cells as they are, or an
        aggregate expression over a column of doubles."""
        given = {"sum": F.sum, "max": F.max, "min": F.min, "product": F.product}
        return self._reduce(dim, given[how] if isinstance(how, str) else how, None)

    def fold(self, dim: str, step: Callable[[Column, Column], Column]) -> DataArray:
        """Left fold along ``dim`` with an expression (accumulator, value); it starts at the
        first value. A lane is gathered in one row, so its length must fit one."""
        self._axis(dim)
        rest = tuple(d for d in self.dims if d != dim)
        lane = F.array_sort(F.collect_list(F.struct(F.col(f"`{position(dim)}`").alias("i"), exprs.number(F.col("value"), self.dtype).alias("v"))))
        value = F.aggregate(F.slice("lane", 2, F.greatest(F.size("lane") - 1, F.lit(0))), F.get("lane", F.lit(0))["v"], lambda a, x: step(a, x["v"]))
        df = self.cells.groupBy(*(f"`{position(d)}`" for d in rest)).agg(lane.alias("lane")).select(*(F.col(f"`{position(d)}`") for d in rest), value.alias("value"))
        return self._from(df, rest, self._sizes(rest), self._coords, self.attrs, self.name)

    def _sizes(self, dims: tuple[str, ...]) -> tuple[int, ...]:
        return tuple(self.shape[self.dims.index(d)] for d in dims)

    def _axis(self, dim: str) -> int:
        if dim not in self.dims:
            raise ValueError(f"Dimension '{dim}' not found in DataArray")
        return self.dims.index(dim)

    def _reduce(self, dim: str | None, how: Callable[[Column], Column], nothing=None, refuse: str | None = None) -> DataArray:
        if dim is not None:
            self._axis(dim)
        if refuse and exprs.kind(self.dtype) == "string":
            raise TypeError(f"{refuse} along a dimension requires numeric cells")
        rest = tuple(d for d in self.dims if d != dim) if dim is not None else ()
        value = how(exprs.number(F.col("value"), self.dtype))
        names = [position(d) for d in rest]
        if rest and self.size == 0 and math.prod(self._sizes(rest)):
            df = _grid(self.spark, rest, self._sizes(rest)).withColumn("value", F.lit(nothing).cast("double"))
        elif rest:
            df = self.cells.groupBy(*(f"`{n}`" for n in names)).agg(value.alias("value"))
        else:
            df = self.cells.agg(value.alias("value"))
        return self._from(df, rest, self._sizes(rest), self._coords, self.attrs, self.name)

    # --- element-wise ------------------------------------------------------------------

    def _arithmetic(self, op: str, other, strict: bool, keep_attrs=True) -> DataArray:
        return combine.binary(op, self, other, strict, keep_attrs)

    def add(self, other, strict: bool = False, keep_attrs=True) -> DataArray:
        """Numbers only. ``strict``: a null operand is an error; else it gives null.
        ``keep_attrs``: the left operand's, none, or a function of {left, right}."""
        return self._arithmetic("add", other, strict, keep_attrs)

    def subtract(self, other, strict: bool = False, keep_attrs=True) -> DataArray:
        return self._arithmetic("subtract", other, strict, keep_attrs)

    def multiply(self, other, strict: bool = False, keep_attrs=True) -> DataArray:
        return self._arithmetic("multiply", other, strict, keep_attrs)

    def divide(self, other, strict: bool = False, keep_attrs=True) -> DataArray:
        """IEEE division."""
        return self._arithmetic("divide", other, strict, keep_attrs)

    def power(self, other, strict: bool = False, keep_attrs=True) -> DataArray:
        return self._arithmetic("power", other, strict, keep_attrs)

    sub, mul, div, pow = subtract, multiply, divide, power
    __add__, __sub__, __mul__, __truediv__, __pow__ = add, subtract, multiply, divide, power

    def greater_than(self, other, strict: bool = False, keep_attrs=False) -> DataArray:
        return combine.binary("gt", self, other, strict, keep_attrs)

    def greater_equal(self, other, strict: bool = False, keep_attrs=False) -> DataArray:
        return combine.binary("ge", self, other, strict, keep_attrs)

    def less_than(self, other, strict: bool = False, keep_attrs=False) -> DataArray:
        return combine.binary("lt", self, other, strict, keep_attrs)

    def less_equal(self, other, strict: bool = False, keep_attrs=False) -> DataArray:
        return combine.binary("le", self, other, strict, keep_attrs)

    def equal(self, other, keep_attrs=False) -> DataArray:
        return combine.binary("eq", self, other, False, keep_attrs)

    def not_equal(self, other, keep_attrs=False) -> DataArray:
        return combine.binary("ne", self, other, False, keep_attrs)

    gt, ge, lt, le, eq, ne = greater_than, greater_equal, less_than, less_equal, equal, not_equal

    def elementwise(self, op: Callable[..., Column], *others) -> DataArray:
        """``op`` over columns of doubles of this array and others, broadcast by dimension."""
        got = combine.apply([self, *others], lambda c, t: (op(*(exprs.number(x, k) for x, k in zip(c, t, strict=True))).cast("double"), S.DoubleType()))
        got.attrs, got.name = dict(self.attrs), self.name
        return got

    def where(self, cond, other=None, keep_attrs=False) -> DataArray:
        """Own cells where ``cond`` is truthy, else ``other`` (null by default)."""
        return combine.where(cond, self, other, keep_attrs)

    @staticmethod
    def choose(cond, x, y, keep_attrs=False, prefer_name_from: str | None = None) -> DataArray:
        """x where ``cond`` is truthy, else y, broadcast over all their dimensions."""
        return combine.where(cond, x, y, keep_attrs, prefer_name_from)

    # --- windows -----------------------------------------------------------------------

    def rolling(self, dim: str, window: float, center: bool = False, min_periods: int | None = None) -> rolling.Rolling:
        return rolling.Rolling(self, dim, window, center, min_periods)

    # --- streams -----------------------------------------------------------------------

    def sel_stream(self, selection: dict | None = None, chunk_size: float = 100, dimension: str | None = None, method: str | None = None, tolerance: float | None = None) -> Iterator:
        from ..streaming.chunks import stream_array

        return stream_array(self, selection or {}, chunk_size, dimension, method, tolerance)

    # --- sinks -------------------------------------------------------------------------

    def to_numpy(self) -> np.ndarray:
        """All cells on the driver, in row-major order; missing rows and nulls are None
        (object arrays) unless every cell is present."""
        rows = self.cells.toPandas()
        out = np.full(self.shape, None, object)
        if self.dims:
            out[tuple(rows[position(d)].to_numpy() for d in self.dims)] = rows["value"].astype(object).where(_not_null(self.cells, rows), None).to_numpy()
        elif len(rows):
            out[()] = rows["value"].iloc[0]
        return out

    def data(self):
        """Nested lists with None for null and NaN kept apart (driver data)."""
        values: dict[tuple, object] = {tuple(r[:-1]): r[-1] for r in self.cells.collect()}

        def build(at: tuple[int, ...]):
            if len(at) == self.ndim:
                return values.get(at)
            return [build((*at, i)) for i in range(self.shape[len(at)])]

        return build(())

    values = property(data)

    def flat_data(self) -> dict:
        """{data, shape}: the row-major buffer."""
        nested = self.data()
        return {"data": flatten(nested) if self.dims else [nested], "shape": list(self.shape)}

    def item(self):
        if self.dims:
            raise ValueError("only an array without dimensions has a single value")
        row = self.cells.first()
        return None if row is None else row["value"]

    def get_value(self, at) -> object:
        """One cell by its positions, which must be in range."""
        if len(at) != self.ndim or any(not 0 <= i < n for i, n in zip(at, self.shape, strict=True)):
            raise IndexError(f"positions {tuple(at)} are out of range for shape {self.shape}")
        return self.isel(dict(zip(self.dims, at, strict=True))).item()

    def to_records(self, precision: int = 6) -> DataFrame:
        """Long rows {dimension: label, value}, as a plan. Labels of CF time numbers are
        decoded, numeric labels rounded; values are as they are."""
        df = self.cells
        for d, index in self._coords.items():
            c = F.col(f"`{position(d)}`")
            cal = index._calendar
            if index.step and not cal:
                start, step, _ = index.step
                df = df.withColumn(d, exprs.rounded(F.lit(float(start)) + c * F.lit(float(step)), precision))
                continue
            table = _labels(self.spark, index, d, precision)
            df = df.join(F.broadcast(table) if len(index) <= BROADCAST_CELLS else table, position(d))
        return df.select(*(F.col(f"`{position(d)}`") for d in self.dims), *(F.col(f"`{d}`") for d in self.dims), "value")

    def records(self, precision: int = 6, ordered: bool = False) -> DataFrame:
        """``to_records`` without positions, in row-major order if asked for."""
        df = self.to_records(precision)
        df = df.orderBy(*(f"`{position(d)}`" for d in self.dims)) if ordered and self.dims else df
        return df.drop(*(position(d) for d in self.dims))

    def collect_records(self, precision: int = 6) -> list[dict]:
        return [r.asDict() for r in self.records(precision, ordered=True).collect()]

    def to_object(self) -> dict:
        return {"data": self.data(), "dims": list(self.dims), "coords": self.coords, "attrs": self.attrs, "name": self.name, "shape": list(self.shape)}

    def to_json(self) -> str:
        return json.dumps(json_ready(self.to_object()))

    # --- what labels say ---------------------------------------------------------------

    def get_bounds(self, lat_dim: str | None = None, lon_dim: str | None = None, precision: int | None = 6) -> dict | None:
        """Least and largest numeric labels of the latitude and longitude dimensions."""
        lat = lat_dim or next((d for d in self.dims if d in ("latitude", "lat", "y")), None)
        lon = lon_dim or next((d for d in self.dims if d in ("longitude", "lon", "x")), None)
        ends = [[x for x in self._coords[d] if isinstance(x, (int, float))] if d in self._coords else [] for d in (lat, lon)]
        if not all(ends):
            return None
        r = (lambda v: v) if precision is None else (lambda v: math.floor(v * 10**precision + 0.5) / 10**precision)
        return {"latMin": r(min(ends[0])), "latMax": r(max(ends[0])), "lonMin": r(min(ends[1])), "lonMax": r(max(ends[1]))}

    def calculate_time_resolution(self, time_dim: str = "time") -> dict | None:
        from ..functions.resolution import time_resolution

        if time_dim not in self._coords or len(self._coords[time_dim]) < 2:
            return None
        index = self._coords[time_dim]
        got = time_resolution(index[0], index[1], index.attrs.get("units") or self.attrs.get("units"))
        if got:
            self.attrs |= {"time_resolution": got["value"], "time_resolution_type": got["type"], "time_resolution_unit": got["unit"]}
        return got


def _attrs_of(attrs: dict | None, dim: str) -> dict:
    """Attributes of a dimension: its own if the array has any per dimension, else the array's."""
    own = (attrs or {}).get("_coordAttrs")
    if own is not None and dim in own:
        return own[dim]
    return {k: v for k, v in (attrs or {}).items() if k in ("units", "calendar", "standard_name", "long_name")}


def _grid(spark: SparkSession, dims: tuple[str, ...], shape: tuple[int, ...]) -> DataFrame:
    """Every position of a shape, made in parallel."""
    df, after = spark.range(math.prod(shape)).withColumnRenamed("id", "__at"), 1
    for d, n in reversed(list(zip(dims, shape, strict=True))):
        df, after = df.withColumn(position(d), F.pmod(F.call_function("div", F.col("__at"), F.lit(after)), F.lit(n)).cast("long")), after * n
    return df.select(*(F.col(f"`{position(d)}`") for d in dims))


def _not_null(cells: DataFrame, rows):
    return rows["value"].notna() if rows["value"].dtype == object else rows["value"].notna() | True


def _labels(spark: SparkSession, index: Index, dim: str, precision: int) -> DataFrame:
    """(position, label) of a dimension; CF numbers as decoded text, times as ISO text."""
    out = []
    for x in index:
        if isinstance(x, datetime):
            x = cftime.iso(x)
        elif isinstance(x, (int, float)):
            got = cftime.decode(float(x), *index._calendar) if index._calendar else None
            if got is not None:
                x = cftime.iso(got) if isinstance(got, datetime) else got
            else:
                x = math.floor(float(x) * 10**precision + 0.5) / 10**precision if math.isfinite(x) else float(x)
        out.append(x)
    text = any(isinstance(x, str) for x in out)
    schema = S.StructType([S.StructField(position(dim), S.LongType(), False), S.StructField(dim, S.StringType() if text else S.DoubleType())])
    return spark.createDataFrame([(i, str(x) if text else float(x)) for i, x in enumerate(out)], schema)


def _spark_type(data, dtype=None) -> S.DataType:
    if dtype is None and isinstance(data, np.ndarray):
        dtype = data.dtype
    if dtype is not None and dtype.kind in "iufb":
        given = {"i1": S.ByteType(), "i2": S.ShortType(), "i4": S.IntegerType(), "i8": S.LongType(), "u1": S.ShortType(), "u2": S.IntegerType(), "u4": S.LongType(), "u8": S.DecimalType(20, 0), "f2": S.FloatType(), "f4": S.FloatType(), "f8": S.DoubleType(), "b1": S.BooleanType()}
        return given[f"{dtype.kind}{dtype.itemsize}"]
    seen = [v for v in data if v is not None]
    if seen and all(isinstance(v, bool) for v in seen):
        return S.BooleanType()
    if any(isinstance(v, str) for v in seen):
        if not all(isinstance(v, str) for v in seen):
            raise TypeError("cells must be of one kind: numbers, strings or booleans")
        return S.StringType()
    return S.DoubleType()


def _plain(v, kind: S.DataType):
    if isinstance(kind, (S.DoubleType, S.FloatType)):
        return float(v)
    if isinstance(kind, S.DecimalType):
        from decimal import Decimal

        return Decimal(int(v))
    if isinstance(kind, (S.ByteType, S.ShortType, S.IntegerType, S.LongType)):
        return int(v)
    return bool(v) if isinstance(kind, S.BooleanType) else v


def json_ready(x):
    """NaN and infinities as null, datetimes as text."""
    if isinstance(x, dict):
        return {str(k): json_ready(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [json_ready(v) for v in x]
    if isinstance(x, datetime):
        return cftime.iso(x)
    if isinstance(x, np.generic):
        x = x.item()
    return None if isinstance(x, float) and not math.isfinite(x) else x
