"""Arrays from fact tables: label columns become dimensions."""

from __future__ import annotations

import math
from datetime import date, datetime, time

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dataarray import DataArray, _grid
from ..operators.dataset import Dataset
from ..plans.index import Index
from ..plans.picks import Pick, wanted
from ..plans.source import LISTED, FrameSource, mapping, position

#: Labels of one dimension that the driver holds, at most.
LABELS = 10_000_000
#: Labels of one dimension that are sent to every executor, at most.
BROADCAST = 1 << 20


def _label(x):
    if isinstance(x, date) and not isinstance(x, datetime):
        return datetime.combine(x, time())
    return x


def _distinct(df: DataFrame, dims: list[str]) -> dict[str, list]:
    """Sorted distinct labels of each column, in one pass over the table."""
    if not dims:
        return {}
    tagged = [F.struct(F.lit(k).alias("k"), *(F.col(f"`{e}`").alias(f"c{i}") if e == d else F.lit(None).cast(df.schema[e].dataType).alias(f"c{i}") for i, e in enumerate(dims))) for k, d in enumerate(dims)]
    rows = df.select(F.explode(F.array(*tagged)).alias("x")).select("x.*").distinct().limit(LABELS + 1).collect()
    if len(rows) > LABELS:
        raise ValueError(f"dimensions {dims} have more than {LABELS} labels")
    return {d: sorted(r[k + 1] for r in rows if r["k"] == k and r[k + 1] is not None) for k, d in enumerate(dims)}


class TableFrame:
    """The cells of a fact table, planned anew for the positions that are wanted.

    Wanted positions become filters on the label columns below the aggregation, so that
    they reach the scan; only the wanted part of the grid is completed.
    """

    def __init__(self, df: DataFrame, dims: tuple[str, ...], raw: dict[str, list], aggregates: dict[str, Column], complete: bool):
        self.df, self.dims, self.raw, self.aggregates, self.complete = df, dims, raw, aggregates, complete
        self.shape, self.sparkSession = tuple(len(raw[d]) for d in dims), df.sparkSession
        self.ordered = {d: all(x < y for x, y in zip(raw[d], raw[d][1:], strict=False)) for d in dims}
        self.schema = self._grouped(df).schema

    def _grouped(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*(f"`{d}`" for d in self.dims)).agg(*(c.alias(n) for n, c in self.aggregates.items()))

    def _literal(self, dim: str, x) -> Column:
        kind = self.df.schema[dim].dataType.simpleString()
        # a zone-less instant must not pass through any time zone
        return F.lit(str(x) if kind == "timestamp_ntz" else x).cast(kind)

    def _kept(self, dim: str, pick: Pick) -> tuple[np.ndarray, Column | None]:
        """Wanted positions, and a filter on the labels where they are not all."""
        raw, c = self.raw[dim], F.col(f"`{dim}`")
        at = wanted(pick)
        if len(at) == len(raw):
            return at, None
        if len(at) and at[-1] - at[0] + 1 == len(at) and self.ordered[dim]:
            return at, c.between(self._literal(dim, raw[at[0]]), self._literal(dim, raw[at[-1]]))
        return at, c.isin(*(self._literal(dim, raw[i]) for i in at)) if 0 < len(at) <= LISTED else F.lit(False) if not len(at) else None

    def narrowed(self, picks: dict[str, Pick]) -> DataFrame:
        """Position and value columns of the wanted cells."""
        spark, rows, tables, sizes = self.sparkSession, self.df.dropna(subset=list(self.dims)), [], []
        for d in self.dims:
            at, condition = self._kept(d, picks.get(d, range(len(self.raw[d]))))
            rows = rows if condition is None else rows.filter(condition)
            kind = self.df.schema[d].dataType.simpleString()
            tables.append(spark.createDataFrame([(self.raw[d][i], int(i)) for i in at], f"`{d}` {kind}, `{position(d)}` long"))
            sizes.append(at)
        frame = self._grouped(rows)
        for d, table, at in zip(self.dims, tables, sizes, strict=True):
            frame = frame.join(F.broadcast(table) if len(at) <= BROADCAST else table, d).drop(d)
        names = [position(d) for d in self.dims]
        if self.complete:
            grid = _grid(spark, self.dims, tuple(len(at) for at in sizes))
            for d, at in zip(self.dims, sizes, strict=True):
                if len(at) and at[-1] - at[0] + 1 == len(at):
                    grid = grid.withColumn(position(d), F.col(f"`{position(d)}`") + int(at[0]))
                elif len(at):
                    moved = mapping(spark, at, "__at", position(d))  # (position, number)
                    grid = grid.join(F.broadcast(moved) if len(at) <= BROADCAST else moved, position(d)).drop(position(d)).withColumnRenamed("__at", position(d))
            # a cell has at most one row, so the wanted shape bounds what is broadcast
            few = math.prod(len(at) for at in sizes) <= BROADCAST >> 2
            frame = grid.join(F.broadcast(frame) if few else frame, names, "left")
        return frame.select(*(F.col(f"`{c}`") for c in names), *(F.col(f"`{n}`") for n in self.aggregates))


def from_table(df: DataFrame, dims: list[str], values: dict[str, Column] | list[str], coords: dict[str, list] | None = None, complete: bool = True, attrs: dict | None = None) -> Dataset:
    """A dataset from a table that has a column per dimension.

    ``values``: columns, or aggregate expressions by name; rows are grouped by the label
    columns, which makes cells unique. Labels are the sorted distinct values unless given
    (a given list also filters and orders). ``complete`` adds the cells of the grid that
    no row fills, as nulls; leave it out only for tables known to be dense. Rows with a
    null label belong to no cell.
    """
    aggregates = {v: F.first(v) for v in values} if isinstance(values, list) else values
    given = {d: list(coords[d]) for d in dims if coords and d in coords}
    raw = _distinct(df, [d for d in dims if d not in given]) | given
    frame = TableFrame(df, tuple(dims), raw, aggregates, complete)
    indexes = {d: Index([_label(x) for x in raw[d]]) for d in dims}
    arrays = {n: DataArray(FrameSource(frame, tuple(dims), frame.shape, n, frame.schema[n].dataType), dict(indexes), dict(attrs or {}), n) for n in aggregates}
    return Dataset(arrays, None, dict(attrs or {}))


def write_cells(array: DataArray, path: str, files_by: str | None = None) -> None:
    """Cells as Parquet, sorted by position within files so that ranges prune row groups."""
    names = [f"`{position(d)}`" for d in array.dims]
    df = array.cells
    if names:
        df = df.repartitionByRange(*( [f"`{position(files_by)}`"] if files_by else names)).sortWithinPartitions(*names)
    df.write.parquet(path)


def read_cells(spark, path: str, dims, shape, coords: dict | None = None, attrs: dict | None = None, name: str | None = None) -> DataArray:
    return DataArray.from_cells(spark.read.parquet(path), dims, shape, coords, "value", attrs, name)
