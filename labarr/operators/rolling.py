"""Rolling windows along a dimension."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import exprs
from ..plans.source import position

#: Lanes that are longer are cut into blocks of so many cells (or of a window, if that is
#: longer), so that few lanes still use all cores and no task holds more than a few blocks.
BLOCK = 1 << 17


class Rolling:
    """``mean`` and ``sum`` over trailing or centred windows, clipped at the ends.

    Missing and boolean cells do not count. A result is null unless at least
    ``min_periods`` (default: the window) and at least one cell count.
    """

    def __init__(self, array, dim: str, window: float, center: bool, min_periods: int | None):
        array._axis(dim)
        if not math.isfinite(window) or window < 1:
            raise ValueError("window must be a positive number of cells")
        self.array, self.dim, self.window, self.center = array, dim, int(window), center
        self.least = self.window if min_periods is None else min_periods

    def mean(self):
        return self._apply(True)

    def sum(self):
        return self._apply(False)

    def _apply(self, mean: bool):
        a, at = self.array, position(self.dim)
        lanes = [position(d) for d in a.dims if d != self.dim]
        size = a.shape[a.dims.index(self.dim)]
        after = self.window - 1 - (self.window - 1) // 2 if self.center else 0
        before = self.window - 1 - after
        # beyond the lane's ends there is nothing to add
        before, after = min(before, max(0, size - 1)), min(after, max(0, size - 1))
        number = exprs.number(F.col("value"), a.dtype) if exprs.kind(a.dtype) == "number" else F.lit(None).cast("double")
        df = a.cells.select(*(F.col(f"`{c}`") for c in (*lanes, at)), exprs.present(number).cast("double").alias("value"))
        block = max(BLOCK, before + after + 1)
        df = _blocks(df, at, before, after, block, size > block)
        keys = [*(f"`{c}`" for c in lanes), "__block"]
        # few cells in as many parts as they fill; many as the session and AQE deal them
        parts = a.size // (BLOCK >> 1) + 1
        dealt = df.repartition(*([parts] if parts < int(a.spark.conf.get("spark.sql.shuffle.partitions")) * 2 else []), *keys).sortWithinPartitions(*keys, f"`{at}`")
        schema = S.StructType([*(S.StructField(c, S.LongType()) for c in (*lanes, at)), S.StructField("value", S.DoubleType())])
        df = dealt.mapInArrow(_runner(len(lanes), before, after, max(1, self.least), mean), schema)
        df = df.select(*(F.col(f"`{position(d)}`") for d in a.dims), "value")
        return a._from(df, a.dims, a.shape, a.indexes, a.attrs, a.name)


def _blocks(df: DataFrame, at: str, before: int, after: int, block: int, cut: bool) -> DataFrame:
    """Each row in its own block, and at the rim also in the neighbour that needs it."""
    i = F.col(f"`{at}`")
    if not cut:
        return df.withColumn("__block", F.lit(0).cast("long")).withColumn("__home", F.lit(True))
    own = F.call_function("div", i, F.lit(block))
    to = F.array_compact(F.array(own, F.when(i >= (own + 1) * block - before, own + 1), F.when((i < own * block + after) & (own > 0), own - 1)))
    return df.withColumn("__own", own).withColumn("__block", F.explode(to)).withColumn("__home", F.col("__block") == F.col("__own")).drop("__own")


def totals(x: np.ndarray, first: np.ndarray, before: int, after: int) -> np.ndarray:
    """Window sums of lanes that stand one after the other in ``x``; ``first`` says where
    each begins. Nothing is subtracted, so windows know only their own cells.

    Lanes are laid out with room for their windows' ends and cut into pieces of one window:
    a window is the end of one piece (a sum from its back) and the beginning of the next.
    """
    window, n = before + after + 1, len(x)
    size = np.diff(np.append(first, n))
    begin = np.concatenate(([0], np.cumsum(size + window - 1)))  # of each lane's room
    lane = np.repeat(np.arange(len(first)), size)
    spot = begin[lane] + before + np.arange(n) - first[lane]
    room = np.zeros(-(-(begin[-1] + window) // window) * window)
    room[spot] = x
    pieces = room.reshape(-1, window)
    ahead = np.cumsum(pieces, axis=1).reshape(-1)
    back = np.cumsum(pieces[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    low, high = spot - before, spot + after
    return np.where(low % window == 0, ahead[high], back[low] + ahead[high])


def counts(ok: np.ndarray, first: np.ndarray, before: int, after: int) -> np.ndarray:
    """Cells that count in each window: whole numbers, so differences are exact."""
    n = len(ok)
    so_far = np.concatenate(([0], np.cumsum(ok)))
    lane = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    end = np.append(first[1:], n)
    at = np.arange(n)
    return so_far[np.minimum(at + after + 1, end[lane])] - so_far[np.maximum(at - before, first[lane])]


def _runner(keys: int, before: int, after: int, least: int, mean: bool):
    """Rows arrive by lane and block; what may go on in the next batch waits for it."""

    def done(rows: pa.Table) -> pa.RecordBatch | None:
        cols = [rows.column(k).to_numpy() for k in range(rows.num_columns - 3)]
        block, home = (rows.column(name).to_numpy() for name in ("__block", "__home"))
        at, value = cols[-1], rows.column("value")
        ok = value.is_valid().to_numpy()
        x = np.where(ok, value.to_numpy(), 0.0)
        # a lane ends where a key changes, and where cells are not there
        new = np.concatenate(([True], np.diff(block) != 0))
        for c in cols[:-1]:
            new[1:] |= np.diff(c) != 0
        if not (new[1:] | (np.diff(at) == 1)).all():
            return _spread(cols, at, x, ok, home, new)
        return made(cols, x, ok, home, np.flatnonzero(new))

    def made(cols: list[np.ndarray], x: np.ndarray, ok: np.ndarray, home: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        with np.errstate(invalid="ignore", over="ignore"):
            total, n = totals(x, first, before, after), counts(ok, first, before, after)
            out = total / np.maximum(n, 1) if mean else total
        keep = home.astype(bool)
        values = pa.array(out[keep], mask=(n < least)[keep])
        return pa.RecordBatch.from_arrays([*(pa.array(c[keep]) for c in cols), values], names=[*(f"c{k}" for k in range(len(cols))), "value"])

    def _spread(cols, at, x, ok, home, new) -> pa.RecordBatch:
        """Cells that have no row are missing cells; no result is made for them."""
        lane = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        width = np.append(at[np.append(first[1:], len(at)) - 1] - at[first] + 1, 0)
        begin = np.concatenate(([0], np.cumsum(width[:-1])))
        spot = begin[lane] + at - at[first][lane]
        wide = lambda c, fill: _put(np.full(begin[-1], fill, c.dtype), spot, c)
        return made([wide(c, 0) for c in cols], wide(x, 0), wide(ok, False), wide(home, False), begin[:-1])

    def _put(out: np.ndarray, spot: np.ndarray, values: np.ndarray) -> np.ndarray:
        out[spot] = values
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = _last_lane(batch, keys)
            if held and (last or not _same(held[-1], batch, keys)):
                cut = last if _same(held[-1], batch, keys) else 0
                yield from named(done(pa.Table.from_batches([*held, batch.slice(0, cut)])), batch)
                held, batch, last = [], batch.slice(cut), last - cut
            if last:
                yield from named(done(pa.Table.from_batches([batch.slice(0, last)])), batch)
            held.append(batch.slice(last))
        if held:
            yield from named(done(pa.Table.from_batches(held)), held[0])

    def named(made: pa.RecordBatch, like: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield made.rename_columns([*like.schema.names[: keys + 1], "value"])

    return run


def _key(batch: pa.RecordBatch, keys: int, i: int) -> list:
    return [batch.column(k)[i].as_py() for k in (*range(keys), batch.schema.get_field_index("__block"))]


def _same(a: pa.RecordBatch, b: pa.RecordBatch, keys: int) -> bool:
    """Whether the lane in which ``a`` ends goes on in ``b``."""
    return _key(a, keys, a.num_rows - 1) == _key(b, keys, 0)


def _last_lane(batch: pa.RecordBatch, keys: int) -> int:
    """Where the last lane of a batch begins."""
    new = np.zeros(batch.num_rows - 1, bool)
    for k in (*range(keys), batch.schema.get_field_index("__block")):
        new |= np.diff(batch.column(k).to_numpy()) != 0
    found = np.flatnonzero(new)
    return int(found[-1]) + 1 if len(found) else 0
