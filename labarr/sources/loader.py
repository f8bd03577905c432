"""Arrays whose cells a function makes, block by block, in tasks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as S

from ..operators.dataarray import DataArray
from ..plans.index import Index
from ..plans.picks import Pick, hull
from ..plans.source import Source, position


class LoaderSource(Source):
    """``load({dimension: range})`` gives a numpy array of those positions. It is called
    once per block that wanted positions meet, with that block's share of them."""

    def __init__(self, spark: SparkSession, dims, shape, load: Callable[[dict[str, range]], np.ndarray], block=None, dtype: S.DataType | None = None):
        self.spark, self.dims, self.shape, self.load = spark, tuple(dims), tuple(shape), load
        self.block, self.dtype = tuple(block or (min(n, 256) or 1 for n in shape)), dtype or S.DoubleType()

    def read(self, picks: dict[str, Pick]) -> DataFrame:
        dims, block, load = self.dims, self.block, self.load
        spans = [hull(picks.get(d, range(n))) for d, n in zip(dims, self.shape, strict=True)]
        first = [s.start // b for s, b in zip(spans, block, strict=True)]
        sizes = [-(-s.stop // b) - f if len(s) else 0 for s, b, f in zip(spans, block, first, strict=True)]
        schema = S.StructType([S.StructField(position(d), S.LongType(), False) for d in dims] + [S.StructField("value", self.dtype)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            kind = to_arrow_type(schema["value"].dataType)
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    at = [int(k) + f for k, f in zip(np.unravel_index(i, sizes) if sizes else (), first, strict=True)]
                    part = [range(max(s.start, a * b), min(s.stop, (a + 1) * b)) for s, a, b in zip(spans, at, block, strict=True)]
                    got = np.asarray(load(dict(zip(dims, part, strict=True))))
                    if got.shape != tuple(len(p) for p in part):
                        raise ValueError(f"the loader gave shape {got.shape} for {part}")
                    where = np.unravel_index(np.arange(got.size), got.shape) if dims else ()
                    cols = [pa.array(w + p.start, pa.int64()) for w, p in zip(where, part, strict=True)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(got.reshape(-1)).cast(kind)], names=[f.name for f in schema])

        total = math.prod(sizes)
        return self.spark.range(0, total, 1, max(1, min(total, 20_000))).mapInArrow(run, schema)


def from_loader(spark: SparkSession, dims, shape, load, coords: dict | None = None, block=None, dtype: S.DataType | None = None, attrs: dict | None = None, name: str | None = None) -> DataArray:
    indexes = {d: Index((coords or {})[d]) if d in (coords or {}) else Index.range(n) for d, n in zip(dims, shape, strict=True)}
    return DataArray(LoaderSource(spark, dims, shape, load, block, dtype), indexes, attrs, name)
