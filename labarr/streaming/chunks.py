"""Chunked selections with progress, and micro-batches over cell tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..plans.picks import normalize

#: Bytes of a cell, for sizing chunks.
CELL = 8


@dataclass
class StreamChunk:
    """``data``: a DataArray or Dataset, still a plan. progress is in percent."""

    data: object
    progress: float
    bytes_processed: int
    total_bytes: int
    chunk_index: int
    total_chunks: int


def _spans(wanted) -> bool:
    return isinstance(wanted, (list, tuple, slice, dict))


def chunk_plan(sizes: dict[str, int], selected: dict[str, int], dim: str, chunk_mb: float) -> list[range]:
    """Positions of ``dim`` (within the selection) of each chunk of about ``chunk_mb``."""
    n = selected.get(dim, 1)
    across = math.prod(s for d, s in selected.items() if d != dim) * CELL
    steps = max(1, int(chunk_mb * (1 << 20) // max(1, across)))
    return [range(a, min(n, a + steps)) for a in range(0, n, steps)] or [range(0, n)]


def _dimension(dims: list[str], selection: dict, given: str | None) -> str:
    if given is not None:
        if given not in dims:
            raise ValueError(f"Dimension '{given}' not found")
        return given
    return next((d for d in dims if _spans(selection.get(d))), dims[0])


def _stream(whole, dims: list[str], selection: dict, chunk_mb: float, given: str | None, method, tolerance) -> Iterator[StreamChunk]:
    if not dims:
        yield StreamChunk(whole, 100.0, CELL, CELL, 0, 1)
        return
    dim = _dimension(dims, selection, given)
    picked = whole.sel(selection, method, tolerance)
    sizes = dict(picked.sizes) if hasattr(picked, "sizes") else dict(zip(picked.dims, picked.shape, strict=True))
    total = math.prod(sizes.values()) * CELL
    if dim not in sizes:  # one label on the chunked dimension
        yield StreamChunk(picked, 100.0, total, total, 0, 1)
        return
    plan = chunk_plan(sizes, sizes, dim, chunk_mb)
    done, across = 0, total // max(1, sizes[dim])
    for k, part in enumerate(plan):
        done += len(part) * across
        chunk = picked.isel({dim: normalize(slice(part.start, part.stop), sizes[dim], dim)})
        yield StreamChunk(chunk, 100.0 * (k + 1) / len(plan), done, total, k, len(plan))


def stream_array(array, selection: dict, chunk_mb: float, dimension: str | None, method, tolerance) -> Iterator[StreamChunk]:
    """Chunks of ``array.sel(selection)`` along one dimension: the given one, else the
    first with a list or range, else the first. A chunk keeps the dimension also when it
    is one step long; lists give exactly their points."""
    return _stream(array, list(array.dims), selection, chunk_mb, dimension, method, tolerance)


def stream_dataset(dataset, selection: dict, chunk_mb: float, dimension: str | None, method, tolerance) -> Iterator[StreamChunk]:
    """One chunk plan for all variables; those without the dimension come with every chunk."""
    if not dataset.data_vars:
        raise ValueError("Dataset has no variables to stream")
    return _stream(dataset, dataset.dims, selection, chunk_mb, dimension, method, tolerance)


def micro_batches(spark: SparkSession, path: str, schema, each: Callable[[DataFrame, int], None], checkpoint: str, max_files: int = 64) -> None:
    """Run ``each`` on micro-batches of a growing folder of cell files, once each, until
    what is there has been read; goes on from ``checkpoint`` in a later call."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
