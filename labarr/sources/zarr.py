"""Zarr version 3: metadata on the driver, chunks read and decoded in tasks."""

from __future__ import annotations

import gzip
import json
import math
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import cftime
from ..operators.dataarray import DataArray
from ..operators.dataset import Dataset
from ..plans.index import Index
from ..plans.picks import Pick, hull, wanted
from ..plans.source import Source, position
from .stores import ZarrStore

#: Codecs by name; each has decode(bytes, configuration) and may have encode.
CODECS: dict[str, object] = {}
#: Cells that a task puts in one batch of rows.
BATCH = 1 << 17
#: Data types and their Spark types; unsigned ones need the next larger.
_TYPES = {"bool": ("?", S.BooleanType()), "int8": ("i1", S.ByteType()), "int16": ("i2", S.ShortType()), "int32": ("i4", S.IntegerType()), "int64": ("i8", S.LongType()), "uint8": ("u1", S.ShortType()), "uint16": ("u2", S.IntegerType()), "uint32": ("u4", S.LongType()), "uint64": ("u8", S.DecimalType(20, 0)), "float16": ("f2", S.FloatType()), "float32": ("f4", S.FloatType()), "float64": ("f8", S.DoubleType())}
#: Largest integer that a double holds exactly, for strict reading.
SAFE = 2**53 - 1


def register_codec(name: str, codec: object) -> None:
    CODECS[name] = codec


class ChunkReader:
    """Reads single chunks of one array; pickles with its store and codecs."""

    def __init__(self, store: ZarrStore, path: str, meta: dict, codecs: dict[str, object]):
        self.store, self.path = store, path
        self.shape = tuple(meta["shape"])
        self.chunk = tuple(meta["chunk_grid"]["configuration"]["chunk_shape"])
        self.dtype = np.dtype(_TYPES[meta["data_type"]][0])
        encoding = meta.get("chunk_key_encoding") or {}
        v2 = encoding.get("name") == "v2"
        self.separator = (encoding.get("configuration") or {}).get("separator", "." if v2 else "/")
        self.lead = [] if v2 else ["c"]
        self.steps = [(c["name"], c.get("configuration") or {}) for c in meta.get("codecs") or []]
        self.codecs = {n: codecs[n] for n, _ in self.steps if n in codecs}
        fill = meta.get("fill_value", 0)
        special = {"NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}
        self.fill = special.get(fill, fill) if isinstance(fill, str) else 0 if fill is None else fill

    def key(self, at: tuple[int, ...]) -> str:
        name = self.separator.join([*self.lead, *map(str, at)]) or "0"
        return f"{self.path}/{name}" if self.path else name

    def read(self, at: tuple[int, ...]) -> np.ndarray:
        """A whole chunk; fill values where the store has none."""
        data = self.store.get(self.key(at))
        if data is None:
            return np.full(self.chunk, self.fill, self.dtype)
        order, little = None, True
        for name, conf in reversed(self.steps):
            if name in self.codecs:
                data = self.codecs[name].decode(data, conf)
            elif name == "gzip":
                data = gzip.decompress(data)
            elif name == "zstd":
                import zstandard

                data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
            elif name == "crc32c":
                data = data[:-4]
            elif name == "bytes":
                little = conf.get("endian", "little") != "big"
            elif name == "transpose":
                order = conf["order"]
            else:
                raise ValueError(f"codec '{name}' is not known; register_codec() adds it")
        shape = self.chunk if order is None else tuple(self.chunk[k] for k in order)
        got = np.frombuffer(data, self.dtype.newbyteorder("<" if little else ">")).reshape(shape)
        got = got if order is None else got.transpose(np.argsort(order))
        return np.ascontiguousarray(got).astype(self.dtype.newbyteorder("="))

    def load(self) -> np.ndarray:
        """All of a small array, for labels."""
        out = np.full(self.shape, self.fill, self.dtype)
        for at in np.ndindex(*(-(-n // c) for n, c in zip(self.shape, self.chunk, strict=True))):
            spot = tuple(slice(i * c, min(n, (i + 1) * c)) for i, c, n in zip(at, self.chunk, self.shape, strict=True))
            out[spot] = self.read(at)[tuple(slice(0, s.stop - s.start) for s in spot)]
        return out


class ZarrSource(Source):
    """One row of work for each chunk that wanted positions meet; no other is fetched."""

    def __init__(self, spark: SparkSession, reader: ChunkReader, dims: tuple[str, ...], data_type: str):
        self.spark, self.reader, self.dims, self.shape = spark, reader, tuple(dims), reader.shape
        self.dtype = _TYPES[data_type][1]

    def chunks(self, picks: dict[str, Pick]) -> list[np.ndarray]:
        """Chunk numbers of each dimension that hold wanted positions."""
        out = []
        for d, n, c in zip(self.dims, self.shape, self.reader.chunk, strict=True):
            pick = picks.get(d, range(n))
            if isinstance(pick, np.ndarray) or (isinstance(pick, range) and abs(pick.step) > 1):
                out.append(np.unique(wanted(pick) // c))
            else:
                span = hull(pick)
                out.append(np.arange(span.start // c, -(-span.stop // c)) if len(span) else np.array([], np.int64))
        return out

    def read(self, picks: dict[str, Pick]) -> DataFrame:
        grid, reader, dims, dtype = self.chunks(picks), self.reader, self.dims, self.dtype
        spans = [hull(picks.get(d, range(n))) for d, n in zip(dims, self.shape, strict=True)]
        total = math.prod(len(g) for g in grid)
        sizes = [len(g) for g in grid]
        schema = S.StructType([S.StructField(position(d), S.LongType(), False) for d in dims] + [S.StructField("value", dtype)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = [f.name for f in schema]
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    at = tuple(int(g[k]) for g, k in zip(grid, np.unravel_index(i, sizes) if sizes else (), strict=True))
                    spot = [range(max(s.start, a * c), min(s.stop, (a + 1) * c)) for s, a, c in zip(spans, at, reader.chunk, strict=True)]
                    got = reader.read(at)[tuple(slice(s.start - a * c, s.stop - a * c) for s, a, c in zip(spot, at, reader.chunk, strict=True))]
                    flat = got.reshape(-1)
                    for low in range(0, flat.size, BATCH):
                        part = flat[low : low + BATCH]
                        where = np.unravel_index(np.arange(low, low + part.size), got.shape) if dims else ()
                        cols = [pa.array(w + s.start, pa.int64()) for w, s in zip(where, spot, strict=True)]
                        yield pa.RecordBatch.from_arrays([*cols, _values(part, dtype)], names=names)

        # a task for each chunk, up to a bound on tasks and on requests that a store takes at once
        work = self.spark.range(0, total, 1, max(1, min(total, reader.store.parallel or 20_000)))
        return work.mapInArrow(run, schema)


def _values(part: np.ndarray, dtype: S.DataType) -> pa.Array:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(dtype)
    if isinstance(dtype, S.DecimalType):
        from decimal import Decimal

        return pa.array([Decimal(int(x)) for x in part], kind)
    return pa.array(part.astype(np.float32) if part.dtype == np.float16 else part).cast(kind)


def narrowed(values: np.ndarray) -> np.ndarray:
    """64-bit integers as doubles where that is exact, else an error."""
    if values.dtype.kind in "iu" and values.dtype.itemsize == 8 and values.size and (int(values.max()) > SAFE or int(values.min()) < -SAFE):
        raise ValueError("64-bit integers can not be read as numbers without loss of precision")
    return values.astype(np.float64) if values.dtype.kind in "iu" and values.dtype.itemsize == 8 else values


def _labels(values: np.ndarray, attrs: dict) -> list:
    """Labels of a dimension: CF times as text, all else as numbers."""
    values = narrowed(values)
    units = attrs.get("units")
    if units and cftime.is_time(attrs):
        made = [cftime.decode(float(x), units, attrs.get("calendar") or "standard") for x in values]
        if all(x is not None for x in made):
            return [cftime.iso(x) if isinstance(x, datetime) else x for x in made]
    return values.tolist()


def _folder(key: str) -> str:
    return key.rpartition("/")[0]


def _under(path: str, group: str) -> bool:
    return path == group or path.startswith(group + "/")


def open_zarr(spark: SparkSession, store: ZarrStore, group: str | None = None, strict: bool = True) -> Dataset:
    """A dataset of the arrays of a store (or of a group in it); labels are loaded now,
    cells when they are asked for.

    Without a group: arrays at the root hide nested ones; else a single top-level group is
    taken, and several are an error. 1-d arrays named like a dimension are its labels. A
    store of nothing but labels gives variables that hold the labels' positions.
    ``strict``: 64-bit variables are doubles, and numbers beyond 2^53 an error in reading.
    """
    keys = store.list_metadata_keys()
    if not keys:
        raise ValueError("could not discover metadata: the store lists no keys")
    asked = (group or "").strip("/")
    nodes = [k for k in keys if k.endswith("zarr.json")]
    if not nodes or (asked and not any(_under(_folder(k), asked) for k in nodes)):
        raise ValueError(f'no zarr.json under group "{asked or "/"}"')
    metas: dict[str, dict] = {}
    for k in nodes:
        try:
            meta = json.loads(store.get(k) or b"null")
        except ValueError:
            continue
        if isinstance(meta, dict):
            metas[_folder(k)] = meta
    found = {p: m for p, m in metas.items() if m.get("node_type") == "array"}
    if not asked:
        tops = {p.split("/", 1)[0] for p in found if "/" in p}
        if any("/" not in p for p in found):
            found = {p: m for p, m in found.items() if "/" not in p}
        elif len(tops) > 1:
            raise ValueError("grouped stores with several top-level groups require an explicit group")
        else:
            asked = next(iter(tops), "")
    found = {p: m for p, m in found.items() if not asked or _under(p, asked)}
    if not found:
        raise ValueError(f'found zarr.json files, but none were arrays under "{asked or "/"}"')

    def dims_of(m: dict) -> tuple[str, ...]:
        names = m.get("dimension_names") or []
        return tuple(names) if len(names) == len(m["shape"]) and all(names) else tuple(f"dim_{i}" for i in range(len(m["shape"])))

    name_of = {p: p[len(asked) :].strip("/") or p.rpartition("/")[2] for p in found}
    last = {p: p.rpartition("/")[2] for p in found}
    used = {d for m in found.values() if len(m["shape"]) != 1 for d in dims_of(m)}
    is_label = {p: len(m["shape"]) == 1 and (last[p] in used or dims_of(m) == (last[p],)) for p, m in found.items()}
    readers = {p: ChunkReader(store, p, m, CODECS) for p, m in found.items()}
    labels, coord_attrs = {}, {}
    for p, m in found.items():
        if is_label[p]:
            coord_attrs[last[p]] = dict(m.get("attributes") or {})
            labels[last[p]] = Index(_labels(readers[p].load(), coord_attrs[last[p]]), coord_attrs[last[p]])
    attrs = dict((metas.get(asked) or {}).get("attributes") or {})
    made: dict[str, DataArray] = {}
    for p, m in found.items():
        dims = dims_of(m)
        if is_label[p]:
            continue
        own = {"_zarr_path": p, "_zarr_shape": list(m["shape"]), "_coordAttrs": {d: coord_attrs[d] for d in dims if d in coord_attrs}, "_zarr_data_type": m["data_type"], "codecs": m.get("codecs") or []}
        coords = {d: labels[d] if d in labels and len(labels[d]) == n else Index.range(n) for d, n in zip(dims, m["shape"], strict=True)}
        source = ZarrSource(spark, readers[p], dims, m["data_type"])
        if strict and m["data_type"] in ("int64", "uint64"):
            source = _Strict(source)
        made[name_of[p]] = DataArray(source, coords, dict(m.get("attributes") or {}) | own, name_of[p])
    if not made:
        for d, index in labels.items():
            cells = spark.range(len(index)).select(F.col("id").alias(position(d)), F.col("id").cast("double").alias("value"))
            made[d] = DataArray.from_cells(cells, [d], [len(index)], {d: index}, name=d)
    return Dataset(made, None, attrs, coord_attrs)


class _Strict(Source):
    """64-bit integers as doubles; those that a double can not hold are an error."""

    def __init__(self, source: ZarrSource):
        self.source, self.spark, self.dims, self.shape, self.dtype = source, source.spark, source.dims, source.shape, S.DoubleType()

    def read(self, picks: dict[str, Pick]) -> DataFrame:
        df, v = self.source.read(picks), F.col("value")
        message = F.lit("64-bit integers can not be read as numbers without loss of precision")
        return df.withColumn("value", F.when(F.abs(v) > F.lit(SAFE), F.raise_error(message).cast("double")).otherwise(v.cast("double")))


def write_zarr(array: DataArray, path: str, chunk: tuple[int, ...] | None = None, codecs: list[dict] | None = None) -> None:
    """Write an array of doubles as Zarr to a folder that all executors share; a chunk is
    put together in one task."""
    import os

    shape, chunk = array.shape, chunk or tuple(min(n, 64) for n in array.shape)
    steps = [*(codecs or []), {"name": "bytes", "configuration": {"endian": "little"}}]
    order = [s for s in steps if s["name"] == "bytes"] + [s for s in steps if s["name"] != "bytes"]
    meta = {"zarr_format": 3, "node_type": "array", "shape": list(shape), "data_type": "float64", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunk)}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": "NaN", "codecs": order, "dimension_names": list(array.dims), "attributes": {}}
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "zarr.json"), "w") as f:
        json.dump(meta, f)
    names, known = [position(d) for d in array.dims], dict(CODECS)
    at = [F.call_function("div", F.col(f"`{n}`"), F.lit(c)).alias(f"__c{k}") for k, (n, c) in enumerate(zip(names, chunk, strict=True))]

    def put(key, pdf):
        import pandas as pd

        block = np.full(chunk, np.nan)
        spot = tuple(pdf[n].to_numpy() - int(a) * c for n, a, c in zip(names, key, chunk, strict=True))
        block[spot] = pdf["value"].to_numpy(np.float64)
        data = block.astype("<f8").tobytes()
        for s in order[1:]:
            conf = s.get("configuration") or {}
            data = gzip.compress(data, conf.get("level", 5)) if s["name"] == "gzip" else known[s["name"]].encode(data, conf)
        file = os.path.join(path, "c", *(str(int(a)) for a in key))
        os.makedirs(os.path.dirname(file), exist_ok=True)
        # a task that runs twice replaces its own file
        part = f"{file}.{os.getpid()}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, file)
        return pd.DataFrame({"n": [len(pdf)]})

    rows = array.cells.select(*(F.col(f"`{n}`") for n in names), F.col("value").cast("double").alias("value"), *at)
    rows.groupBy(*(f"__c{k}" for k in range(len(names)))).applyInPandas(put, "n long").agg(F.sum("n")).collect()
