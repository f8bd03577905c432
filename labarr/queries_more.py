"""Further queries: sources, stores, codecs, datasets, label lookup, calendars and policies.

Stores are filled from the small quantity cube (month x flag x status) at plan time; their
cells are read by tasks, as those of any store.
"""

from __future__ import annotations

import json
from datetime import date, datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from .functions import arrays, cftime
from .operators import DataArray, Dataset
from .plans.index import Index, LabelError
from .queries import _CUBE_GRID, _DAILY_AT, _DAYS, _cells, _days, cube, daily, query, table
from .sources import stores, zarr
from .sources.cbor import Link, encode
from .sources.gateway import Gateway, HttpStatusError
from .sources.table import from_table
from .sources.xchacha import DecryptionError, XChaChaCodec

_GRID = f"({_CUBE_GRID})"
_Q = "coalesce(q, 'NaN'::DOUBLE)"


def _grid(spark, sf_dir, name: str = "quantity") -> tuple[np.ndarray, list]:
    """The cube as a numpy array, NaN where it has no rows, and its months."""
    a = cube(spark, sf_dir)[name]
    out = np.full(a.shape, np.nan)
    for r in a.cells.collect():
        if r[3] is not None:
            out[r[0], r[1], r[2]] = r[3]
    return out, a.coords["month"]


def _meta(shape, dims, dtype="float64", chunk=None, attrs=None, codecs=(), fill="NaN") -> dict:
    return {"zarr_format": 3, "node_type": "array", "shape": list(shape), "data_type": dtype, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunk or shape)}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": fill, "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, *codecs], "dimension_names": list(dims), "attributes": attrs or {}}


def _chunks(arr: np.ndarray, chunk, codec=None) -> dict[str, bytes]:
    """Chunk keys and bytes; chunks at the end are filled up."""
    out = {}
    for at in np.ndindex(*(-(-n // c) for n, c in zip(arr.shape, chunk, strict=True))):
        block = np.zeros(chunk, arr.dtype)
        part = arr[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunk, strict=True))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        data = block.tobytes()
        out["/".join(["c", *map(str, at)])] = codec.encode(data) if codec else data
    return out


def _node(path: str, arr: np.ndarray, dims, chunk=None, codec=None, skip=(), **meta) -> dict:
    """The store's entries of one array."""
    chunk = tuple(chunk or arr.shape)
    kept = {f"{path}/{k}": v for k, v in _chunks(arr, chunk, codec).items() if k not in skip}
    return {f"{path}/zarr.json": _meta(arr.shape, dims, str(arr.dtype), chunk, **meta)} | kept


_DIMS = ("month", "flag", "status")


# --- sources ---------------------------------------------------------------------------


@query(f"SELECT i, j, k, q AS value FROM {_GRID} WHERE i < 4")
def nested_source(spark, sf_dir):
    got = np.where(np.isnan(g := _grid(spark, sf_dir)[0][:4]), None, g).tolist()
    return _cells(DataArray.from_nested(spark, got, _DIMS), "i", "j", "k")


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i, n_regionkey::INT AS value, 'int' AS kind FROM nation")
def typed_buffer(spark, sf_dir):
    keys = [r[0] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_regionkey").collect()]
    a = DataArray.from_flat(spark, np.array(keys, np.int32), (len(keys),), ["n"])
    return _cells(a, "i").withColumn("kind", F.lit(a.dtype.simpleString()))


@query(f"SELECT i, j, k, q AS quantity, p AS price, true AS before, false AS after, true AS same FROM {_GRID}")
def lazy_compute(spark, sf_dir):
    lazy = cube(spark, sf_dir)
    kept = lazy.compute()
    flags = [all(d[n].is_lazy for n in d.data_vars) for d in (lazy, kept)]
    same = kept["price"].compute() is kept["price"]
    out = kept.wide().toDF("i", "j", "k", "quantity", "price")
    return out.withColumns({"before": F.lit(flags[0]), "after": F.lit(flags[1]), "same": F.lit(same)})


@query(f"SELECT k, q AS by_value, q AS by_item, q AS by_nested, q AS by_flat, 'month,flag,status' AS dims FROM {_GRID} WHERE i = 2 AND j = 0")
def driver_sinks(spark, sf_dir):
    a = cube(spark, sf_dir)["quantity"].isel({"month": slice(2, 3), "flag": slice(0, 1)})
    nested, flat, told = a.data(), a.flat_data(), a.to_object()
    rows = [(k, a.get_value((0, 0, k)), a.isel({"month": 0, "flag": 0, "status": k}).item(), nested[0][0][k], flat["data"][k], ",".join(told["dims"])) for k in range(flat["shape"][2])]
    return spark.createDataFrame(rows, "k long, by_value double, by_item double, by_nested double, by_flat double, dims string")


@query(f"SELECT (i + 0.5)::DOUBLE AS day, event_type, v AS value, 'copy' AS name, 'x' AS note, true AS apart FROM ({_DAILY_AT})")
def clone_with(spark, sf_dir):
    a = daily(spark, sf_dir)
    a.attrs["note"] = {"deep": [1]}
    made, plain = a.clone_with({"day": [i + 0.5 for i in range(a.shape[0])]}, {"note": "x"}, "copy"), a.clone_with()
    plain.attrs["note"]["deep"].append(2)
    apart = a.attrs["note"]["deep"] == [1] and plain.name == a.name
    return made.records().withColumns({"name": F.lit(made.name), "note": F.lit(made.attrs["note"]), "apart": F.lit(apart)})


@query(f"SELECT strftime(m, '%Y-%m-%dT%H:%M:%S.000Z') AS month, j::DOUBLE AS flag, k::DOUBLE AS status, {_Q} AS value FROM {_GRID} WHERE i BETWEEN 3 AND 40")
def zarr_labels(spark, sf_dir):
    """Months are CF numbers in the store; they are looked up as the dates they mean."""
    arr, months = _grid(spark, sf_dir)
    days = np.array([(m - datetime(1990, 1, 1)).days for m in months], np.int64)
    time = {"standard_name": "time", "units": "days since 1990-01-01", "calendar": "proleptic_gregorian"}
    store = stores.MemoryStore(_node("month", days, ["month"], chunk=[32], attrs=time, fill=0) | _node("quantity", arr, _DIMS, (16, 3, 1)))
    a = zarr.open_zarr(spark, store)["quantity"]
    return a.sel({"month": {"start": cftime.iso(months[3]), "stop": months[40]}}).records()


@query(f"SELECT i, j, k, coalesce(p, 'NaN'::DOUBLE) AS value FROM {_GRID}")
def zarr_group(spark, sf_dir):
    nodes = {}
    for path, name in (("a/0", "quantity"), ("b/0", "price")):
        nodes |= _node(f"{path}/cube", _grid(spark, sf_dir, name)[0], _DIMS, (32, 3, 2))
    return _cells(zarr.open_zarr(spark, stores.MemoryStore(nodes), "b/0")["cube"], "i", "j", "k")


@query(f"SELECT i, j, k, CASE WHEN i // 8 = 1 AND k = 1 THEN -1 ELSE {_Q} END AS value FROM {_GRID}")
def zarr_missing_chunks(spark, sf_dir):
    store = stores.MemoryStore(_node("quantity", _grid(spark, sf_dir)[0], _DIMS, (8, 3, 1), skip=("c/1/0/1",), fill=-1.0))
    return _cells(zarr.open_zarr(spark, store)["quantity"], "i", "j", "k")


@query(f"SELECT i, j, k, floor(coalesce(q, 0)) * 1000003 AS value FROM {_GRID}")
def zarr_int64(spark, sf_dir):
    whole = np.floor(np.nan_to_num(_grid(spark, sf_dir)[0])).astype(np.int64) * 1000003
    return _cells(zarr.open_zarr(spark, stores.MemoryStore(_node("n", whole, _DIMS, (32, 3, 2), fill=0)))["n"], "i", "j", "k")


@query(f"SELECT i * 2.5::DOUBLE AS label, i::DOUBLE AS value FROM (SELECT DISTINCT i FROM {_GRID})")
def zarr_labels_only(spark, sf_dir):
    labels = np.arange(len(_grid(spark, sf_dir)[1])) * 2.5
    return zarr.open_zarr(spark, stores.MemoryStore(_node("label", labels, ["label"])))["label"].records()


@query(f"SELECT i, n AS j, k, {_Q} AS value FROM {_GRID} JOIN (VALUES (0, 2), (1, 0), (2, 2)) AS w(n, j) USING (j) WHERE i IN (3, 50, 51)".replace("SELECT i,", "SELECT CASE i WHEN 51 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS i,"))
def zarr_list(spark, sf_dir):
    """Scattered positions, repeated and out of order; only their chunks are read."""
    store = stores.MemoryStore(_node("quantity", _grid(spark, sf_dir)[0], _DIMS, (8, 1, 1)))
    a = zarr.open_zarr(spark, store)["quantity"].isel({"month": [51, 3, 50], "flag": [2, 0, 2]})
    return _cells(a, "i", "j", "k").withColumns({"i": F.col("i").cast("int"), "j": F.col("j").cast("int")})


@query(f"SELECT 'the title' AS title, 'quantity' AS path, '[' || count(DISTINCT i) || ', ' || count(DISTINCT j) || ', ' || count(DISTINCT k) || ']' AS shape, 'float64' AS data_type, 'kg' AS units, false AS encrypted FROM {_GRID}")
def zarr_attributes(spark, sf_dir):
    store = stores.MemoryStore({"zarr.json": {"node_type": "group", "attributes": {"title": "the title"}}} | _node("quantity", _grid(spark, sf_dir)[0], _DIMS, attrs={"units": "kg"}))
    d = zarr.open_zarr(spark, store)
    own = d["quantity"].attrs
    return spark.createDataFrame([(d.attrs["title"], own["_zarr_path"], str(own["_zarr_shape"]), own["_zarr_data_type"], own["units"], d.is_encrypted)], "title string, path string, shape string, data_type string, units string, encrypted boolean")


# --- content-addressed stores ----------------------------------------------------------


def _sharded(arr: np.ndarray) -> stores.MemoryBlocks:
    """Blocks of a sharded array under "root"; chunk (1, 0, 1) is left out."""
    chunk, blocks = (16, 3, 1), stores.MemoryBlocks({})
    links = []
    for key, data in _chunks(arr, chunk).items():
        link = None if key == "c/1/0/1" else Link(b"\x01\x55" + key.encode())
        links.append(link)
        if link:
            blocks.blocks[str(link)] = data
    shards = [links[i : i + 3] for i in range(0, len(links), 3)]
    blocks.blocks |= {f"s{i}": encode(s) for i, s in enumerate(shards)} | {"meta": json.dumps(_meta(arr.shape, _DIMS, chunk=chunk)).encode()}
    geometry = {"array_shape": list(arr.shape), "chunk_shape": list(chunk), "sharding_config": {"chunks_per_shard": 3}, "shard_cids": [f"s{i}" for i in range(len(shards))]}
    blocks.blocks["root"] = encode({"manifest_version": "sharded_zarr_v2", "metadata": {"quantity/zarr.json": "meta"}, "arrays": {"quantity": geometry}})
    return blocks


_HOLED = f"SELECT i, j, k, CASE WHEN i BETWEEN 16 AND 31 AND k = 1 THEN 'NaN'::DOUBLE ELSE {_Q} END AS value FROM {_GRID}"


@query(f"SELECT *, 'sharded' AS kind FROM ({_HOLED})")
def zarr_sharded(spark, sf_dir):
    kind, store = stores.open_store(_sharded(_grid(spark, sf_dir)[0]), "root")
    return _cells(zarr.open_zarr(spark, store)["quantity"], "i", "j", "k").withColumn("kind", F.lit(kind))


@query("SELECT * FROM (VALUES ('quantity/c/0/0/1', true, 384), ('quantity/0/0/1', true, 384), ('quantity/0.0.1', true, 384), ('quantity/c/1/0/1', false, -1), ('quantity/c/99/0/0', false, -1), ('other/c/0/0/0', false, -1)) v(key, there, bytes)")
def sharded_keys(spark, sf_dir):
    store = stores.ShardedStore.open(_sharded(_grid(spark, sf_dir)[0]), "root")
    keys = ["quantity/c/0/0/1", "quantity/0/0/1", "quantity/0.0.1", "quantity/c/1/0/1", "quantity/c/99/0/0", "other/c/0/0/0"]
    size = lambda data: -1 if data is None else len(data)
    return spark.createDataFrame([(k, store.has(k), size(store.get(k))) for k in keys], "key string, there boolean, bytes int")


@query(f"SELECT i, j, k, {_Q} AS value, 'hamt' AS kind FROM {_GRID}")
def zarr_hash_trie(spark, sf_dir):
    arr, blocks = _grid(spark, sf_dir)[0], stores.MemoryBlocks({})
    nodes = _node("quantity", arr, _DIMS, (8, 1, 1))
    items = {k: json.dumps(v).encode() if isinstance(v, dict) else v for k, v in nodes.items()}
    items["zarr.json"] = json.dumps({"node_type": "group", "consolidated_metadata": {"metadata": {"quantity": nodes["quantity/zarr.json"]}}}).encode()
    kind, store = stores.open_store(blocks, stores.write_trie(blocks, items))
    return _cells(zarr.open_zarr(spark, store)["quantity"], "i", "j", "k").withColumn("kind", F.lit(kind))


@query("SELECT n_name AS name, substr(n_comment, 3, 4) AS part, right(n_comment, 5) AS last, false AS none FROM (SELECT n_name, n_name || ' ' || n_nationkey || ' of the nations' AS n_comment FROM nation)")
def hash_trie_ranges(spark, sf_dir):
    rows = [(r[0], f"{r[0]} {r[1]} of the nations") for r in table(spark, sf_dir, "nation").select("n_name", "n_nationkey").collect()]
    blocks = stores.MemoryBlocks({})
    store = stores.HamtStore(blocks, stores.write_trie(blocks, {n: t.encode() for n, t in rows}, most=1))
    got = [(n, store.get_range(n, 2, 4).decode(), store.get_range(n, suffix=5).decode(), store.has(n + "?")) for n, _ in rows]
    return spark.createDataFrame(got, "name string, part string, last string, none boolean")


def _no_wait(seconds: float) -> None:
    pass


class _Served:
    """A gateway's answers from blocks; every fourth request is told to come again."""

    def __init__(self, blocks: dict[str, bytes]):
        self.blocks, self.calls = blocks, 0

    def __call__(self, method: str, url: str, headers: dict, body: bytes | None) -> tuple[int, dict, bytes]:
        self.calls += 1
        if self.calls % 4 == 0:
            return 503, {"Retry-After": "1"}, b""
        if "/api/v0/" in url:
            verb = url.rpartition("/api/v0/")[2].partition("?")[0]
            return 200, {}, {"add": b'{"Hash": "new"}', "pin/ls": b'{"Keys": {"a": {"Type": "recursive"}}}'}.get(verb, verb.encode())
        cid = url.rpartition("/ipfs/")[2].partition("?")[0]
        if cid not in self.blocks:
            return 404, {}, b""
        span = headers.get("Range", "bytes=0-").removeprefix("bytes=")
        a, _, b = span.partition("-")
        data = self.blocks[cid]
        cut = data[-int(b) :] if not a else data[int(a) : int(b) + 1 if b else None]
        return (206 if "Range" in headers else 200), {}, cut


def _gateway(blocks: dict[str, bytes]) -> Gateway:
    return Gateway("http://gateway", fetch=_Served(blocks), sleep=_no_wait)


@query(f"SELECT *, 32 AS most FROM ({_HOLED})")
def zarr_gateway(spark, sf_dir):
    """A sharded array through a gateway that sometimes refuses; tasks are bounded."""
    gateway = _gateway(_sharded(_grid(spark, sf_dir)[0]).blocks)
    a = zarr.open_zarr(spark, stores.open_store(gateway, "root")[1])["quantity"]
    return _cells(a, "i", "j", "k").withColumn("most", F.lit(a._source.reader.store.parallel))


@query("SELECT * FROM (VALUES ('range', 'cde'), ('suffix', 'ij'), ('save', 'new'), ('pins', 'a:recursive'), ('lost', '404')) v(what, got)")
def gateway_calls(spark, sf_dir):
    g = _gateway({"x": b"abcdefghij"})
    got = [("range", g.cat("x", 2, 3).decode()), ("suffix", g.cat("x", suffix=2).decode()), ("save", g.save(b"data")), ("pins", ",".join(f"{p['cid']}:{p['Type']}" for p in g.pins()))]
    for change in (lambda: g.pin("x"), lambda: g.unpin("x"), lambda: g.pin_update("x", "y")):
        change()
    try:
        g.block("none")
    except HttpStatusError as e:
        got.append(("lost", str(e.status)))
    return spark.createDataFrame(got, "what string, got string")


# --- codecs ----------------------------------------------------------------------------


def _key() -> str:
    return "0x" + "5a" * 32


def _header() -> str:
    return "cube"


def _nonce() -> bytes:
    return bytes(range(24))


@query(f"SELECT i, j, k, {_Q} AS value, true AS encrypted FROM {_GRID}")
def zarr_encrypted(spark, sf_dir):
    codec, name = XChaChaCodec(_key, _header, _nonce), "xchacha20poly1305"
    zarr.register_codec(name, codec)
    try:
        store = stores.MemoryStore(_node("quantity", _grid(spark, sf_dir)[0], _DIMS, (32, 3, 1), codec, codecs=[{"name": name, "configuration": {"header": "other"}}]))
        d = zarr.open_zarr(spark, store)  # readers carry their codecs from here on
    finally:
        zarr.CODECS.pop(name)
    return _cells(d["quantity"], "i", "j", "k").withColumn("encrypted", F.lit(d.detect_encryption()))


@query("SELECT n_name AS name, n_name AS back, length(n_name) + 40 AS bytes, true AS refused FROM nation")
def codec_round_trip(spark, sf_dir):
    codec, other = XChaChaCodec(_key, _header), XChaChaCodec(_key)
    rows = []
    for (name,) in table(spark, sf_dir, "nation").select("n_name").collect():
        sealed = codec.encode(name.encode())
        try:
            refused = not other.decode(sealed, {"header": "wrong"})
        except DecryptionError:
            refused = True
        rows.append((name, codec.decode(sealed).decode(), len(sealed), refused))
    return spark.createDataFrame(rows, "name string, back string, bytes long, refused boolean")


# --- datasets --------------------------------------------------------------------------


@query(f"SELECT i, k, q AS quantity, p AS price FROM (SELECT *, i - 4 AS n FROM {_GRID} WHERE flag = 'N' AND i BETWEEN 4 AND 30)".replace("SELECT i, k,", "SELECT n AS i, k,"))
def dataset_sel(spark, sf_dir):
    d = cube(spark, sf_dir)
    months = d.coords["month"]
    return d.sel({"month": {"start": months[4], "stop": months[30]}, "flag": "N", "none": 1}).wide().toDF("i", "k", "quantity", "price")


@query(f"SELECT n AS i, j, q AS quantity, p AS price FROM {_GRID} JOIN (VALUES (0::BIGINT, 9), (1, 2), (2, 10)) AS w(n, i) USING (i) WHERE k = (SELECT max(k) FROM {_GRID})")
def dataset_isel(spark, sf_dir):
    return cube(spark, sf_dir).isel({"month": [9, 2, 10], "status": -1}).wide().toDF("i", "j", "quantity", "price")


@query(f"SELECT flag, status, p AS value, 'price' AS held, 'month,flag,status' AS used FROM {_GRID} WHERE i = 0")
def dataset_get(spark, sf_dir):
    d = cube(spark, sf_dir).get(["price"])
    return d.isel({"month": 0})["price"].records().withColumns({"held": F.lit(",".join(d.data_vars)), "used": F.lit(",".join(d.coords))})


@query(f"SELECT i, j, k, q AS more, true AS had, false AS has, 'price,more' AS held FROM {_GRID}")
def dataset_variables(spark, sf_dir):
    d = cube(spark, sf_dir)
    d.add_variable("more", d.get_variable("quantity"))
    had = d.remove_variable("quantity") and not d.remove_variable("quantity")
    out = _cells(d["more"], "i", "j", "k").withColumnRenamed("value", "more")
    return out.withColumns({"had": F.lit(had), "has": F.lit(d.has_variable("quantity")), "held": F.lit(",".join(d.data_vars))})


@query(f"SELECT (i * 10)::DOUBLE AS month, flag, status, p AS value FROM {_GRID}")
def dataset_assign(spark, sf_dir):
    d = cube(spark, sf_dir)
    return d.assign_coords({"month": [i * 10 for i in range(d.sizes["month"])]}).to_records("price")[["month", "flag", "status", "value"]]


@query(f"SELECT i, j, k, CASE WHEN q > 4000 THEN q ELSE p END AS quantity, CASE WHEN q > 4000 THEN p END AS price FROM {_GRID}")
def dataset_where(spark, sf_dir):
    d = cube(spark, sf_dir)
    got = d.where(d["quantity"].gt(4000), Dataset({"quantity": d["price"]}))
    return got.wide().toDF("i", "j", "k", "quantity", "price")


_W = "OVER (PARTITION BY j, k ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"


@query(f"SELECT i, j, k, round(CASE WHEN count(q) {_W} >= 3 THEN avg(q) {_W} * 60 END, 2) AS quantity, round(CASE WHEN count(p) {_W} >= 3 THEN avg(p) {_W} * 60 END, 2) AS price FROM {_GRID}")
def dataset_rolling(spark, sf_dir):
    d = cube(spark, sf_dir)
    d.add_variable("still", d["price"].sum("month"))
    got = d.rolling("month", 5, center=True, min_periods=3).mean().drop_vars("still")
    return got.wide().toDF("i", "j", "k", "q", "p").select("i", "j", "k", F.round(F.col("q") * 60, 2).alias("quantity"), F.round(F.col("p") * 60, 2).alias("price"))


@query(f"SELECT i, j, k, q + 8 AS quantity, p + 5 AS price FROM {_GRID}")
def dataset_map(spark, sf_dir):
    return cube(spark, sf_dir).map(lambda a, n: a.add(len(n))).wide().toDF("i", "j", "k", "quantity", "price")


@query(f"SELECT count(DISTINCT i) AS months, count(DISTINCT j) AS flags, count(DISTINCT k) AS states, 'quantity,price' AS vars, 'double' AS kind, 3 AS ndim, count(*) AS size, '0.1.0' AS version, true AS shown, true AS equal FROM {_GRID}")
def properties(spark, sf_dir):
    import labarr

    d = cube(spark, sf_dir)
    a = d["quantity"]
    small = Dataset({"v": a.isel({"month": 0})})
    told = json.loads(small.to_json())
    shown = all(x in repr(d) for x in ("quantity", "month")) and "flag" in repr(a)
    equal = told == json.loads(json.dumps({"dataVars": {"v": json.loads(small["v"].to_json())}, "coords": told["coords"], "attrs": {}, "dims": ["flag", "status"], "sizes": small.sizes}))
    s = d.sizes
    return spark.createDataFrame([(s["month"], s["flag"], s["status"], ",".join(d.data_vars), a.dtype.simpleString(), a.ndim, a.size, labarr.__version__ if hasattr(labarr, "__version__") else labarr.VERSION, shown, equal)], "months long, flags long, states long, vars string, kind string, ndim int, size long, version string, shown boolean, equal boolean")


@query(f"SELECT (i // 8)::INT AS chunk, count(*) AS n, round(sum(q), 2) AS quantity, round(sum(p), 2) AS price, round(100.0::DOUBLE * (i // 8 + 1) / ceil(max(top) / 8.0), 4) AS progress FROM (SELECT *, max(i) OVER () + 1 AS top FROM {_GRID}) GROUP BY i // 8")
def stream_dataset(spark, sf_dir):
    d, out = cube(spark, sf_dir), None
    for c in d.sel_stream({}, chunk_size=8 * 6 * 8 / (1 << 20), dimension="month"):
        one = c.data.wide().agg(F.lit(c.chunk_index).alias("chunk"), F.count("*").alias("n"), F.round(F.sum("quantity"), 2).alias("quantity"), F.round(F.sum("price"), 2).alias("price"), F.lit(round(c.progress, 4)).alias("progress"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT n AS chunk, k, q AS value, 'month,status' AS dims, 1 AS ones FROM {_GRID} JOIN (VALUES (0, 20), (1, 3)) AS w(n, i) USING (i) WHERE j = 1")
def stream_list(spark, sf_dir):
    """Listed points one by one, of a scalar position elsewhere; one label is one chunk."""
    a, out = cube(spark, sf_dir)["quantity"], None
    months, flag = a.coords["month"], a.coords["flag"][1]
    ones = len(list(a.sel_stream({"month": months[3]}, dimension="month")))
    for c in a.sel_stream({"month": [months[20], months[3]], "flag": flag}, chunk_size=16 / (1 << 20)):
        one = _cells(c.data, "i", "k").select(F.lit(c.chunk_index).alias("chunk"), "k", "value", F.lit(",".join(c.data.dims)).alias("dims"), F.lit(ones).alias("ones"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT * FROM (VALUES ('lat', 0.25::DOUBLE, 'degrees_north', ''), ('depth', 10.0, 'm', ''), ('time', 6.0, 'hours', '6-hourly')) v(dim, step, unit, type)")
def coordinate_resolutions(spark, sf_dir):
    coords = {"lat": [50 + 0.25 * i for i in range(3)], "depth": [0, 10, 20], "time": [0, 6, 12]}
    notes = {"time": {"units": "hours since 2000-01-01"}, "depth": {"units": "m"}}
    a = DataArray.from_cells(spark.range(27).select(*(F.expr(f"id div {n} % 3").alias(f"__i_{d}") for d, n in zip(coords, (9, 3, 1), strict=True)), F.col("id").alias("value")), list(coords), (3, 3, 3), {d: Index(x, notes.get(d)) for d, x in coords.items()})
    d = Dataset({"v": a}, coord_attrs=notes)
    got = d.calculate_coordinate_resolutions()
    rows = [(k, float(x.get("resolution", x.get("value"))), x["unit"], d.coord_attrs[k].get("resolution_type", "")) for k, x in got.items()]
    return spark.createDataFrame(rows, "dim string, step double, unit string, type string")


@query("SELECT k AS i, round(CASE WHEN count(v) OVER w >= 300 THEN (sum(v) OVER w)::DOUBLE END, 2) AS value FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS k, (CASE WHEN o_orderkey % 1000 = 0 THEN NULL ELSE o_totalprice END)::DECIMAL(18,4) AS v FROM orders) WINDOW w AS (ORDER BY k ROWS BETWEEN 299 PRECEDING AND CURRENT ROW) QUALIFY k >= 1200 OR value IS NULL")
def rolling_scales(spark, sf_dir):
    """A cell of 1e17 near the beginning leaves no trace in windows that do not hold it."""
    rows = table(spark, sf_dir, "orders")
    least, n = rows.agg(F.min("o_orderkey"), F.count("*")).first()
    i = F.col("o_orderkey") - least
    value = F.when(F.col("o_orderkey") % 1000 == 0, None).when(i == 600, 1e17).otherwise(F.col("o_totalprice"))
    a = DataArray.from_cells(rows.select(i.alias("__i_x"), value.alias("value")), ["x"], [n])
    got = _cells(a.rolling("x", 300).sum(), "i").withColumn("value", F.round("value", 2))
    return got.filter("i >= 1200 or value is null")


# --- label lookup ----------------------------------------------------------------------


def _found(index: Index, value, method=None, tolerance=None) -> int:
    try:
        return index.find(value, "x", method, tolerance)
    except LabelError:
        return -1


_BALANCES = "(SELECT s_acctbal AS b, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier)"


@query(f"SELECT t::INT AS target, arg_min(i, struct_pack(d := abs(b - t), i := i)) AS at FROM {_BALANCES}, range(-500, 9000, 750) w(t) GROUP BY t")
def label_unsorted(spark, sf_dir):
    index = Index([r[0] for r in table(spark, sf_dir, "supplier").orderBy("s_suppkey").select("s_acctbal").collect()])
    return spark.createDataFrame([(t, index.find(t, "", "nearest")) for t in range(-500, 9000, 750)], "target int, at long")


@query("SELECT t::INT AS target, CASE WHEN least(t % 10, 10 - t % 10) <= 3 THEN (t + 5) // 10 ELSE -1 END AS plain, CASE WHEN t % 10 <= 4 THEN t // 10 ELSE -1 END AS before, CASE WHEN (10 - t % 10) % 10 <= 4 THEN (t + 9) // 10 ELSE -1 END AS after, CASE WHEN t % 10 = 0 THEN t // 10 ELSE -1 END AS exact FROM range(0, 90) w(t) WHERE t % 10 != 5")
def label_tolerance(spark, sf_dir):
    """Labels 0, 10, 20, ...: what is farther off than the tolerance is not found."""
    index = Index([10.0 * i for i in range(10)])
    rows = [(t, _found(index, t, None, 3), _found(index, t, "ffill", 4), _found(index, t, "bfill", 4), _found(index, t)) for t in range(90) if t % 10 != 5]
    return spark.createDataFrame(rows, "target int, plain long, before long, after long, exact long")


@query("SELECT i::INT AS i, i AS noisy, -1::BIGINT AS off, least(greatest(i - 1, 0), 39) AS even FROM range(40) w(i)")
def label_float_noise(spark, sf_dir):
    """Sums of a tenth find the label meant, what is really off does not; even steps need no list."""
    index, even = Index([round(0.1 * i, 10) for i in range(40)]), Index.range(40, 5.0, 0.5)
    total, rows = 0.0, []
    for i in range(40):
        rows.append((i, _found(index, total), _found(index, 0.1 * i + 1e-9), even.find(4.5 + 0.5 * i + 0.1, "", "nearest")))
        total += 0.1
    return spark.createDataFrame(rows, "i int, noisy long, off long, even long")


@query("SELECT h::INT AS h, h AS plain, h AS zoned, h AS aware, h AS texts, CASE WHEN h % 6 = 0 THEN h // 6 ELSE -1 END AS numbers, -1::BIGINT AS bad FROM range(24) w(h)")
def label_dates(spark, sf_dir):
    """Hours looked up as texts without and with zones, as datetimes, among texts and CF numbers."""
    day = datetime(2021, 3, 1)
    hours = [day + timedelta(hours=h) for h in range(24)]
    index, texts = Index(hours), Index([f"{x:%Y-%m-%dT%H:%M:%S}" for x in hours])
    numbers = Index([0, 6, 12, 18], {"units": "hours since 2021-03-01"})
    rows = []
    for h, x in enumerate(hours):
        zoned = f"{x + timedelta(hours=5):%Y-%m-%d %H:%M:%S} +05:00"
        rows.append((h, _found(index, f"{x:%Y-%m-%d %H:%M:%S}"), _found(index, zoned), _found(index, x), _found(texts, x), _found(numbers, x), _found(index, f"2021-02-30T{h:02d}:00:00")))
    return spark.createDataFrame(rows, "h int, plain long, zoned long, aware long, texts long, numbers long, bad long")


@query("SELECT n::INT AS n, strftime(DATE '2001-01-01' + 0, '2000-') || lpad((n // 30 + 1)::VARCHAR, 2, '0') || '-' || lpad((n % 30 + 1)::VARCHAR, 2, '0') AS label, n AS at, n AS near FROM range(0, 90) w(n)")
def label_calendar(spark, sf_dir):
    """Days of a 360-day calendar by their dates, the 30th of February too."""
    index = Index([float(i) for i in range(90)], {"units": "days since 2000-01-01", "calendar": "360_day"})
    rows = [(n, t := f"2000-{n // 30 + 1:02d}-{n % 30 + 1:02d}", index.find(t), index.find(t + "T06:00:00", "", "nearest")) for n in range(90)]
    return spark.createDataFrame(rows, "n int, label string, at long, near long")


# --- calendars -------------------------------------------------------------------------


@query(f"SELECT o_orderkey, strftime(DATE '1990-01-01' + n::INT - 13, '%Y-%m-%dT00:00:00') AS label FROM ({_DAYS})")
def cf_decode_julian(spark, sf_dir):
    """1990-01-14 of the Gregorian calendar is 1990-01-01 of the Julian one."""
    return _days(spark, sf_dir).select("o_orderkey", cftime.decode_column(F.col("n") - 13, "days since 1990-01-01", "julian").alias("label"))


@query(f"SELECT o_orderkey, (1990 + n // 366)::VARCHAR || strftime(DATE '2000-01-01' + (n % 366)::INT, '-%m-%dT00:00:00') AS label FROM ({_DAYS})")
def cf_decode_all_leap(spark, sf_dir):
    return _days(spark, sf_dir).select("o_orderkey", cftime.decode_column(F.col("n"), "days since 1990-01-01", "all_leap").alias("label"))


@query("SELECT n::INT AS n, CASE WHEN n < 4 THEN '1582-10-0' || (n + 1) ELSE strftime(DATE '1582-10-15' + (n - 4)::INT, '%Y-%m-%d') END || 'T00:00:00' AS label, n::DOUBLE AS back FROM range(0, 40) w(n)")
def cf_decode_gap(spark, sf_dir):
    """The fourth of October 1582 is followed by the fifteenth."""
    units = "days since 1582-10-01"
    rows = [(n, float(n), cftime.encode(cftime.text_of(cftime.micros(n, units), "standard"), units)) for n in range(40)]
    df = spark.createDataFrame(rows, "n int, v double, back double")
    return df.select("n", cftime.decode_column(F.col("v"), units, "standard").alias("label"), "back")


@query("SELECT * FROM (VALUES ('hours since 1990-01-01 12:00:00 +6', 'hour', '1990-01-01T06:00:00.000Z', '1990-01-01 07:30:00'), ('DAYS since 2000-01-01', 'day', '2000-01-01T00:00:00.000Z', '2000-01-02 12:00:00'), ('ms since 1970-01-01', 'millisecond', '1970-01-01T00:00:00.000Z', '1970-01-01 00:00:00.001500'), ('months since 2000-01-01', 'month', '2000-01-01T00:00:00.000Z', ''), ('parsecs since 2000-01-01', '', '', '')) v(units, unit, reference, later)")
def cf_units(spark, sf_dir):
    rows = []
    for units in ("hours since 1990-01-01 12:00:00 +6", "DAYS since 2000-01-01", "ms since 1970-01-01", "months since 2000-01-01", "parsecs since 2000-01-01"):
        got, later = cftime.parse_cf_time_units(units), cftime.micros(1.5, units)
        when = "" if later is None else str(datetime(1970, 1, 1) + timedelta(microseconds=later))
        rows.append((units, got["unit"] if got else "", cftime.iso(got["reference_date"]) if got else "", when))
    return spark.createDataFrame(rows, "units string, unit string, reference string, later string")


@query("SELECT * FROM (VALUES (60, 'noleap', '2000-03-02T00:00:00', true, '2000-03-02'), (59, '360_day', '2000-02-30T00:00:00', true, ''), (366, 'standard', '2001-01-01T00:00:00', true, '2001-01-01')) v(value, calendar, shown, time, day)")
def cf_display(spark, sf_dir):
    rows = []
    for value, calendar in ((60, "noleap"), (59, "360_day"), (366, "standard")):
        attrs = {"units": "days since 2000-01-01", "calendar": calendar}
        when = cftime.cf_time_to_date(value, attrs["units"], calendar)
        rows.append((value, calendar, cftime.format_coordinate(float(value), attrs), cftime.is_time(attrs) and not cftime.is_time({"units": "m"}), cftime.format_date(when, False) if when else ""))
    return spark.createDataFrame(rows, "value int, calendar string, shown string, time boolean, day string")


# --- arrays, policies, refusals --------------------------------------------------------


@query("SELECT vec_id, embedding[3] AS was, -1.5::DOUBLE AS now, embedding[4] AS kept, true AS same, false AS changed FROM embeddings".replace("embedding[3] AS was", "embedding[3]::DOUBLE AS was").replace("embedding[4] AS kept", "embedding[4]::DOUBLE AS kept"))
def array_edits(spark, sf_dir):
    """Set a component; the helpers of driver data and of columns agree."""
    nested = arrays.reshape([1, 2, 3, 4], [2, 2])
    edited = arrays.set_at(nested, (1, 0), 9)
    same = arrays.arrays_equal(nested, [[1, 2], [3, 4]]) and arrays.get_at(edited, (1, 0)) == 9 and nested[1][0] == 3
    changed = arrays.arrays_equal(nested, edited) or arrays.arrays_equal([1], [True])
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("e"))
    grid = arrays.reshape_column(arrays.set_at_column(F.col("e"), 2, F.lit(-1.5)), [2, 2])
    return df.select("vec_id", F.get("e", F.lit(2)).alias("was"), arrays.at_column(grid, (1, 0)).alias("now"), arrays.at_column(grid, (1, 1)).alias("kept"), F.lit(same).alias("same"), F.lit(changed).alias("changed"))


@query("SELECT * FROM (VALUES ('add', 'left', 'kg'), ('gt', 'left', ''), ('callback', 'left', 'kg|m'), ('where', 'left', ''), ('where_y', 'left', 'm'), ('prefer', 'right', '')) v(what, name, units)")
def attribute_policies(spark, sf_dir):
    cells = spark.range(3).select(F.col("id").alias("__i_x"), F.col("id").cast("double").alias("a"))
    left, right = (DataArray.from_cells(cells, ["x"], [3], None, "a", {"units": u}, n) for u, n in (("kg", "left"), ("m", "right")))
    both = lambda g: {"units": g["left"].attrs["units"] + "|" + g["right"].attrs["units"]}
    made = {"add": left.add(right), "gt": left.gt(right), "callback": left.add(right, keep_attrs=both), "where": left.where(left.gt(1), right), "where_y": left.where(left.gt(1), right, keep_attrs="y"), "prefer": DataArray.choose(left.gt(1), left, right, prefer_name_from="y")}
    return spark.createDataFrame([(k, a.name, a.attrs.get("units", "")) for k, a in made.items()], "what string, name string, units string")


@query("SELECT * FROM (VALUES ('text sum'), ('text method'), ('bad date'), ('month units'), ('label length'), ('concat sizes'), ('concat variables'), ('write sharded'), ('short buffer'), ('unknown label'), ('not coordinates')) v(refused)")
def refusals(spark, sf_dir):
    """What must be an error is one."""
    num = DataArray.from_nested(spark, [1.0, None], ["x"])
    text = DataArray.from_nested(spark, ["a", "b"], ["x"])
    one, two = (Dataset({"v": DataArray.from_nested(spark, [[0.0] * n] * 2, ["t", "x"])}) for n in (2, 3))
    store = stores.ShardedStore(stores.MemoryBlocks({}), {"manifest_version": "sharded_zarr_v2", "metadata": {}, "arrays": {}})
    tries = {
        "text sum": lambda: text.add(1),
        "text method": lambda: Index(["a", "b"]).find("a", "x", "nearest"),
        "bad date": lambda: Index([datetime(2021, 1, 1)]).find("2021-02-30", "x"),
        "month units": lambda: Index([0.0, 1.0], {"units": "months since 2000-01-01", "calendar": "noleap"}).find(date(2000, 1, 31).isoformat(), "x"),
        "label length": lambda: num.assign_coords({"x": [1, 2, 3]}),
        "concat sizes": lambda: one.concat(two, "t"),
        "concat variables": lambda: one.concat(one.rename({"v": "w"}), "t"),
        "write sharded": lambda: store.set("c/0", b""),
        "short buffer": lambda: DataArray.from_flat(spark, [1, 2, 3], (2, 2)),
        "unknown label": lambda: num.sel({"x": 7}),
        "not coordinates": lambda: num.add(DataArray.from_nested(spark, [1.0, 2.0], ["x"], {"x": [5, 6]})),
    }
    found = []
    for name, attempt in tries.items():
        try:
            attempt()
        except (ValueError, TypeError, KeyError, NotImplementedError):
            found.append((name,))
    return spark.createDataFrame(found, "refused string")


@query("SELECT floor(min(s_acctbal) * 1e6 + 0.5) / 1e6 AS lat_min, floor(max(s_acctbal) * 1e6 + 0.5) / 1e6 AS lat_max, floor(min(c_acctbal) * 1e6 + 0.5) / 1e6 AS lon_min, floor(max(c_acctbal) * 1e6 + 0.5) / 1e6 AS lon_max FROM supplier, customer")
def bounds(spark, sf_dir):
    """Of an array whose latitudes are suppliers' balances and whose longitudes customers'."""
    lat = from_table(table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("lat")), ["lat"], {"n": F.count("*")})["n"]
    lon = from_table(table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("lon")), ["lon"], {"n": F.count("*")})["n"]
    got = lat.multiply(lon).get_bounds()
    return spark.createDataFrame([tuple(float(got[k]) for k in ("latMin", "latMax", "lonMin", "lonMax"))], "lat_min double, lat_max double, lon_min double, lon_max double")


@query("SELECT l_orderkey, l_linenumber, ((l_orderkey % 100) * 8 + l_linenumber) // 6 AS shard, ((l_orderkey % 100) * 8 + l_linenumber) % 6 AS slot, true AS same FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def shard_locate(spark, sf_dir):
    """Shard and slot of chunk (orderkey mod 100, linenumber) of a 100 x 8 grid, 6 chunks a shard."""
    index = stores.ShardIndex("a", [100, 8], [1, 1], {"chunks_per_shard": 6}, [None] * 134)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    shard, slot = index.locate_columns([F.col("l_orderkey") % 100, F.col("l_linenumber")])
    plain = F.array(*(F.lit(10 * s + k) for i in range(100) for j in range(8) for s, k in [index.locate([i, j])]))
    told = F.get(plain, (F.col("l_orderkey") % 100 * 8 + F.col("l_linenumber")).cast("int"))
    return rows.select("l_orderkey", "l_linenumber", shard.alias("shard"), slot.alias("slot"), (told == shard * 10 + slot).alias("same"))
