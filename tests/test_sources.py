import json
import re
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from labarr.operators import DataArray
from labarr.sources import blake3, cbor, gateway, stores, xchacha, zarr
from labarr.sources.cbor import Link
from labarr.sources.table import from_table, read_cells, write_cells


def meta(shape, dims=None, dtype="float64", chunk=None, attrs=None, codecs=None, fill=0):
    return {"zarr_format": 3, "node_type": "array", "shape": shape, "data_type": dtype, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunk or shape}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": fill, "codecs": codecs or [{"name": "bytes", "configuration": {"endian": "little"}}], "dimension_names": dims, "attributes": attrs or {}}


def f8(*values):
    return struct.pack(f"<{len(values)}d", *values)


# --- CBOR, BLAKE3, XChaCha20-Poly1305 ------------------------------------------------------


def test_cbor_round_trip_and_canonical_form():
    x = {"b": [1, -1, 1.5, None, True, b"\x01", Link(b"\x01\x71\x12")], "aa": {"": "é"}, "n": 2**40, "m": -(2**33)}
    assert cbor.decode(cbor.encode(x)) == x
    assert cbor.encode({"bb": 1, "a": 2}) == bytes.fromhex("a26161026262620" + "1")
    for bad in (b"", b"\x82\x01", b"\x01\x01", b"\x9f\xff", b"\x65ab", b"\xd8\x29\x01", b"\xf8\x20"):
        with pytest.raises(cbor.CborError):
            cbor.decode(bad)


def test_shard_entries_are_found_without_decoding_the_rest():
    a, b = Link(b"\x01aa"), Link(b"\x01bb")
    shard = cbor.encode([a, b, None, a])
    assert [cbor.entry(shard, i) for i in range(4)] == [a, b, None, a]
    with pytest.raises(IndexError):
        cbor.entry(shard, 4)
    with pytest.raises(cbor.CborError, match="neither"):
        cbor.entry(cbor.encode(["x"]), 0)
    with pytest.raises(cbor.CborError, match="not a list"):
        cbor.entry(cbor.encode({"a": 1}), 0)


def test_blake3_vectors():
    data = lambda n: bytes(i % 251 for i in range(n))
    known = {0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", 1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213", 1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7", 1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444", 2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a"}
    for n, digest in known.items():
        assert blake3.blake3(data(n)).hex() == digest


def test_xchacha_vectors():
    key, nonce, header = bytes(range(0x80, 0xA0)), bytes(range(0x40, 0x58)), bytes.fromhex("50515253c0c1c2c3c4c5c6c7")
    plain = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    sealed = xchacha.seal(key, nonce, plain, header)
    assert sealed[:16].hex() == "bd6d179d3e83d43b9576579493c0e939" and sealed[-16:].hex() == "c0875924c1c7987947deafd8780acf49"
    assert xchacha.unseal(key, nonce, sealed, header) == plain
    assert xchacha.subkey(bytes(range(32)), bytes.fromhex("000000090000004a0000000031415927")).hex() == "82413b4227b27bfed30e42508a877d73a0f9e4d58a74a853c12ec41326d3ecdc"
    for k, h in ((bytes(32), header), (key, b"")):
        with pytest.raises(xchacha.DecryptionError):
            xchacha.unseal(k, nonce, sealed, h)


def test_codec_keys_headers_and_lengths():
    codec = xchacha.XChaChaCodec(lambda: "0x" + "ab" * 32, lambda: b"h", lambda: bytes(24))
    sealed = codec.encode(b"data")
    assert codec.decode(sealed, {"header": "loses against the callback"}) == b"data" and len(sealed) == 44
    assert xchacha.XChaChaCodec(lambda: bytes.fromhex("ab" * 32)).decode(sealed, {"header": "h"}) == b"data"
    with pytest.raises(xchacha.DecryptionError, match="short"):
        codec.decode(sealed[:39])
    for bad in (b"x", "zz" * 32, "ab"):
        with pytest.raises(ValueError, match="key"):
            xchacha.XChaChaCodec(lambda bad=bad: bad).encode(b"")
    with pytest.raises(ValueError, match="nonce"):
        xchacha.XChaChaCodec(lambda: bytes(32), nonce=lambda: bytes(12)).encode(b"")
    assert codec.decode(codec.encode(b"")) == b""


# --- Zarr ----------------------------------------------------------------------------------


def test_open_and_select(spark):
    store = stores.MemoryStore({"zarr.json": {"node_type": "group", "attributes": {"title": "t"}}, "x/zarr.json": meta([4], ["x"]), "x/c/0": f8(10, 20, 30, 40), "temp/zarr.json": meta([2, 4], ["y", "x"], chunk=[1, 2]), "temp/c/0/0": f8(11, 22), "temp/c/0/1": f8(33, 44), "temp/c/1/1": f8(7, 8)})
    d = zarr.open_zarr(spark, store)
    assert d.attrs == {"title": "t"} and d.coords == {"y": [0, 1], "x": [10, 20, 30, 40]}
    assert d["temp"].data() == [[11, 22, 33, 44], [0, 0, 7, 8]]  # a missing chunk is fill
    assert d["temp"].sel({"x": 30, "y": 0}).item() == 33 and d["temp"].isel({"x": [3, 0], "y": 0}).data() == [44, 11]
    assert d["temp"].sum("x").data() == [110, 15] and d["temp"].attrs["_zarr_path"] == "temp"


def test_only_wanted_chunks_are_read(spark):
    class Counting(stores.MemoryStore):
        def get(self, key):
            if "/c/" in key and key not in ("v/c/0", "v/c/49"):
                raise AssertionError(f"{key} was not asked for")
            return super().get(key)

    store = Counting({"v/zarr.json": meta([5000], ["i"], chunk=[100])} | {f"v/c/{k}": f8(*(2.0 * i for i in range(100 * k, 100 * k + 100))) for k in (0, 49)})
    v = zarr.open_zarr(spark, store)["v"]
    assert v.isel({"i": [0, 4999]}).data() == [0, 9998]
    assert [len(c) for c in v._source.chunks({"i": np.array([0, 4999])})] == [2]
    with pytest.raises(Exception, match="was not asked for"):
        v.isel({"i": [0, 150]}).data()  # store errors fail the read


def test_groups_and_errors(spark):
    two = {"0/data/zarr.json": meta([1], ["q"]), "1/data/zarr.json": meta([2], ["q"])}
    assert zarr.open_zarr(spark, stores.MemoryStore(two), "1")["data"].shape == (2,)
    with pytest.raises(ValueError, match="explicit group"):
        zarr.open_zarr(spark, stores.MemoryStore(two))
    assert zarr.open_zarr(spark, stores.MemoryStore({k: v for k, v in two.items() if k[0] == "0"})).data_vars == ["data"]
    mixed = {"a/zarr.json": meta([2, 2]), "g/b/zarr.json": meta([1])}
    assert zarr.open_zarr(spark, stores.MemoryStore(mixed)).data_vars == ["a"]
    assert zarr.open_zarr(spark, stores.MemoryStore(mixed))["a"].dims == ("dim_0", "dim_1")
    for data, what in (({}, "discover"), ({"x.json": {}}, "no zarr.json"), ({"zarr.json": {"node_type": "group"}}, "none were arrays"), ({"zarr.json": b"{bad"}, "none were arrays")):
        with pytest.raises(ValueError, match=what):
            zarr.open_zarr(spark, stores.MemoryStore(data))


def test_consolidated_metadata(spark):
    nodes = {"x": meta([2], ["x"]), "v": meta([1, 2], ["y", "x"])}
    for held in (nodes, {"metadata": nodes, "kind": "inline"}):
        store = stores.MemoryStore({"zarr.json": {"node_type": "group", "attributes": {"a": 1}, "consolidated_metadata": held}, "x/c/0": f8(5, 6), "v/c/0/0": f8(7, 8)})
        store.list_metadata_keys = lambda: []
        d = zarr.open_zarr(spark, stores.ConsolidatedStore(store))
        assert d["v"].sel({"x": 6, "y": 0}).item() == 8 and d.attrs == {"a": 1}


def test_labels_only_and_wrong_lengths(spark):
    only = zarr.open_zarr(spark, stores.MemoryStore({"x/zarr.json": meta([3], ["x"]), "x/c/0": f8(5, 6, 7)}))
    assert only["x"].data() == [0, 1, 2] and only.coords == {"x": [5, 6, 7]}
    short = zarr.open_zarr(spark, stores.MemoryStore({"x/zarr.json": meta([2], ["x"]), "x/c/0": f8(5, 6), "v/zarr.json": meta([1, 3], ["y", "x"])}))
    assert short["v"].coords["x"] == [0, 1, 2]


def test_cf_time_labels(spark):
    attrs = {"standard_name": "time", "units": "days since 2000-01-01", "calendar": "360_day"}
    d = zarr.open_zarr(spark, stores.MemoryStore({"time/zarr.json": meta([3], ["time"], attrs=attrs), "time/c/0": f8(58, 59, 60), "v/zarr.json": meta([3, 1], ["time", "o"]), "v/c/0/0": f8(580, 590, 600)}))
    assert d.coords["time"] == ["2000-02-29T00:00:00.000Z", "2000-02-30T00:00:00", "2000-03-01T00:00:00.000Z"]
    v = d["v"].isel({"o": 0})
    assert v.sel({"time": "2000-03-01T00:00:00"}).item() == 600
    assert v.sel({"time": "2000-02-30T18:00:00"}, method="nearest").item() == 600


def test_types_and_codecs(spark):
    import gzip

    ints = struct.pack("<4q", -5, 0, 42, 2**53 - 1)
    big = struct.pack("<2q", 1, 2**53 + 1)
    little = {"name": "bytes", "configuration": {"endian": "little"}}
    arrays = {
        "a": (meta([1, 4], ["a0", "a1"], "int64"), ints),
        "b": (meta([1, 2], ["b0", "b1"], "int64"), big),
        "f": (meta([2, 3], ["r", "c"], "float32", codecs=[{"name": "bytes", "configuration": {"endian": "big"}}, {"name": "gzip"}]), gzip.compress(struct.pack(">6f", 0.5, 1.5, 2.5, 3.5, 4.5, 5.5))),
        "u": (meta([1, 2], ["u0", "u1"], "uint8"), b"\x01\xff"),
        "t": (meta([2, 3], ["t0", "t1"], codecs=[{"name": "transpose", "configuration": {"order": [1, 0]}}, little]), f8(1, 4, 2, 5, 3, 6)),
        "z": (meta([1, 1], ["z0", "z1"], codecs=[{"name": "strange"}]), b"1"),
    }
    store = stores.MemoryStore({f"{n}/zarr.json": m for n, (m, _) in arrays.items()} | {f"{n}/c/0/0": x for n, (_, x) in arrays.items()})
    d = zarr.open_zarr(spark, store)
    assert d["a"].data() == [[-5, 0, 42, 2**53 - 1]] and d["u"].data() == [[1, 255]]
    assert d["f"].isel({"c": [2, 0]}).data() == [[2.5, 0.5], [5.5, 3.5]] and d["t"].data() == [[1, 2, 3], [4, 5, 6]]
    with pytest.raises(Exception, match="without loss of precision"):
        d["b"].data()
    assert zarr.open_zarr(spark, store, strict=False)["b"].data() == [[1, 2**53 + 1]]
    with pytest.raises(Exception, match="not known"):
        d["z"].data()


def test_encrypted_array(spark):
    codec = xchacha.XChaChaCodec(lambda: "07" * 32, None, lambda: bytes(range(1, 25)))
    conf = {"header": "h"}
    steps = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "xchacha20poly1305", "configuration": conf}]
    store = stores.MemoryStore({"v/zarr.json": meta([1, 4], codecs=steps), "v/c/0/0": codec.encode(f8(1.5, -2.5, 3.25, 4.75), conf)})
    zarr.register_codec("xchacha20poly1305", codec)
    try:
        d = zarr.open_zarr(spark, store)
        assert d.detect_encryption() and d["v"].data() == [[1.5, -2.5, 3.25, 4.75]]
        zarr.register_codec("xchacha20poly1305", xchacha.XChaChaCodec(lambda: "08" * 32))
        with pytest.raises(Exception, match="invalid tag"):
            zarr.open_zarr(spark, store)["v"].data()
    finally:
        zarr.CODECS.clear()


def test_write_and_read_back(spark, tmp_path):
    a = DataArray.from_nested(spark, np.arange(30, dtype=float).reshape(5, 6), ["y", "x"])
    zarr.write_zarr(a, str(tmp_path / "z" / "v"), (2, 4), [{"name": "gzip", "configuration": {"level": 1}}])
    d = zarr.open_zarr(spark, stores.DirectoryStore(str(tmp_path / "z")))
    assert d["v"].data() == a.data() and d["v"].isel({"y": -1}).data() == a.isel({"y": -1}).data()
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for p in (tmp_path / "z").rglob("*"):
            if p.is_file():
                z.write(p, p.relative_to(tmp_path / "z"))
    assert zarr.open_zarr(spark, stores.ZipStore(str(tmp_path / "z.zip")))["v"].sum().item() == 435
    write_cells(a, str(tmp_path / "cells"))
    assert read_cells(spark, str(tmp_path / "cells"), ["y", "x"], (5, 6)).data() == a.data()


# --- content-addressed stores ------------------------------------------------------------


def _link(name: str) -> Link:
    return Link(b"\x01\x55" + name.encode())


def test_sharded_store_v2(spark):
    chunks = [_link(f"c{i}") for i in range(4)]
    blocks = {str(c): f"chunk{i}".encode() for i, c in enumerate(chunks)} | {"m": json.dumps({"node_type": "array"}).encode(), "s0": cbor.encode([chunks[0], None]), "s1": cbor.encode(chunks[2:])}
    manifest = {"manifest_version": "sharded_zarr_v2", "metadata": {"0/FPAR/zarr.json": "m"}, "arrays": {"0/FPAR": {"array_shape": [2, 2], "chunk_shape": [1, 1], "sharding_config": {"chunks_per_shard": 2, "order": "C"}, "shard_cids": ["s0", "s1"]}}}
    store = stores.ShardedStore(stores.MemoryBlocks(blocks), manifest)
    assert store.get("0/FPAR/c/0/0") == b"chunk0" == store.get("/0/FPAR/0/0") == store.get("0/FPAR/0.0")
    assert store.get("0/FPAR/c/0/1") is None and not store.has("0/FPAR/c/0/1") and store.get("0/FPAR/c/1/1") == b"chunk3"
    assert store.get("0/OTHER/c/0/0") is None and store.get("0/FPAR/c/2/0") is None and store.has("0/FPAR/zarr.json")
    assert store.list_metadata_keys() == ["0/FPAR/zarr.json"]
    for _ in range(store.PROMOTED + 2):
        assert store.get("0/FPAR/c/1/0") == b"chunk2"
    assert "s1" in store._shards
    with pytest.raises(NotImplementedError):
        store.set("a", b"")
    broken = stores.ShardedStore(stores.MemoryBlocks({}), manifest)
    with pytest.raises(KeyError):  # a failing fetch is no fill value
        broken.get("0/FPAR/c/0/0")


def test_sharded_store_v1_and_checks():
    c = _link("v1")
    geometry = {"array_shape": [2], "chunk_shape": [1], "sharding_config": {"chunks_per_shard": 2}, "shard_cids": ["s"]}
    make = lambda **more: stores.ShardedStore(stores.MemoryBlocks({"s": cbor.encode([c, None]), str(c): b"v1-chunk"}), {"manifest_version": "sharded_zarr_v1", "metadata": {}, "chunks": geometry | more})
    assert make().get("/c/0") == b"v1-chunk" == make().get("any/c/0") and make().get("c/1") is None
    for more, what in (({"shard_cids": []}, "Inconsistent number"), ({"chunk_shape": [0]}, "positive"), ({"chunk_shape": [1, 1]}, "same rank"), ({"array_shape": [-1]}, "non-negative"), ({"sharding_config": {"chunks_per_shard": 0}}, "positive integer"), ({"sharding_config": {"chunks_per_shard": 1, "order": "F"}}, "row-major")):
        with pytest.raises(ValueError, match=what):
            make(**more)
    with pytest.raises(ValueError, match="Incompatible"):
        stores.ShardedStore(stores.MemoryBlocks({}), {"manifest_version": "x"})


def test_shard_locate_in_sql(spark):
    index = stores.ShardIndex("", [7, 9], [2, 2], {"chunks_per_shard": 3}, [None] * 7)
    df = spark.range(20).select((F.col("id") / 5).cast("long").alias("a"), (F.col("id") % 5).alias("b"))
    lin = F.col("a") * index.grid[1] + F.col("b")
    for r in df.select("a", "b", F.floor(lin / 3).alias("s"), (lin % 3).alias("k")).collect():
        assert index.locate([r["a"], r["b"]]) == (r["s"], r["k"])


def test_hash_trie_store():
    assert [stores.extract_bits(b"\xab\xcd", k, 8) for k in (0, 1)] == [0xAB, 0xCD]
    with pytest.raises(ValueError):
        stores.extract_bits(b"\xab", 1, 8)
    digest = blake3.blake3(b"zarr.json")
    leaf, root = stores.HamtNode(), stores.HamtNode()
    root_meta = json.dumps({"consolidated_metadata": {"metadata": {"t": {}, "/x": {}}}}).encode()
    leaf.data[digest[1]] = {"zarr.json": _link("meta")}
    root.data[digest[0]] = [_link("leaf")]
    key = next(k for k in ("a", "b", "c", "d") if blake3.blake3(k.encode())[0] != digest[0])
    root.data[blake3.blake3(key.encode())[0]] = {key: b"inline"}
    blocks = stores.MemoryBlocks({"root": root.serialize(), str(_link("leaf")): leaf.serialize(), str(_link("meta")): root_meta})
    store = stores.HamtStore(blocks, "root")
    assert store.get("/zarr.json") == root_meta and store.get("none") is None and store.get(key) == b"inline"
    assert store.get_range(key, 2, 3) == b"lin" and store.get_range(key, suffix=2) == b"ne" and store.get_range("none", 0, 1) is None
    assert store.list_metadata_keys() == ["zarr.json", "t/zarr.json", "x/zarr.json"]
    assert list(root.link_indices()) == [digest[0]] and len(list(root.buckets())) == 255 and list(root.links()) == [_link("leaf")]
    small = stores.HamtStore(blocks, "root")
    small.KEPT = 10
    assert small.get("zarr.json") == root_meta and len(small._nodes) == 1


def test_store_detection():
    manifest = {"manifest_version": "sharded_zarr_v1", "metadata": {}, "chunks": {"array_shape": [0], "chunk_shape": [1], "shard_cids": [], "sharding_config": {"chunks_per_shard": 1}}}
    blocks = stores.MemoryBlocks({"a": cbor.encode(manifest), "b": json.dumps(manifest).encode(), "c": stores.HamtNode().serialize()})
    assert [stores.detect_store(blocks, k) for k in "abc"] == ["sharded", "sharded", "hamt"]
    assert isinstance(stores.open_store(blocks, "b")[1], stores.ShardedStore) and stores.open_store(blocks, "c")[0] == "hamt"
    assert stores.ShardedStore.open(blocks, "a").arrays[""].grid == [0]


def test_gateway_ranges_and_retries():
    calls, waits = [], []

    def fetch(method, url, headers, body):
        calls.append((method, url, headers.get("Range")))
        return answers.pop(0)

    g = gateway.Gateway("http://gw", fetch=fetch, sleep=waits.append)
    answers = [(206, {}, b"cd")]
    assert g.cat("Q", 2, 2) == b"cd" and calls[-1] == ("GET", "http://gw/ipfs/Q", "bytes=2-3")
    answers = [(200, {}, b"abcdef")] * 3
    assert g.cat("Q", 2, 2) == b"cd" and g.cat("Q", suffix=2) == b"ef" and calls[-1][2] == "bytes=-2" and g.cat("Q", 4) == b"ef"
    answers = [(503, {"Retry-After": "99"}, b""), (429, {}, b""), (200, {}, b"ok")]
    assert g.cat("Q") == b"ok" and waits[0] == 30 and 2 <= waits[1] <= 2.2
    answers = [(404, {}, b"")]
    with pytest.raises(gateway.HttpStatusError):
        g.cat("Q")
    answers = [(500, {}, b"")] * 4
    with pytest.raises(gateway.HttpStatusError):
        g.cat("Q")
    answers = [(204, {}, b"")]
    with pytest.raises(IOError, match="unexpected status"):
        g.cat("Q", 0, 1)
    answers = [(200, {}, b'{"Hash": "QmX"}'), (200, {}, b'{"Keys": {"QmX": {"Type": "recursive"}}}'), (200, {}, b""), (200, {}, b""), (200, {}, b"")]
    assert g.save(b"data") == "QmX" and g.pins() == [{"cid": "QmX", "Type": "recursive"}]
    g.pin("QmX"), g.unpin("QmX"), g.pin_update("a", "b")
    assert calls[-1][1].endswith("/api/v0/pin/update?arg=a&arg=b") and calls[-3][1].endswith("pin/add?recursive=true&arg=QmX")


# --- tables --------------------------------------------------------------------------------


def test_from_table_completes_the_grid(spark):
    df = spark.createDataFrame([("b", 2, 1.0), ("a", 1, 2.0), ("a", 1, 3.0), (None, 1, 9.0)], "k string, n int, v double")
    d = from_table(df, ["k", "n"], {"s": F.sum("v")})
    assert d["s"].data() == [[5.0, None], [None, 1.0]] and d.coords == {"k": ["a", "b"], "n": [1.0, 2.0]}
    given = from_table(df, ["k"], {"s": F.sum("v")}, {"k": ["b", "z"]})
    assert given["s"].data() == [1.0, None]
    assert from_table(df.limit(0), ["k"], ["v"])["v"].shape == (0,)


def test_selections_reach_the_scan_of_a_table(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i % 7}", i % 5, float(i)) for i in range(70)], "k string, n int, v double")
    df.write.parquet(str(tmp_path / "t"))
    a = from_table(spark.read.parquet(str(tmp_path / "t")), ["k", "n"], {"s": F.sum("v")})["s"]
    whole = a.data()
    plan = lambda x: x.cells._jdf.queryExecution().executedPlan().toString()
    one = a.sel({"k": "k3", "n": slice(1, 2)})
    assert "EqualTo(k,k3)" in plan(one) or "GreaterThanOrEqual(k,k3)" in plan(one)
    scan = one.cells._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    assert re.search(r"n#\d+ >= 1", scan) and re.search(r"n#\d+ <= 2", scan) and one.data() == whole[3][1:3]
    some = a.sel({"k": ["k6", "k0", "k6"]})
    assert re.search(r"k#\d+ IN \(k0,k6\)", some.cells._jdf.queryExecution().optimizedPlan().toString()) and some.data() == [whole[6], whole[0], whole[6]]
    assert a.isel({"n": slice(None, None, -2)}).data() == [r[::-2] for r in whole]
    assert a.isel({"k": []}).shape == (0, 5) and a.isel({"k": []}).data() == []
    back = from_table(spark.read.parquet(str(tmp_path / "t")), ["k"], {"s": F.sum("v")}, {"k": ["k5", "zz", "k1"]})["s"]
    assert back.isel({"k": slice(0, 2)}).data() == [sum(range(5, 70, 7)), None] and back.isel({"k": [2]}).data() == [sum(range(1, 70, 7))]
