"""Key-value stores of array metadata and chunks. Tasks carry stores, so they pickle."""

from __future__ import annotations

import os
import posixpath
import zipfile
from abc import ABC, abstractmethod
from collections import OrderedDict
from collections.abc import Callable

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import cbor
from .blake3 import blake3
from .cbor import Link


class ZarrStore(ABC):
    """``get`` gives None for a key that is not there; any failure raises."""

    @property
    def parallel(self) -> int | None:
        """How many tasks may ask at once, where that is limited."""
        return getattr(getattr(self, "blocks", None), "parallel", None) or getattr(getattr(self, "store", None), "parallel", None)

    @abstractmethod
    def get(self, key: str) -> bytes | None: ...

    def has(self, key: str) -> bool:
        return self.get(key) is not None

    @abstractmethod
    def list_metadata_keys(self) -> list[str]: ...


class MemoryStore(ZarrStore):
    def __init__(self, data: dict[str, bytes | dict] | None = None):
        self.data = {k: json.dumps(v).encode() if isinstance(v, dict) else bytes(v) for k, v in (data or {}).items()}

    def get(self, key: str) -> bytes | None:
        return self.data.get(key.lstrip("/"))

    def list_metadata_keys(self) -> list[str]:
        return [k for k in self.data if k.endswith(".json")]


class DirectoryStore(ZarrStore):
    """A folder that driver and executors can open."""

    def __init__(self, path: str):
        self.path = path

    def get(self, key: str) -> bytes | None:
        try:
            with open(os.path.join(self.path, key.lstrip("/")), "rb") as f:
                return f.read()
        except (FileNotFoundError, NotADirectoryError, IsADirectoryError):
            return None

    def list_metadata_keys(self) -> list[str]:
        found = [os.path.join(d, f) for d, _, files in os.walk(self.path) for f in files if f == "zarr.json"]
        return sorted(os.path.relpath(x, self.path).replace(os.sep, "/") for x in found)


class ZipStore(ZarrStore):
    def __init__(self, path: str):
        self.path = path

    def get(self, key: str) -> bytes | None:
        with zipfile.ZipFile(self.path) as z:
            try:
                return z.read(key.lstrip("/"))
            except KeyError:
                return None

    def list_metadata_keys(self) -> list[str]:
        with zipfile.ZipFile(self.path) as z:
            return [n for n in z.namelist() if posixpath.basename(n) == "zarr.json"]


class ConsolidatedStore(ZarrStore):
    """A store whose root metadata holds that of all nodes, by name: directly or, in the
    later layout, under ``metadata``. Needs no listing; chunks come from the inner store."""

    def __init__(self, store: ZarrStore):
        self.store = store
        root = json.loads(store.get("zarr.json") or b"{}")
        held = root.get("consolidated_metadata") or {}
        held = held["metadata"] if isinstance(held.get("metadata"), dict) and "node_type" not in held["metadata"] else held
        self.nodes = {f"{n.strip('/')}/zarr.json": m for n, m in held.items() if n.strip("/") and isinstance(m, dict)} | {"zarr.json": root}

    def get(self, key: str) -> bytes | None:
        found = self.nodes.get(key.lstrip("/"))
        return json.dumps(found).encode() if found is not None else self.store.get(key)

    def list_metadata_keys(self) -> list[str]:
        return list(self.nodes)


class Blocks(ABC):
    """Content by identifier: raw blocks, and files made of them."""

    @abstractmethod
    def block(self, cid: str) -> bytes: ...

    @abstractmethod
    def cat(self, cid: str, offset: int | None = None, length: int | None = None, suffix: int | None = None) -> bytes: ...


class MemoryBlocks(Blocks):
    def __init__(self, blocks: dict[str, bytes]):
        self.blocks = blocks

    def block(self, cid: str) -> bytes:
        return self.blocks[str(cid)]

    def cat(self, cid: str, offset=None, length=None, suffix=None) -> bytes:
        return cut(self.blocks[str(cid)], offset, length, suffix)


def cut(data: bytes, offset: int | None = None, length: int | None = None, suffix: int | None = None) -> bytes:
    """A byte range: from an offset, or the last ``suffix`` bytes."""
    if offset is not None:
        return data[offset:] if length is None else data[offset : offset + length]
    return data if suffix is None else data[max(0, len(data) - suffix) :]


class ShardIndex:
    """Where an array's chunks are: in which shard, at which slot."""

    def __init__(self, path: str, shape, chunk_shape, config: dict, shards):
        self.path, self.shape, self.chunk_shape, self.shards = path.strip("/"), list(shape), list(chunk_shape), list(shards)
        self.per_shard = config.get("chunks_per_shard")
        if not isinstance(self.per_shard, int) or isinstance(self.per_shard, bool) or self.per_shard <= 0:
            raise ValueError("chunks_per_shard must be a positive integer.")
        if config.get("order") not in (None, "C"):
            raise ValueError("Only row-major ('C') shard ordering is supported.")
        if len(self.shape) != len(self.chunk_shape):
            raise ValueError("array_shape and chunk_shape must have the same rank.")
        if any(n <= 0 for n in self.chunk_shape):
            raise ValueError("All chunk_shape dimensions must be positive.")
        if any(n < 0 for n in self.shape):
            raise ValueError("All array_shape dimensions must be non-negative.")
        self.grid = [-(-n // c) for n, c in zip(self.shape, self.chunk_shape, strict=True)]
        total = 1
        for n in self.grid:
            total *= n
        expected = -(-total // self.per_shard) if total else 0
        if len(self.shards) != expected:
            raise ValueError(f"Inconsistent number of shards. Expected {expected}, found {len(self.shards)}.")

    def inside(self, parts: list[str]) -> list[int] | None:
        """Chunk coordinates, if the texts are such."""
        if len(parts) != len(self.grid) or not all(re.fullmatch(r"\d+", p, re.ASCII) for p in parts):
            return None
        at = [int(p) for p in parts]
        return at if all(i < n for i, n in zip(at, self.grid, strict=True)) else None

    def locate(self, at: list[int]) -> tuple[int, int]:
        """Shard and slot of a chunk, chunks being counted row by row."""
        i = 0
        for x, n in zip(at, self.grid, strict=True):
            i = i * n + x
        return divmod(i, self.per_shard)

    def locate_columns(self, at: list[Column]) -> tuple[Column, Column]:
        """``locate`` of columns of coordinates."""
        i = F.lit(0).cast("long")
        for x, n in zip(at, self.grid, strict=True):
            i = i * n + x
        return F.floor(i / self.per_shard), i % self.per_shard


class ShardedStore(ZarrStore):
    """Chunks behind a manifest that lists shards, each a list of links to chunks."""

    #: Whole shards that a process keeps, and lookups in one after which it is kept.
    KEPT, PROMOTED = 64, 32

    def __init__(self, blocks: Blocks, manifest: dict):
        self.blocks, self.metadata = blocks, manifest.get("metadata") or {}
        self.version = manifest.get("manifest_version")
        if self.version == "sharded_zarr_v1":
            c = manifest["chunks"]
            arrays = {"": c}
        elif self.version == "sharded_zarr_v2":
            arrays = manifest.get("arrays")
            if not isinstance(manifest.get("metadata"), dict) or not isinstance(arrays, dict):
                raise ValueError("Root object is not a valid v2 dictionary with 'metadata' and 'arrays' keys.")
        else:
            raise ValueError(f"Incompatible manifest version: {self.version}")
        self.arrays = {p.strip("/"): ShardIndex(p, m["array_shape"], m["chunk_shape"], m["sharding_config"], m["shard_cids"]) for p, m in arrays.items()}
        self._shards: OrderedDict = OrderedDict()
        self._hits: dict[str, int] = {}

    @classmethod
    def open(cls, blocks: Blocks, cid: str) -> ShardedStore:
        return cls(blocks, cbor.decode(blocks.block(cid)))

    def __getstate__(self):
        return self.__dict__ | {"_shards": OrderedDict(), "_hits": {}}

    def list_metadata_keys(self) -> list[str]:
        return list(self.metadata)

    def parse(self, key: str) -> tuple[ShardIndex, list[int]] | None:
        """The array and coordinates that a chunk key means: ``path/c/i/j``, or in version
        2 also ``path/i/j`` and ``path/i.j``."""
        key = key.lstrip("/")
        if key in self.metadata or key.endswith(".json"):
            return None
        path, mark, coords = ("", "c/", key[2:]) if key.startswith("c/") and "/c/" not in key else key.rpartition("/c/")
        if mark:
            index = self.arrays.get("" if self.version == "sharded_zarr_v1" else path)
            at = index.inside(coords.split("/")) if index else None
            return None if at is None else (index, at)
        if self.version == "sharded_zarr_v1":
            return None
        path, _, last = key.rpartition("/")
        if "." in last and path in self.arrays and (at := self.arrays[path].inside(last.split("."))) is not None:
            return self.arrays[path], at
        for path in sorted(self.arrays, key=len, reverse=True):
            if not path or key.startswith(path + "/"):
                at = self.arrays[path].inside(key[len(path) + 1 if path else 0 :].split("/"))
                if at is not None:
                    return self.arrays[path], at
        return None

    def entry(self, index: ShardIndex, shard: int, slot: int) -> Link | str | None:
        """A chunk's link. A shard is walked to the slot until it is asked often, then kept."""
        cid = index.shards[shard]
        if cid is None:
            return None
        cid = str(cid)
        if cid in self._shards:
            self._shards.move_to_end(cid)
            links = self._shards[cid]
            if not 0 <= slot < len(links):
                raise IndexError(f"entry {slot} is out of range for a shard of {len(links)} entries")
            return links[slot]
        data = self.blocks.block(cid)
        self._hits[cid] = self._hits.get(cid, 0) + 1
        if self._hits[cid] < self.PROMOTED:
            return cbor.entry(data, slot)
        self._shards[cid] = cbor.decode(data)
        if len(self._shards) > self.KEPT:
            self._shards.popitem(last=False)
        return self._shards[cid][slot]

    def get(self, key: str) -> bytes | None:
        found = self.parse(key)
        if found is None:
            cid = self.metadata.get(key.lstrip("/"))
            return self.blocks.cat(str(cid)) if cid else None
        index, at = found
        link = self.entry(index, *index.locate(at))
        return None if link is None else self.blocks.cat(str(link))

    def has(self, key: str) -> bool:
        found = self.parse(key)
        if found is None:
            return key.lstrip("/") in self.metadata
        return self.entry(found[0], *found[0].locate(found[1])) is not None

    def set(self, key: str, value: bytes) -> None:
        raise NotImplementedError("sharded stores are read-only")


def extract_bits(digest: bytes, depth: int, n: int) -> int:
    """``n`` bits of a digest, ``depth`` groups from the front."""
    left = 8 * len(digest) - depth * n
    if left < n:
        raise ValueError("Arguments extract more bits than remain in the hash bits")
    return int.from_bytes(digest, "big") >> (left - n) & (1 << n) - 1


class HamtNode:
    """256 places: a bucket of keys, or a link to a node."""

    def __init__(self, data: list | None = None):
        self.data = data if data is not None else [{} for _ in range(256)]

    def buckets(self):
        return (x for x in self.data if isinstance(x, dict))

    def link_indices(self):
        return (i for i, x in enumerate(self.data) if isinstance(x, list))

    def links(self):
        return (x[0] for x in self.data if isinstance(x, list) and x)

    def serialize(self) -> bytes:
        return cbor.encode(self.data)

    @classmethod
    def deserialize(cls, data: bytes) -> HamtNode:
        got = cbor.decode(data)
        if not isinstance(got, list):
            raise cbor.CborError("HAMT node is not a list")
        return cls(got)


class HamtStore(ZarrStore):
    """Keys in a hash trie over BLAKE3, eight bits a level."""

    #: Serialized bytes of nodes that a process keeps; the oldest go first.
    KEPT = 30_000_000

    def __init__(self, blocks: Blocks, cid: str, digest: Callable[[bytes], bytes] = blake3):
        self.blocks, self.cid, self.digest = blocks, cid, digest
        self._nodes: OrderedDict = OrderedDict()
        self._held = 0

    def __getstate__(self):
        return self.__dict__ | {"_nodes": OrderedDict(), "_held": 0}

    def node(self, cid: str) -> HamtNode:
        cid = str(cid)
        if cid not in self._nodes:
            data = self.blocks.block(cid)
            self._nodes[cid] = (HamtNode.deserialize(data), len(data))
            self._held += len(data)
            while self._held > self.KEPT and len(self._nodes) > 1:
                self._held -= self._nodes.popitem(last=False)[1][1]
        return self._nodes[cid][0]

    def find(self, key: str):
        """Link or value of a key; KeyError if there is none."""
        key = key.lstrip("/")
        digest, at, depth = self.digest(key.encode()), self.cid, 0
        while True:
            found = self.node(at).data[extract_bits(digest, depth, 8)]
            if isinstance(found, list):
                at, depth = found[0], depth + 1
            elif isinstance(found, dict) and key in found:
                return found[key]
            else:
                raise KeyError(key)

    def get(self, key: str) -> bytes | None:
        return self.get_range(key)

    def get_range(self, key: str, offset: int | None = None, length: int | None = None, suffix: int | None = None) -> bytes | None:
        try:
            found = self.find(key)
        except KeyError:
            return None
        return cut(found, offset, length, suffix) if isinstance(found, bytes) else self.blocks.cat(str(found), offset, length, suffix)

    def list_metadata_keys(self) -> list[str]:
        root = self.get("zarr.json")
        if root is None:
            return []
        try:
            meta = json.loads(root)
        except ValueError:
            meta = cbor.decode(root)
        inner = ((meta or {}).get("consolidated_metadata") or {}).get("metadata") or {}
        return ["zarr.json", *(f"{n.strip('/')}/zarr.json" for n in inner if n.strip("/"))]


def write_trie(blocks: MemoryBlocks, items: dict[str, bytes], digest: Callable[[bytes], bytes] = blake3, most: int = 4) -> str:
    """Put items into ``blocks`` as a hash trie with buckets of up to ``most`` keys; the
    identifier of its root."""

    def node(part: dict[str, bytes], depth: int) -> Link:
        made, by = HamtNode(), {}
        for key, value in part.items():
            by.setdefault(extract_bits(digest(key.encode()), depth, 8), {})[key] = value
        for place, held in by.items():
            made.data[place] = [node(held, depth + 1)] if len(held) > most else held
        data = made.serialize()
        link = Link(b"\x01\x71" + digest(data))
        blocks.blocks[str(link)] = data
        return link

    return str(node({k.lstrip("/"): v for k, v in items.items()}, 0))


def read_manifest(data: bytes) -> dict | None:
    """A shard manifest in CBOR or JSON; None if the data is none."""
    for read in (cbor.decode, json.loads):
        try:
            got = read(data)
        except (ValueError, IndexError, UnicodeDecodeError):
            continue
        if isinstance(got, dict) and str(got.get("manifest_version", "")).startswith("sharded_zarr_"):
            return got
    return None


def detect_store(blocks: Blocks, cid: str) -> str:
    return "hamt" if read_manifest(blocks.block(cid)) is None else "sharded"


def open_store(blocks: Blocks, cid: str) -> tuple[str, ZarrStore]:
    """(kind, store) of a root: sharded where it is a manifest, else a hash trie."""
    manifest = read_manifest(blocks.block(cid))
    return ("hamt", HamtStore(blocks, cid)) if manifest is None else ("sharded", ShardedStore(blocks, manifest))
