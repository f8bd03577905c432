"""DAG-CBOR: decoding, encoding, and walking to one entry of a list without decoding it all."""

from __future__ import annotations

import base64
import struct
from dataclasses import dataclass


@dataclass(frozen=True)
class Link:
    """A content identifier, in its binary form."""

    cid: bytes

    def __str__(self) -> str:
        return "b" + base64.b32encode(self.cid).decode().lower().rstrip("=")


class CborError(ValueError):
    pass


def _head(data: bytes, at: int) -> tuple[int, int, int]:
    """Major type, argument, and where the item goes on."""
    if at >= len(data):
        raise CborError("unexpected end of data")
    major, low = data[at] >> 5, data[at] & 31
    if low < 24:
        return major, low, at + 1
    if low > 27:
        raise CborError("indefinite lengths are not allowed")
    n = 1 << (low - 24)
    if at + 1 + n > len(data):
        raise CborError("unexpected end of data")
    return major, int.from_bytes(data[at + 1 : at + 1 + n], "big"), at + 1 + n


def skip(data: bytes, at: int) -> int:
    """Where the item at ``at`` ends."""
    left = 1
    while left:
        major, arg, nxt = _head(data, at)
        if major in (2, 3):
            nxt += arg
            if nxt > len(data):
                raise CborError("unexpected end of data")
        elif major == 4:
            left += arg
        elif major == 5:
            left += 2 * arg
        elif major == 6:
            left += 1
        at, left = nxt, left - 1
    return at


def _item(data: bytes, at: int):
    start = at
    major, arg, at = _head(data, at)
    if major == 0:
        return arg, at
    if major == 1:
        return -1 - arg, at
    if major in (2, 3):
        if at + arg > len(data):
            raise CborError("unexpected end of data")
        raw = data[at : at + arg]
        return (bytes(raw) if major == 2 else raw.decode()), at + arg
    if major == 4:
        out = []
        for _ in range(arg):
            x, at = _item(data, at)
            out.append(x)
        return out, at
    if major == 5:
        made = {}
        for _ in range(arg):
            k, at = _item(data, at)
            made[k], at = _item(data, at)
        return made, at
    if major == 6:
        x, at = _item(data, at)
        if arg != 42 or not isinstance(x, bytes) or x[:1] != b"\0":
            raise CborError(f"tag {arg} is not a link")
        return Link(x[1:]), at
    size = at - start
    if size == 1:
        if arg not in (20, 21, 22):
            raise CborError(f"simple value {arg} is not allowed")
        return {20: False, 21: True, 22: None}[arg], at
    if size == 2:
        raise CborError("simple values of two bytes are not allowed")
    return struct.unpack({3: ">e", 5: ">f", 9: ">d"}[size], data[start + 1 : at])[0], at


def decode(data: bytes):
    """The only item of ``data``."""
    got, at = _item(data, 0)
    if at != len(data):
        raise CborError("data after the item")
    return got


def entry(data: bytes, i: int):
    """Entry ``i`` of a list of links and nulls, decoding nothing else."""
    major, n, at = _head(data, 0)
    if major != 4:
        raise CborError("shard is not a list")
    if not 0 <= i < n:
        raise IndexError(f"entry {i} is out of range for a shard of {n} entries")
    for _ in range(i):
        at = skip(data, at)
    got, _ = _item(data, at)
    if got is not None and not isinstance(got, Link):
        raise CborError(f"shard entry {i} is neither a link nor null")
    return got


def _write(major: int, arg: int) -> bytes:
    if arg < 24:
        return bytes([major << 5 | arg])
    n = next(k for k in range(4) if arg < 1 << (8 << k))
    return bytes([major << 5 | 24 + n]) + arg.to_bytes(1 << n, "big")


def encode(x) -> bytes:
    """Canonical DAG-CBOR: map keys by length, then bytes."""
    if x is None or isinstance(x, bool):
        return {None: b"\xf6", True: b"\xf5", False: b"\xf4"}[x]
    if isinstance(x, int):
        return _write(0, x) if x >= 0 else _write(1, -1 - x)
    if isinstance(x, float):
        return b"\xfb" + struct.pack(">d", x)
    if isinstance(x, (bytes, str)):
        raw = x if isinstance(x, bytes) else x.encode()
        return _write(2 if isinstance(x, bytes) else 3, len(raw)) + raw
    if isinstance(x, Link):
        return b"\xd8\x2a" + encode(b"\0" + x.cid)
    if isinstance(x, (list, tuple)):
        return _write(4, len(x)) + b"".join(map(encode, x))
    if isinstance(x, dict):
        items = sorted(((k.encode(), v) for k, v in x.items()), key=lambda p: (len(p[0]), p[0]))
        return _write(5, len(items)) + b"".join(_write(3, len(k)) + k + encode(v) for k, v in items)
    raise TypeError(f"{type(x).__name__} has no DAG-CBOR form")
