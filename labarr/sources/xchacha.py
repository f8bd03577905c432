"""XChaCha20-Poly1305 (RFC 8439 and the XChaCha draft) as a chunk codec.

A chunk is nonce (24 bytes), ciphertext, tag (16 bytes). The optional header is
authenticated with it. Chunks are processed by numpy: all key-stream blocks at once.
"""

from __future__ import annotations

import hmac
import os
import struct
from collections.abc import Callable

import numpy as np

CODEC_ID = "xchacha20poly1305"
NONCE, TAG = 24, 16
#: Fixed value: "expand 32-byte k".
_SIGMA = np.frombuffer(b"expand 32-byte k", "<u4")
_QUARTERS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


class DecryptionError(ValueError):
    """Wrong key or header, or a damaged chunk."""


def _rounds(state: np.ndarray) -> np.ndarray:
    """Twenty rounds on columns of states."""
    x = state.copy()
    for _ in range(10):
        for a, b, c, d in _QUARTERS:
            for p, q, r, n in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
                x[p] += x[q]
                t = x[r] ^ x[p]
                x[r] = (t << np.uint32(n)) | (t >> np.uint32(32 - n))
    return x


def _state(key: bytes, counters: np.ndarray, nonce: bytes) -> np.ndarray:
    n = len(counters)
    fixed = np.concatenate([_SIGMA, np.frombuffer(key, "<u4")]).astype(np.uint32)
    tail = np.frombuffer(nonce, "<u4").astype(np.uint32)
    return np.concatenate([np.repeat(fixed[:, None], n, 1), counters.astype(np.uint32)[None], np.repeat(tail[:, None], n, 1)])


def stream(key: bytes, nonce: bytes, counter: int, size: int) -> bytes:
    """ChaCha20 key stream from a block counter on; nonce of 12 bytes."""
    blocks = -(-size // 64)
    state = _state(key, np.arange(counter, counter + blocks, dtype=np.uint64), nonce)
    return (_rounds(state) + state).T.astype("<u4").tobytes()[:size]


def subkey(key: bytes, nonce: bytes) -> bytes:
    """HChaCha20 of the first 16 bytes of a nonce."""
    first = _state(key, np.frombuffer(nonce[:4], "<u4"), nonce[4:16])
    done = _rounds(first)[:, 0]
    return np.concatenate([done[:4], done[12:]]).astype("<u4").tobytes()


def poly1305(key: bytes, data: bytes) -> bytes:
    r = int.from_bytes(key[:16], "little") & 0x0FFFFFFC0FFFFFFC0FFFFFFC0FFFFFFF
    total, p = 0, (1 << 130) - 5
    for i in range(0, len(data), 16):
        total = (total + int.from_bytes(data[i : i + 16] + b"\1", "little")) * r % p
    return ((total + int.from_bytes(key[16:], "little")) & ((1 << 128) - 1)).to_bytes(16, "little")


def _tag(key: bytes, nonce: bytes, header: bytes, sealed: bytes) -> bytes:
    pad = lambda b: b + bytes(-len(b) % 16)
    return poly1305(stream(key, nonce, 0, 32), pad(header) + pad(sealed) + struct.pack("<QQ", len(header), len(sealed)))


def _xor(a: bytes, b: bytes) -> bytes:
    return (np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).tobytes()


def seal(key: bytes, nonce: bytes, plain: bytes, header: bytes = b"") -> bytes:
    """Ciphertext and tag."""
    own, short = subkey(key, nonce), bytes(4) + nonce[16:]
    sealed = _xor(plain, stream(own, short, 1, len(plain))) if plain else b""
    return sealed + _tag(own, short, header, sealed)


def unseal(key: bytes, nonce: bytes, sealed: bytes, header: bytes = b"") -> bytes:
    own, short, body = subkey(key, nonce), bytes(4) + nonce[16:], sealed[:-TAG]
    if not hmac.compare_digest(_tag(own, short, header, body), sealed[-TAG:]):
        raise DecryptionError("invalid tag: wrong key or header, or a damaged chunk")
    return _xor(body, stream(own, short, 1, len(body))) if body else b""


def key_bytes(key: bytes | str) -> bytes:
    """32 bytes, given as such or as 64 hexadecimal digits with or without 0x."""
    if isinstance(key, str):
        text = key[2:] if key[:2].lower() == "0x" else key
        try:
            key = bytes.fromhex(text) if len(text) == 64 else b""
        except ValueError:
            key = b""
    if len(key) != 32:
        raise ValueError("key must have 32 bytes or 64 hexadecimal digits")
    return bytes(key)


class XChaChaCodec:
    """Chunk codec from callbacks; plain functions or constants, so that tasks can carry it.

    A header from the callback wins over the one in the array's configuration.
    """

    def __init__(self, get_key: Callable[[], bytes | str], get_header: Callable[[], bytes | str] | None = None, nonce: Callable[[], bytes] | None = None):
        self.get_key, self.get_header, self.nonce = get_key, get_header, nonce or (lambda: os.urandom(NONCE))

    def _header(self, configuration: dict | None) -> bytes:
        given = self.get_header() if self.get_header else (configuration or {}).get("header", b"")
        return given.encode() if isinstance(given, str) else bytes(given or b"")

    def encode(self, data: bytes, configuration: dict | None = None) -> bytes:
        nonce = bytes(self.nonce())
        if len(nonce) != NONCE:
            raise ValueError("nonce must have 24 bytes")
        return nonce + seal(key_bytes(self.get_key()), nonce, data, self._header(configuration))

    def decode(self, data: bytes, configuration: dict | None = None) -> bytes:
        if len(data) < NONCE + TAG:
            raise DecryptionError("encrypted chunk is too short")
        return unseal(key_bytes(self.get_key()), bytes(data[:NONCE]), bytes(data[NONCE:]), self._header(configuration))
