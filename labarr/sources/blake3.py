"""BLAKE3 hashing (no keys, 32 bytes), from its paper."""

from __future__ import annotations

#: Initial state, word permutation, flags.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_CHUNK_START, _CHUNK_END, _PARENT, _ROOT = 1, 2, 4, 8
_MASK = 0xFFFFFFFF
#: Columns, then diagonals, of the 4 x 4 state.
_MIXES = tuple((k, 4 + k, 8 + k, 12 + k) for k in range(4)) + tuple((k, 4 + (k + 1) % 4, 8 + (k + 2) % 4, 12 + (k + 3) % 4) for k in range(4))


def _turn(x: int, n: int) -> int:
    return (x >> n | x << (32 - n)) & _MASK


def _compress(cv: tuple, block: bytes, counter: int, size: int, flags: int) -> list[int]:
    m = [int.from_bytes(block[i : i + 4], "little") for i in range(0, 64, 4)]
    v = [*cv, *_IV[:4], counter & _MASK, counter >> 32, size, flags]
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(_MIXES):
            for x, (r, s) in ((m[2 * k], (16, 12)), (m[2 * k + 1], (8, 7))):
                v[a] = (v[a] + v[b] + x) & _MASK
                v[d] = _turn(v[d] ^ v[a], r)
                v[c] = (v[c] + v[d]) & _MASK
                v[b] = _turn(v[b] ^ v[c], s)
        m = [m[i] for i in _ORDER]
    return [v[i] ^ v[i + 8] for i in range(8)]


def _chunk(data: bytes, counter: int, root: bool) -> tuple:
    cv, blocks = _IV, max(1, -(-len(data) // 64))
    for i in range(blocks):
        part = data[64 * i : 64 * i + 64]
        flags = _CHUNK_START * (i == 0) | _CHUNK_END * (i == blocks - 1) | _ROOT * (root and i == blocks - 1)
        cv = tuple(_compress(cv, part.ljust(64, b"\0"), counter, len(part), flags))
    return cv


def _tree(data: bytes, first: int, root: bool) -> tuple:
    if len(data) <= 1024:
        return _chunk(data, first, root)
    # the left side is the largest power of two of chunks that leaves something
    left = 1024 << ((len(data) - 1) // 1024).bit_length() - 1
    pair = _tree(data[:left], first, False) + _tree(data[left:], first + left // 1024, False)
    return tuple(_compress(_IV, b"".join(x.to_bytes(4, "little") for x in pair), 0, 64, _PARENT | _ROOT * root))


def blake3(data: bytes) -> bytes:
    return b"".join(x.to_bytes(4, "little") for x in _tree(data, 0, True))
