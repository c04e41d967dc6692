"""Patched frame-of-reference coding of token ids.

Ids are cut into blocks of 256. A block stores its least id and, at one width for all, the differences from it. The
width is the bit length that the given share of the block's differences needs; wider differences are exceptions, whose
places and values stand in lists of their own. An index holds where each block's packed bits and exceptions start.

Layout, little-endian: magic (4 bytes), count u32, blocks u32, exceptions u32, packed bytes u64; minimum u32, width u8,
start of packed bits u64 and start of exceptions u32 for each block; packed bits; place u8 and difference u32 for each
exception.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 256
MAGIC = b"PFR1"
_HEAD = struct.Struct("<4sIIIQ")


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 256 values below 2**width as rows of 32 * width bytes."""
    if width <= 16:
        v = values.astype(np.uint64).reshape(len(values), BLOCK // 8, 2, 4)
        half = v[..., 0] | v[..., 1] << np.uint64(width) | v[..., 2] << np.uint64(2 * width) | v[..., 3] << np.uint64(3 * width)
        both = np.empty(half.shape, np.uint64)
        s = 4 * width
        both[..., 0] = half[..., 0] | (half[..., 1] << np.uint64(s) if s < 64 else np.uint64(0))
        both[..., 1] = half[..., 1] >> np.uint64(64 - s)
        return both.view(np.uint8).reshape(len(values), BLOCK // 8, 16)[:, :, :width].reshape(len(values), -1)
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(len(values), BLOCK, 4), axis=2, bitorder="little")
    return np.packbits(bits[:, :, :width].reshape(len(values), -1), axis=1, bitorder="little")


def _unpack(rows: np.ndarray, width: int) -> np.ndarray:
    if width <= 16:
        wide = np.zeros((len(rows), BLOCK // 8, 16), np.uint8)
        wide[:, :, :width] = rows.reshape(len(rows), BLOCK // 8, width)
        both = wide.view("<u8")
        s, mask = 4 * width, np.uint64((1 << width) - 1)
        out = np.empty((len(rows), BLOCK // 8, 2, 4), np.uint32)
        upper = both[..., 1] if s == 64 else both[..., 0] >> np.uint64(s) | both[..., 1] << np.uint64(64 - s)
        for h, half in enumerate((both[..., 0], upper)):
            for k in range(4):
                out[:, :, h, k] = half >> np.uint64(k * width) & mask
        return out.reshape(len(rows), BLOCK)
    bits = np.unpackbits(rows, axis=1, bitorder="little").reshape(len(rows), BLOCK, width)
    full = np.zeros((len(rows), BLOCK, 32), np.uint8)
    full[:, :, :width] = bits
    return np.packbits(full, axis=2, bitorder="little").view("<u4").reshape(len(rows), BLOCK)


def encode(ids: np.ndarray, share: float = 0.9) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return _HEAD.pack(MAGIC, 0, 0, 0, 0)
    full = np.empty(blocks * BLOCK, np.uint32)
    full[:n] = ids
    full[n:] = ids[-1]
    full = full.reshape(blocks, BLOCK)
    least = full.min(axis=1)
    delta = full - least[:, None]
    bits = np.frexp(delta.astype(np.float64))[1].astype(np.uint8)
    at = min(BLOCK - 1, int(share * BLOCK))
    width = np.partition(bits, at, axis=1)[:, at].copy()
    wide = bits > width[:, None]
    which, place = np.nonzero(wide)
    start = np.zeros(blocks + 1, np.uint64)
    np.cumsum(width.astype(np.uint64) * np.uint64(BLOCK // 8), out=start[1:])
    exc = np.zeros(blocks + 1, np.uint32)
    np.cumsum(wide.sum(axis=1), out=exc[1:])
    packed = np.empty(int(start[-1]), np.uint8)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            low = delta[rows] & np.uint32((1 << int(w)) - 1)
            packed[start[rows].astype(np.int64)[:, None] + np.arange(int(w) * (BLOCK // 8))] = _pack(low, int(w))
    parts = [least.astype("<u4"), width, start[:-1].astype("<u8"), exc[:-1].astype("<u4"), packed, place.astype(np.uint8), delta[which, place].astype("<u4")]
    return _HEAD.pack(MAGIC, n, blocks, len(which), len(packed)) + b"".join(p.tobytes() for p in parts)


def _parts(data: bytes):
    magic, n, blocks, exceptions, size = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token block file")
    out, at = [], _HEAD.size
    for kind, count in (("<u4", blocks), ("u1", blocks), ("<u8", blocks), ("<u4", blocks), ("u1", size), ("u1", exceptions), ("<u4", exceptions)):
        out.append(np.frombuffer(data, kind, count, at))
        at += out[-1].nbytes
    return n, blocks, out


def decode(data: bytes) -> np.ndarray:
    n, blocks, (least, width, start, exc, packed, place, value) = _parts(data)
    full = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            full[rows] = _unpack(packed[start[rows].astype(np.int64)[:, None] + np.arange(int(w) * (BLOCK // 8))], int(w))
    ends = np.append(exc[1:], len(place)).astype(np.int64) if blocks else exc
    full[np.repeat(np.arange(blocks), ends - exc), place] = value
    full += least[:, None]
    return full.reshape(-1)[:n]


def decode_block(data: bytes, k: int) -> np.ndarray:
    """Block k alone, found through the index."""
    n, blocks, (least, width, start, exc, packed, place, value) = _parts(data)
    if not 0 <= k < blocks:
        raise IndexError(k)
    w, a = int(width[k]), int(start[k])
    row = np.zeros(BLOCK, np.uint32) if not w else _unpack(packed[a : a + w * (BLOCK // 8)][None, :], w)[0].astype(np.uint32)
    end = int(exc[k + 1]) if k + 1 < blocks else len(place)
    row[place[int(exc[k]) : end]] = value[int(exc[k]) : end]
    return (row + least[k])[: n - k * BLOCK]
