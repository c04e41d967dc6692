"""Hashed word shingles of whole texts."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(11)
_LETTERS = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_PART = 1 << 19
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = max(n, _PART) + 1
        _powers[:] = [np.cumprod(np.full(size, np.uint64(x), np.uint64)) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * _M1
    h = (h ^ h >> np.uint64(29)) * _M2
    return h ^ h >> np.uint64(32)


def _words(buf: np.ndarray) -> np.ndarray:
    power, inverse = _tables(len(buf))
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = ~_SEPARATOR[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    run = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_LETTERS[buf] * power[: len(buf)], out=run[1:])
    return _mixed((run[end] - run[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased. Long texts are taken in parts that end at a separator."""
    raw = text.encode().lower()  # of bytes: A-Z only
    buf = np.frombuffer(raw, np.uint8)
    if len(buf) <= _PART:
        return _words(buf)
    out, at = [], 0
    while at < len(buf):
        end = min(at + _PART, len(buf))
        if end < len(buf):
            gap = np.flatnonzero(_SEPARATOR[buf[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
            else:  # a word longer than a part
                more = end
                while more < len(buf) and not _SEPARATOR[buf[more]]:
                    more += 1
                end = more
        out.append(_words(buf[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted hashes of the distinct k-word shingles; with fewer words, one hash of the whole sequence; none
    without words."""
    w = word_hashes(text) if text else np.zeros(0, np.uint64)
    n = len(w)
    if not n:
        return w
    size = min(k, n)
    h = w[: n - size + 1] * np.uint64(2 * size + 1)
    for j in range(1, size):
        h = (h ^ h >> np.uint64(31)) * _M2 + w[j : n - size + 1 + j]
    return np.unique(_mixed(h))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many hashes two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
