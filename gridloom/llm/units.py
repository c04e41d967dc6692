"""Encoding of many texts through their distinct units, each encoded once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

CHUNK = 1 << 20


class UnitCache:
    """A text is cut before each space into units. The ids of a unit, which `learn` gives for many at once, are kept,
    for up to `kept` units (a million take about 40 MB). Units are found by hash and compared byte by byte; texts
    in which two units share a hash are encoded by `whole`."""

    def __init__(self, learn: Callable[[list[bytes]], list[np.ndarray]], whole: Callable[[str], np.ndarray], kept: int = 1_000_000):
        self._learn, self._one, self.kept = learn, whole, kept
        rng = np.random.default_rng(1)
        self.letters = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = np.uint64(0x9E3779B97F4A7C15)
        self.powers = np.cumprod(np.full(CHUNK + 1, base, np.uint64))
        self.inverse = np.cumprod(np.full(CHUNK + 1, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64))
        self._clear()

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text (UTF-8, not empty)."""
        out: list[np.ndarray | None] = [None] * len(texts)
        group: list[int] = []
        size = 0
        for i, raw in enumerate(texts):
            if len(raw) > CHUNK:
                out[i] = self._one(raw.decode())
                continue
            if size + len(raw) > CHUNK:
                self._group(group, texts, out)
                group, size = [], 0
            group.append(i)
            size += len(raw)
        self._group(group, texts, out)
        return out

    def _group(self, group: list[int], texts: list[bytes], out: list) -> None:
        if not group:
            return
        data = [texts[i] for i in group]
        joined = b"".join(data)
        buf = np.frombuffer(joined, np.uint8)
        ends = np.cumsum([len(x) for x in data])
        first = buf == 32
        first[np.concatenate([[0], ends[:-1]])] = True
        start = np.flatnonzero(first)
        length = np.diff(start, append=len(buf))
        # A unit's hash is a polynomial in its bytes, from running sums over the whole buffer.
        run = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.letters[buf] * self.powers[: len(buf)], out=run[1:])
        code = (run[start + length] - run[start]) * self.inverse[start]
        code ^= code >> np.uint64(29)
        _, rep, which = np.unique(code, return_index=True, return_inverse=True)
        same = rep[which]
        place = np.arange(len(buf), dtype=np.int32) + np.repeat((start[same] - start).astype(np.int32), length)
        if (length != length[same]).any() or (buf[place] != buf).any():  # two units of one hash
            return self._whole(group, data, out)
        at = self._known(code[rep], joined, start[rep], length[rep])
        if at is None:
            return self._whole(group, data, out)
        count, pool_at = self.count[at], self.at[at]
        each = count[which]
        upto = np.cumsum(each)
        flat = self.ids[np.arange(upto[-1]) - np.repeat(upto - each - pool_at[which], each)]
        cuts = upto[np.searchsorted(start, ends) - 1]
        for i, ids_of in zip(group, np.split(flat, cuts[:-1]), strict=True):
            out[i] = ids_of

    def _whole(self, group: list[int], data: list[bytes], out: list) -> None:
        for i, raw in zip(group, data, strict=True):
            out[i] = self._one(raw.decode())

    def _clear(self) -> None:
        """code, at, count, raw_at, raw_len: for each kept unit, by hash; ids, raw: what they point into."""
        self.code = np.zeros(0, np.uint64)
        self.at, self.count, self.raw_at, self.raw_len = (np.zeros(0, np.int64) for _ in range(4))
        self.ids, self.raw = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def _known(self, code: np.ndarray, joined: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray | None:
        """Where each unit, given by ascending hash, stands among the kept ones, after learning those that are new; None if a kept unit has the hash of another."""
        if len(self.code) > self.kept:
            self._clear()
        at = np.searchsorted(self.code, code)
        new = np.ones(len(code), bool)
        new[at < len(self.code)] = self.code[at[at < len(self.code)]] != code[at < len(self.code)]
        buf = np.frombuffer(joined, np.uint8)
        old = np.flatnonzero(~new)
        k = at[old]
        if (self.raw_len[k] != length[old]).any():
            return None
        step = np.arange(length[old].sum()) - np.repeat(np.cumsum(length[old]) - length[old], length[old])
        if (self.raw[step + np.repeat(self.raw_at[k], length[old])] != buf[step + np.repeat(start[old], length[old])]).any():
            return None
        if new.any():
            n = np.flatnonzero(new)
            units = [joined[x : x + y] for x, y in zip(start[n].tolist(), length[n].tolist(), strict=True)]
            ids = self._learn(units)
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            here = at[n]
            self.at = np.insert(self.at, here, len(self.ids) + np.cumsum(count) - count)
            self.raw_at = np.insert(self.raw_at, here, len(self.raw) + np.cumsum(length[n]) - length[n])
            self.count, self.raw_len = np.insert(self.count, here, count), np.insert(self.raw_len, here, length[n])
            self.code = np.insert(self.code, here, code[n])
            self.ids = np.concatenate([self.ids, *ids])
            self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(units), np.uint8)])
        return at + np.cumsum(new) - new
