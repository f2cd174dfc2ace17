"""A minimal perfect hash over 64-bit keys, looked up in whole arrays at once."""

from __future__ import annotations

import numpy as np

from .blocks import mix

#: Keys in a bucket on average.
_LOAD = 2
_TRIES = 64


class PerfectHash:
    """n distinct keys on n slots without gaps: keys share a bucket, and a bucket has a displacement that sets its keys apart."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        n = len(keys)
        self.n, self.buckets, self.seed = n, max(1, n // _LOAD), 0
        while not self._place(keys):
            self.seed += 1  # two keys of a bucket go the same way: scramble them otherwise
        self.keys, self.values = np.zeros(n, np.uint64), np.zeros(n, values.dtype)
        at = self._slots(keys)
        self.keys[at], self.values[at] = keys, values

    def _place(self, keys: np.ndarray) -> bool:
        """Find all displacements; False if a bucket has none."""
        n = self.n
        bucket, first, step = self._parts(keys)
        self.shift = np.zeros(self.buckets, np.int64)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=self.buckets)
        begin = np.concatenate([[0], np.cumsum(size)])
        free = np.ones(n, bool)
        tries = np.arange(_TRIES, dtype=np.uint64)[:, None]
        for b in np.argsort(-size, kind="stable"):
            if size[b] < 2:
                break
            own = order[begin[b] : begin[b + 1]]
            for base in range(0, max(n, _TRIES), _TRIES):
                slots = ((first[own] + (tries + np.uint64(base)) * step[own]) % np.uint64(n)).astype(np.int64)
                t = next((t for t in np.flatnonzero(free[slots].all(1)).tolist() if len(set(slots[t].tolist())) == len(own)), None)
                if t is not None:
                    self.shift[b] = t + base
                    free[slots[t]] = False
                    break
            else:
                return False
        single = np.flatnonzero(size == 1)
        self.shift[single] = -1 - np.flatnonzero(free)[: len(single)]  # a key alone in its bucket takes a free slot outright
        return True

    def _parts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys ^ np.uint64(self.seed))
        g = h * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64), h & np.uint64(0x7FFFFFFF), g >> np.uint64(33) | np.uint64(1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        bucket, first, step = self._parts(keys)
        shift = self.shift[bucket]
        moved = (first + shift.astype(np.uint64) * step) % np.uint64(self.n)
        return np.where(shift < 0, -1 - shift, moved.astype(np.int64))

    def find(self, keys: np.ndarray, missing: int) -> np.ndarray:
        """Value of each key; `missing` for keys that aren't in."""
        if not len(keys) or not self.n:
            return np.full(len(keys), missing, self.values.dtype)
        at = self._slots(keys)
        return np.where(self.keys[at] == keys, self.values[at], missing)
