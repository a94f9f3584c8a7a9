"""Minimal perfect hash over byte keys: n keys, n slots, no table of the keys needed to find one.

Keys go to buckets of about four; buckets, largest first, search for a pilot that puts all
their keys on free slots; a bucket of one key stores its slot outright.
"""
from __future__ import annotations

import numpy as np
import xxhash

_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class PerfectHash:
    """`pilots` is the whole structure: 8 bytes for about four keys."""

    def __init__(self, pilots: np.ndarray, n: int):
        self.pilots, self.n = pilots, n
        self._list = pilots.tolist()

    @staticmethod
    def halves(keys: list[bytes]) -> np.ndarray:
        """Two 64-bit hashes per key: shape (2, n). The second one also serves as a fingerprint."""
        both = [xxhash.xxh3_128_intdigest(k) for k in keys]
        return np.array([[h & _MASK for h in both], [h >> 64 for h in both]], np.uint64).reshape(2, len(keys))

    @classmethod
    def build(cls, halves: np.ndarray, load: int = 4) -> PerfectHash:
        """From the hashes of distinct keys; equal hashes raise ValueError."""
        n = halves.shape[1]
        if not n:
            return cls(np.zeros(1, np.int64), 0)
        if len(np.unique(halves, axis=1)[0]) != n:
            raise ValueError("keys are not distinct")
        m = max(1, n // load)
        bucket = (halves[0] % np.uint64(m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=m)
        first = np.concatenate([[0], np.cumsum(sizes)])
        pilots, free = np.zeros(m, np.int64), np.ones(n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            own = halves[1][order[first[b]:first[b + 1]]]
            base, step = 0, 32
            while True:  # many pilots at once, more as free slots get rare
                tries = np.arange(base, base + step, dtype=np.uint64)
                slots = (_mix(own[None, :] + tries[:, None] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)
                fit = np.flatnonzero(free[slots].all(1))
                fit = next((i for i in fit if len(set(slots[i].tolist())) == len(own)), None)
                if fit is not None:
                    pilots[b], free[slots[fit]] = base + int(fit), False
                    break
                base, step = base + step, min(4 * step, 4096)
        left = iter(np.flatnonzero(free).tolist())
        for b in np.flatnonzero(sizes == 1):
            pilots[b] = -1 - next(left)
        return cls(pilots, n)

    def slots(self, halves: np.ndarray) -> np.ndarray:
        """Slot of each key; for a key that was not built in, the slot of some other key."""
        if not self.n:
            return np.zeros(halves.shape[1], np.int64)
        pilot = self.pilots[(halves[0] % np.uint64(len(self.pilots))).astype(np.int64)]
        moved = _mix(halves[1] + np.maximum(pilot, 0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)
        return np.where(pilot < 0, -1 - pilot, moved.astype(np.int64))

    def slot(self, key: bytes) -> int:
        """The same for one key, in plain integers."""
        h = xxhash.xxh3_128_intdigest(key)
        pilot = self._list[(h & _MASK) % len(self._list)]
        if pilot < 0:
            return -1 - pilot
        x = ((h >> 64) + pilot * 0x9E3779B97F4A7C15) & _MASK
        x = ((x ^ (x >> 33)) * 0xFF51AFD7ED558CCD) & _MASK
        return (x ^ (x >> 29)) % self.n
