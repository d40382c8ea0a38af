"""Hashes of many byte runs at once, and a table from hash to position, both in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_BLOCK = 1 << 12
_factors = np.zeros(0, np.uint64)


def factors(n: int) -> np.ndarray:
    """The first n (or more) of an endless row of independent random odd numbers, drawn block by block."""
    global _factors
    while len(_factors) < n:
        more = max(1, len(_factors) // _BLOCK)  # doubles
        first = len(_factors) // _BLOCK
        drawn = [np.random.default_rng([20240229, first + k]).integers(1, 1 << 63, _BLOCK, dtype=np.uint64) | U(1) for k in range(more)]
        _factors = np.concatenate([_factors, *drawn])
    return _factors


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits (xor-shift and multiply)."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h = h * U(0xA3B195354A39B70D)
    h ^= h >> U(32)
    return h


def hash_runs(data: np.ndarray, start: np.ndarray, stop: np.ndarray, slab: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each data[start:stop]; runs are in order, don't overlap and aren't empty.

    Multilinear: each place has a factor of its own, drawn at random and not as powers of one number, so runs built to collide
    under powers don't. Two different runs that were chosen without looking at the factors get equal hashes with a probability
    below 2**-55. Works through about `slab` bytes at a time."""
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    n = stop - start
    done = np.cumsum(n)
    k = 0
    while k < len(start):
        e = int(np.searchsorted(done, (done[k - 1] if k else 0) + slab, "right"))
        e = max(e, k + 1)
        m = n[k:e]
        first = np.cumsum(m) - m
        inside = np.arange(int(m.sum())) - np.repeat(first, m)
        at = inside + np.repeat(start[k:e], m)
        v = _BYTE[data[at]] * factors(int(m.max()))[inside]
        out[k:e] = np.add.reduceat(v, first)
        k = e
    return mix(out + n.astype(np.uint64) * U(0xC2B2AE3D27D4EB4F))


class HashTable:
    """Positions 0, 1, 2, ... of 64-bit keys in the order they came; open addressing, grown by doubling."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot that holds each key or the free one where its search ends, and whether it holds it."""
        mask = np.int64((1 << self.bits) - 1)
        slot = (keys >> U(64 - self.bits)).astype(np.int64)
        found = self.values[slot] >= 0
        same = found & (self.keys[slot] == keys)
        left = np.flatnonzero(found & ~same)
        while len(left):
            s = (slot[left] + 1) & mask
            slot[left] = s
            used = self.values[s] >= 0
            hit = used & (self.keys[s] == keys[left])
            same[left[hit]] = True
            left = left[used & ~hit]
        return slot, same

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's position, or -1."""
        slot, same = self._probe(keys)
        return np.where(same, self.values[slot], -1)

    def add(self, keys: np.ndarray) -> None:
        """Adds distinct keys that it doesn't hold."""
        while (self.n + len(keys)) * 2 > 1 << self.bits:
            old = self.values >= 0
            k, v = self.keys[old], self.values[old]
            self.bits += 1
            self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
            self._put(k, v)
        self._put(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n += len(keys)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        while len(keys):
            slot, _ = self._probe(keys)
            self.keys[slot], self.values[slot] = keys, values  # of several at one slot, one stays
            left = self.values[slot] != values
            keys, values = keys[left], values[left]
