"""Cells of like documents, by a tree of centres.

A document's vector is the sum of fixed random signs for each of its distinct token ids, weighted by BM25; less the mean of
all vectors, brought to length 1. Weights and vectors are rounded to whole numbers, so that products don't depend on the order of sums. The
centres are those of spherical k-means in two levels over a sample chosen by hash, about as many as leaves are asked for; the
upper level has the square root of them, so the work for a document grows with the root of the corpus. A cell is the leaf of the nearest centres and four signs
of what the leaf's centre leaves over. Cells with neighbouring numbers are of the same leaf or branch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Numbers of a vector; signs in a cell; whole numbers stand for 1/SCALE. DIM * 127 * 127 < 2^24: float32 holds all products.
DIM, SIGNS, SCALE = 128, 4, 400
#: Documents of the sample: so many at least, and so many for each leaf.
LEAST, EACH = 4096, 4
#: Leaves of a tree at most, since trees are broadcast.
MOST = 1 << 16
ROUNDS = 6


@lru_cache(maxsize=1)
def _directions(width: int) -> np.ndarray:
    return np.random.default_rng(5).integers(0, 2, (width, DIM), np.int8) * np.int8(2) - np.int8(1)


def sums(doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, some: int = 64) -> np.ndarray:
    """The vectors of n documents from their (document, term, weight), documents ascending; not yet of length 1."""
    out = np.zeros((n, DIM), np.float32)
    directions, rounded = _directions(1 << 16), np.rint(weight * 16).astype(np.float32)
    for start in range(0, n, some):  # some documents at a time, as a dense product over the terms they have
        part = slice(*np.searchsorted(doc, [start, start + some]))
        used = np.flatnonzero(np.bincount(term[part], minlength=1))
        dense = np.zeros((min(some, n - start), len(used)), np.float32)
        dense[doc[part] - start, np.searchsorted(used, term[part])] = rounded[part]
        out[start : start + some] = dense @ directions[used].astype(np.float32)
    return out


def whole(x: np.ndarray) -> np.ndarray:
    """Length 1, as whole numbers."""
    length = np.maximum(np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True)), 1e-9)
    return np.clip(np.rint(x / length * SCALE), -127, 127).astype(np.float32)


def centres(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """At most k centres of x, and the nearest one of each row."""
    found = np.unique(x[:k], axis=0) if len(x) else np.zeros((1, DIM), np.float32)
    for _ in range(ROUNDS if len(found) > 1 else 0):
        near = (x @ found.T).argmax(1)
        order = np.argsort(near, kind="stable")
        some, begin = np.unique(near[order], return_index=True)
        found = whole(np.add.reduceat(x[order], begin, axis=0))
    return found, (x @ found.T).argmax(1) if len(x) else np.zeros(0, np.int64)


@dataclass
class Tree:
    idf: np.ndarray
    mean: float  # tokens of a document
    middle: np.ndarray
    upper: np.ndarray
    leaves: np.ndarray
    first: np.ndarray  # of each upper centre, its first leaf; one more for the end

    @staticmethod
    def grow(raw: np.ndarray, leaves: int, idf: np.ndarray, mean: float) -> Tree:
        """The tree over the whole vectors of a sample."""
        raw = raw[np.lexsort(raw.T[::-1])] if len(raw) else raw
        raw = raw[np.random.default_rng(7).permutation(len(raw))]
        middle = raw.mean(0, dtype=np.float64).astype(np.float32) if len(raw) else np.zeros(DIM, np.float32)
        x = whole(raw - middle)
        upper, near = centres(x, max(1, round(leaves**0.5)))
        if len(x):
            upper = upper[np.unique(near)]
            near = np.unique(near, return_inverse=True)[1]
        lower = [centres(x[near == i], max(1, round(leaves * np.mean(near == i))) if len(x) else 1)[0] for i in range(len(upper))]
        return Tree(idf, mean, middle, upper, np.concatenate(lower), np.cumsum([0, *map(len, lower)]))

    def cells(self, raw: np.ndarray) -> np.ndarray:
        x = whole(whole(raw) - self.middle)
        near = (x @ self.upper.T).argmax(1)
        leaf = np.zeros(len(x), np.int64)
        for i in np.unique(near):
            mine = np.flatnonzero(near == i)
            leaf[mine] = self.first[i] + (x[mine] @ self.leaves[self.first[i] : self.first[i + 1]].T).argmax(1)
        signs = (x - self.leaves[leaf])[:, :SIGNS] > 0
        return (leaf << SIGNS) + signs @ (1 << np.arange(SIGNS)[::-1])


def _runs(load: list[float], most: float) -> Iterator[tuple[int, int]]:
    """Runs (start, stop) of neighbours that hold at most `most` together, or one alone."""
    start, held = 0, 0.0
    for i, x in enumerate(load):
        if i > start and held + x > most:
            yield start, i
            start, held = i, 0.0
        held += x
    if load:
        yield start, len(load)


def deal(load: dict[int, float]) -> list[tuple[int, int, int]]:
    """(cell, first shard, shards) of each cell, load being in shards. Small leaves share a shard with their neighbours, a leaf of
    more than 1.5 shards goes by its cells, and a cell of more than 1.5 over several shards."""
    most, out, shard = 1.5, [], 0
    by_leaf: dict[int, list[int]] = {}
    for c in sorted(load):
        by_leaf.setdefault(c >> SIGNS, []).append(c)
    units: list[list[int]] = []
    for own in by_leaf.values():
        units += [own] if sum(load[c] for c in own) <= most else [own[a:b] for a, b in _runs([load[c] for c in own], most)]
    totals = [sum(load[c] for c in u) for u in units]
    for a, b in _runs(totals, most):
        parts = max(1, round(totals[a])) if b - a == 1 and totals[a] > most else 1
        out += [(c, shard, parts) for u in units[a:b] for c in u]
        shard += parts
    return out
