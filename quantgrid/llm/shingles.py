"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from quantgrid.llm.tokens import Chunks

WORDS = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_WORD_HASHES = Chunks(xxhash.xxh3_64_intdigest)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose outputs look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str) -> np.ndarray:
    """Hashes of the windows of five words; a text of fewer words is one shingle, one without words has none."""
    words = text.encode().split()  # of bytes: at space and tab to return only
    hashes = np.fromiter(map(_WORD_HASHES.__getitem__, words), np.uint64, len(words))
    n = len(words)
    if n < WORDS:
        return mix((hashes * _ODD[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)) if n else hashes
    total = hashes[: n - WORDS + 1] * _ODD[0]
    for k in range(1, WORDS):
        total += hashes[k : n - WORDS + 1 + k] * _ODD[k]
    return np.unique(mix(total))


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def common_counts(sets: list[np.ndarray], slab: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all sets with each other, in slabs of elements so that memory is bounded."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(x) for x in sets])
    _, element, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[element]
    row, element = row[keep], place[element[keep]]
    total = np.zeros((m, m), np.float32)
    order = np.argsort(element, kind="stable")
    row, element = row[order], element[order]
    n = int(shared.sum())
    for first in range(0, n, slab):
        a, b = np.searchsorted(element, [first, first + slab])
        block = np.zeros((m, min(slab, n - first)), np.float32)
        block[row[a:b], element[a:b] - first] = 1
        total += block @ block.T
    return np.rint(total).astype(np.int64)
