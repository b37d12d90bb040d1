"""Word shingles of whole texts as 64-bit hashes, and MinHash signatures of them."""

from __future__ import annotations

import numpy as np

from spindrift.llm._common import RollingHash, mix, slabs

_WORDS = RollingHash(31)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = 5):
    """(row, sorted distinct hashes) of each row's runs of `words` words.

    A word is a maximal run of bytes other than ASCII white space.  A text of
    fewer words has one shingle, all of it; a text without words has none.
    """
    for i, j in slabs(offsets):
        part = data[offsets[i] : offsets[j]]
        bounds = offsets[i : j + 1] - offsets[i]
        inside = np.zeros(len(part) + 2, bool)
        inside[1:-1] = ~_SPACE[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[bounds] = True
        begins = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        hashes = mix(_WORDS.between(_WORDS.prefix(part), begins, ends) + (ends - begins).astype(np.uint64))
        first = np.searchsorted(begins, bounds)
        count = np.diff(first)
        run = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
        for k in range(words):
            run = run * _STEP + hashes[k : k + len(run)]
        run = mix(run)
        for r in range(j - i):
            n, at = int(count[r]), int(first[r])
            if n >= words:
                yield i + r, np.unique(run[at : at + n - words + 1])
            elif n:
                h = np.uint64(n)
                with np.errstate(over="ignore"):
                    for x in hashes[at : at + n]:
                        h = h * _STEP + x
                yield i + r, mix(np.array([h]))
            else:
                yield i + r, np.zeros(0, np.uint64)


class MinHash:
    def __init__(self, size: int, seed: int = 41):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.a = rng.integers(0, 2**64, size, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 2**64, size, dtype=np.uint64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """The least of the upper 32 bits of each of the functions, over the set."""
        out = np.full(len(self.a), 2**64 - 1, np.uint64)
        for k in range(0, len(hashes), 256):
            np.minimum(out, (hashes[k : k + 256, None] * self.a + self.b).min(axis=0), out=out)
        return (out >> np.uint64(32)).astype(np.uint32)
