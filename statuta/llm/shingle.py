"""Vectorised word-shingle sets over a batch of texts.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z.  A document's set holds
the 64-bit hashes of its distinct windows of ``width`` words; a document with
fewer words has one element, the hash of its whole word sequence; a document
without words has none.  Everything works on the UTF-8 bytes of a whole Arrow
batch at once, so no Python object is made per word.
"""

from __future__ import annotations

import numpy as np

_GAMMA = np.uint64(0x9E3779B97F4A7C15)
#: Base of the polynomial word hash: odd, hence invertible modulo 2**64.
_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64 steps)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _GAMMA)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


class WordHasher:
    """Hashes of the words of texts; keeps its power tables between batches."""

    def __init__(self) -> None:
        self._up = _powers(_BASE, 1 << 16)
        self._down = _powers(_BASE_INV, 1 << 16)

    def _grow(self, n: int) -> None:
        if n > len(self._up):
            size = 1 << (n - 1).bit_length()
            self._up, self._down = _powers(_BASE, size), _powers(_BASE_INV, size)

    def words(self, data: np.ndarray) -> np.ndarray:
        """The hashes of the words in one text's UTF-8 bytes, in order."""
        n = len(data)
        if not n:
            return np.empty(0, dtype=np.uint64)
        self._grow(n + 1)
        low = _LOWER[data]
        space = np.concatenate(([True], _IS_SPACE[low], [True]))
        starts = np.flatnonzero(space[:-1] & ~space[1:])
        ends = np.flatnonzero(~space[:-1] & space[1:])
        if not len(starts):
            return np.empty(0, dtype=np.uint64)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[low] * self._up[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self._down[starts] + (ends - starts).astype(np.uint64) * _GAMMA)


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct window hashes of one document (see the module's text)."""
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    span = min(width, n)
    acc = np.zeros(n - span + 1, dtype=np.uint64)
    for k in range(span):
        acc = mix(acc * _GAMMA + words[k : n - span + 1 + k] + np.uint64(k + 1))
    if n < width:
        acc = mix(acc ^ np.uint64(n))
    return np.unique(acc)


def set_digest(hashes: np.ndarray) -> bytes:
    """16 bytes that identify a set: two independent order-free sums of its hashes."""
    a = mix(hashes ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    b = mix(hashes ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def minhash(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One minimum per seed over a non-empty set, as uint64."""
    out = np.empty(len(seeds), dtype=np.uint64)
    step = max(1, (1 << 18) // max(1, len(hashes)))
    for i in range(0, len(seeds), step):
        x = hashes[None, :] * (seeds[i : i + step, None] | np.uint64(1))
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        out[i : i + step] = x.min(axis=1)
    return out
