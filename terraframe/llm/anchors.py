"""Content-defined anchors of all windows of a fixed number of bytes.

Each window is assigned the leftmost of its k-grams with the least hash. The choice depends on the window's
bytes alone, so equal windows have equal anchors at equal offsets, wherever they are. Consecutive windows
with one anchor are a block: ``[lo, lo + n + length - 1)`` holds the bytes of its n windows.
"""

from __future__ import annotations

import numpy as np

BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POWERS: dict[int, list[np.ndarray]] = {}
POSITION_BITS = 24


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> list[np.ndarray]:
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        _POWERS[base] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, b, np.uint64), dtype=np.uint64))) for b in (np.uint64(base), np.uint64(pow(base, -1, 1 << 64)))]
    return _POWERS[base]


class Sums:
    """Polynomial hashes of any substring of ``data``."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        power, self.inverse = _powers(len(data) + 1, base)
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(np.arange(256, dtype=np.uint64) + np.uint64(1))[data] * power[: len(data)], dtype=np.uint64)))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.empty(0, np.uint64)

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.inverse[lo] + (hi - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def blocks(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Blocks of the texts that ``offsets`` cut ``data`` into: (text number, lo in data, n windows, anchor in data, anchor's hash, and two hashes of the block, by different bases)."""
    empty = np.empty(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, *[empty.astype(np.uint64)] * 3
    sums = Sums(data)
    grams = sums.grams(k)
    wide = length - k + 1  # k-grams of a window
    least = (grams >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS)) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while 2 * size <= wide:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < wide:
        least = np.minimum(least[: len(least) - (wide - size)], least[wide - size :])
    anchor = (least & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    valid = np.ones(len(anchor), bool)
    ends = offsets[1:]
    tail = ends[:, None] - np.arange(1, length)[None, :]
    tail = tail[(tail >= offsets[:-1, None]) & (tail < len(valid))]
    valid[tail] = False
    at = np.flatnonzero(valid)
    if not len(at):
        return empty, empty, empty, empty, *[empty.astype(np.uint64)] * 3
    own = anchor[at]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(own) != 0) | (np.diff(at) != 1))))
    lo, n = at[first], np.diff(np.concatenate((first, [len(at)])))
    text = np.searchsorted(offsets, lo, "right") - 1
    hi = lo + n + length - 1
    anchors, one = grams[own[first]], sums.of(lo, hi)
    del sums, grams, least
    return text, lo, n, own[first], anchors, one, Sums(data, BASES[1]).of(lo, hi)
