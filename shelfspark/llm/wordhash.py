"""64-bit hashes of all words of many texts at once, from their UTF-8 bytes.

Words are what stands between ASCII white space. A word's hash is the sum of a random value for each byte times
a power for its place in the word, mixed well; the tables are the same everywhere, so that hashes agree between tasks.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_BYTES = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE)]))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end in raw, and for each text the number of words before it (one more entry for all)."""
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[True], gap[:-1]]) | edge[:-1] if len(raw) else np.zeros(0, bool)
    after = np.concatenate([gap[1:], [True]]) | edge[1:] if len(raw) else np.zeros(0, bool)
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    place = np.arange(total) - np.repeat(first, lengths)
    letters = raw[np.repeat(starts, lengths) + place]
    return mix(np.add.reduceat(_BYTES[letters] * powers(int(lengths.max()))[place], first))


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return raw | (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)
