"""Word shingles of whole texts as 64-bit hashes, from Arrow's UTF-8 bytes by array operations.

A word is a run of bytes other than ASCII white space, A-Z lower-cased.  Its
hash sums a random value of each byte times a power of an odd base, mixed; a
shingle's hash sums its words' hashes, each times its own odd factor, mixed.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240229)
_BYTES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def powers(most: int) -> np.ndarray:
    global _powers
    if len(_powers) < most:
        _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * most, _BASE))])
    return _powers


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of each span of bytes; spans ascend and do not overlap, none is empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    values = (_BYTES if not seed else mix(_BYTES + np.uint64(seed)))[raw[at + np.repeat(starts, lengths)]] * powers(int(lengths.max()))[at]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and one past the last)."""
    solid = ~_SPACE[raw]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(raw))]
    opens[inner] = solid[inner]
    closes[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(opens)
    hashes = span_hashes(_LOWER[raw], starts, np.flatnonzero(closes) + 1)
    return hashes, np.searchsorted(starts, offsets)


def text_shingles(raw: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; all words as one where there are fewer than ``width``."""
    hashes, bounds = words(raw, offsets)
    total = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        total += hashes[k : len(hashes) - width + 1 + k] * _FACTORS[k] if len(total) else total
    total = mix(total)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            part = np.sort(total[a : b - width + 1])
            out.append(part[np.concatenate([[True], part[1:] != part[:-1]])])
        elif b > a:
            out.append(mix((hashes[a:b] * _FACTORS[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
