"""Keys by which lines meet that are within a bound of edits.

The bound k depends on the length of the shorter line.  A class holds the lengths for which it is the
same and which are alike; each class has one size of segments, so that k + 1 of them fit into its shortest line:
one half from the start of a line, the others from its end.  Take two lines within k edits.  If each segment from the start were
changed or had more edits before it than segments, and the same held from the end, there would be more
than k edits: so some segment i of the shorter occurs unchanged in the longer, shifted by i bytes at most.

A segment is indexed by the least hash of its runs of ``gram`` bytes.  That depends on the segment's bytes
alone, so the unchanged segment gives the same key; and the longer line, whose substrings at all shifts
are probed, has few different least hashes, as neighbouring substrings mostly share theirs.  With each such key travels one
byte of the hash of every whole substring that gives it, so that lines only meet if those agree too.
"""

from __future__ import annotations

import functools

import numpy as np

from .shingles import _BASE, _BYTES, mix, powers

MOST_EDITS = 15  # as many as ``edit_distance.within`` takes
MOST_SEGMENT = 64
_inverse = np.ones(1, np.uint64)


def inverse_powers(most: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < most:
        _inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * most, pow(int(_BASE), -1, 1 << 64), np.uint64))])
    return _inverse


def allowed(length, edits: int, percent: int):
    """Edits that a pair may have whose shorter line has this length."""
    return np.maximum(edits, np.minimum(MOST_EDITS, length * percent // 100))


@functools.lru_cache
def classes(edits: int, percent: int, least: int) -> list[tuple[int, int, int, int, int]]:
    """(least length, length past the last, edits, bytes of a segment, bytes of a gram), lengths rising without gaps."""
    if not 0 <= edits <= MOST_EDITS or not 0 <= percent < 50:
        raise ValueError(f"edits from 0 to {MOST_EDITS} and less than 50 per cent, not {edits} and {percent}")
    out, low = [], max(least, edits + 1)
    while low < 1 << 40:
        k = int(allowed(low, edits, percent))
        changes = -(-100 * (k + 1) // percent) if percent and k < MOST_EDITS else 1 << 41
        high = max(low + k + 2, low * 5 // 4)
        if high + k + 2 > changes:
            high = changes
        segment = min(MOST_SEGMENT, low // (k + 1))
        out.append((low, high, k, segment, segment if segment <= 12 else max(8, min(24, segment // 2))))
        low = high
    return out


@functools.lru_cache
def shifts(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, shift, whether counted from the end) of every substring of a line to probe for k edits."""
    rows = [(i, move, end) for end, count in ((0, (k + 2) // 2), (1, (k + 1) // 2)) for i in range(count) for move in range(-i, i + 1)]
    return tuple(np.array(rows, np.int64).T)


POST = 128


def segment_keys(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, edits: int, percent: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, line, number of substrings, their bytes of hash) of the lines that are given by their bytes.

    Each key comes about once a line; ``POST`` is added to the number where the first of the substrings is a segment of the line.
    """
    lengths, keys, lines, counts, checks = ends - starts, [], [], [], []
    for number, (low, high, k, segment, gram) in enumerate(classes(edits, percent, least)):
        if not len(lengths) or low > lengths.max():
            break
        # lines a little longer than the class may have their partner in it
        some = np.flatnonzero((lengths >= low) & (lengths < high + k))
        if len(some):
            # of a long line only the bytes that its segments reach, as one piece from either end
            reach = ((k + 2) // 2 + 1) * segment + k
            size = lengths[some]
            cut = size > 4 * reach
            begin = np.concatenate([starts[some], ends[some][cut] - reach])
            held = np.concatenate([np.where(cut, reach, size), np.full(int(cut.sum()), reach)])
            base = np.cumsum(held) - held
            tail = np.zeros(len(some), np.int64)
            tail[cut] = base[len(some) :] - size[cut] + reach  # adds to a place in the line
            tail[~cut] = base[: len(some)][~cut]
            place = np.arange(int(held.sum())) + np.repeat(begin - base, held)
            value, whole = _least_hashes(raw, place, segment, gram)
            piece, move, from_end = shifts(k)
            at = np.where(from_end == 1, size[:, None] - (piece + 1) * segment + move, piece * segment + move)
            inside = (at >= 0) & (at <= (size - segment)[:, None])
            at += np.where(from_end == 1, tail[:, None], base[: len(some), None])
            row, column = np.nonzero(inside)
            at = at[inside]
            key = value[at] + ((piece * 2 + from_end + 64 * number).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))[column]
            check = whole[at]
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])]))
            count = np.diff(np.append(first, len(key)))
            own = np.flatnonzero(move[column] == 0)
            entry = np.searchsorted(first, own, "right") - 1
            swapped = check[first[entry]]
            check[first[entry]] = check[own]
            check[own] = np.where(first[entry] == own, check[own], swapped)
            count[entry] += POST
            keys.append(mix(key[first]))
            lines.append(some[row[first]])
            counts.append(count.astype(np.uint8))
            checks.append(check)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.uint8)
    return np.concatenate(keys), np.concatenate(lines), np.concatenate(counts), np.concatenate(checks)


def picked(order: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of the substrings of the entries in a given order; ``counts`` are without ``POST``."""
    start = np.cumsum(counts, dtype=np.int64) - counts
    sizes = counts[order]
    moved = np.repeat((start[order] - (np.cumsum(sizes, dtype=np.int64) - sizes)).astype(np.int32), sizes)
    moved += np.arange(len(moved), dtype=np.int32)
    return moved


def _least_hashes(raw: np.ndarray, place: np.ndarray, segment: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the gathered bytes the least hash of the grams of the substring there, and a byte of its own hash."""
    data, count = raw[place], segment - gram + 1
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[data] * powers(len(data))[: len(data)])])
    value = np.zeros(len(data), np.uint64)
    n = max(0, len(data) - gram + 1)
    value[:n] = (sums[gram:] - sums[: len(sums) - gram])[:n] * inverse_powers(len(data) + 1)[:n]
    value ^= value >> np.uint64(32)
    whole = np.zeros(len(data), np.uint8)
    n = max(0, len(data) - segment + 1)
    whole[:n] = ((sums[segment:] - sums[: len(sums) - segment])[:n] * inverse_powers(len(data) + 1)[:n] >> np.uint64(53)).astype(np.uint8)
    span = 1
    while 2 * span <= count:
        value[: len(value) - span] = np.minimum(value[: len(value) - span], value[span:])
        span *= 2
    if span < count:
        out = value.copy()
        out[: len(value) - (count - span)] = np.minimum(value[: len(value) - (count - span)], value[count - span :])
        value = out
    return value, whole
