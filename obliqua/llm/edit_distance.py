"""Bounded edit distance of many pairs at once: a diagonal band of the table, one bit a cell.

The band holds the diagonals that a path of ``bound`` edits from corner to corner can touch, ``bound`` + 1 at most: who leaves
the way between the corners by one has to come back by one.  Two words of bits
tell for each pair where the column rises and falls, and every column of all
pairs takes a few word operations; pairs that are past their bound leave.  Where both of a pair are longer than ``LONG``,
its diagonals are followed as far as each number of edits reaches: the same band, in long strides.
"""

from __future__ import annotations

import numpy as np


LONG = 1 << 14


def _plain(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


LONG = 1 << 14


def _plain(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _matrix(items: list[bytes], width: int, fill: int) -> np.ndarray:
    out = np.full((len(items), width), fill, np.int16)
    lengths = np.array([len(x) for x in items])
    rows = np.repeat(np.arange(len(items)), lengths)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.frombuffer(b"".join(items), np.uint8)
    return out


def _strides(a: bytes, b: bytes, bound: int) -> bool:
    """Whether the two are within the bound, by the furthest place on each diagonal for 0, 1, ... edits."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)

    def slide(i: int, j: int) -> int:
        step = 64
        while (room := min(step, len(x) - i, len(y) - j)) > 0:
            other = np.flatnonzero(x[i : i + room] != y[j : j + room])
            if len(other):
                return i + int(other[0])
            i, j, step = i + room, j + room, min(2 * step, 1 << 16)
        return i

    goal, reach = len(y) - len(x), {0: slide(0, 0)}
    for edits in range(bound + 1):
        if reach.get(goal, -1) == len(x):
            return True
        beyond = {}
        for d in range(-edits - 1, edits + 2):  # diagonal d holds places (i, i + d)
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1)
            i = min(i, len(x), len(y) - d)
            if i >= 0 and i + d >= 0:
                beyond[d] = slide(i, i + d)
        reach = beyond
    return False


def within(left: list[bytes], right: list[bytes], bounds) -> np.ndarray:
    """Whether each pair of byte strings is at most so many edits (0 to 15, one number or one a pair) apart."""
    sizes = np.array([len(t) for t in [*left, *right]], np.int64)
    at = np.arange(len(left))
    return near_pairs(np.frombuffer(b"".join([*left, *right]), np.uint8), np.cumsum(sizes) - sizes, sizes, at, at + len(left), np.broadcast_to(np.asarray(bounds, np.int64), len(left)))


def near_pairs(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray, bounds: np.ndarray, most_cells: int = 1 << 21) -> np.ndarray:
    """Whether strings x and y of each pair, given by their starts and sizes in ``raw``, are within its bound (0 to 15).

    Pairs are taken together in order of length, as many as stay under ``most_cells`` when padded to the longest.
    """
    x, y = np.where(sizes[x] >= sizes[y], x, y), np.where(sizes[x] >= sizes[y], y, x)
    good, short = np.zeros(len(x), bool), sizes[y]
    like = sizes[x] - short <= bounds
    text = lambda i: raw[starts[i] : starts[i] + sizes[i]].tobytes()
    for i in np.flatnonzero(like & ((short <= bounds) | (short > LONG))).tolist():
        a, b = text(x[i]), text(y[i])
        good[i] = _plain(a, b) <= bounds[i] if short[i] <= bounds[i] else _strides(a, b, int(bounds[i]))
    like &= (short > bounds) & (short <= LONG)
    for low, high in ((0, 3), (4, 7), (8, 15)):
        some = np.flatnonzero(like & (bounds >= low) & (bounds <= high))
        some = some[np.argsort(-short[some], kind="stable")]
        k = 0
        while k < len(some):
            part = some[k : k + max(1, most_cells // (int(short[some[k]]) + 2 * high))]
            front = (bounds[part] - sizes[x[part]] + short[part]) // 2
            good[part] = _banded(_padded(raw, starts, sizes, x[part], front), _padded(raw, starts, sizes, y[part], 0 * front), sizes[x[part]], short[part], bounds[part], high)
            k += len(part)
    return good


def _padded(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray, front: np.ndarray) -> np.ndarray:
    """The strings as rows, with -1 around them, ``front`` (15 at most) before each."""
    one, at = np.unique(which << 4 | front, return_inverse=True)
    one, front = one >> 4, one & 15
    size = sizes[one]
    out = np.full((len(one), int((front + size).max()) + 48), -1, np.int16)
    rows = np.repeat(np.arange(len(one)), size)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
    out[rows, place + front[rows]] = raw[place + np.repeat(starts[one], size)]
    return out[at]


def _banded(a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray, bounds: np.ndarray, bound: int) -> np.ndarray:
    """Whether each pair is within its bound, ``bound`` at most; ``a`` are no shorter than ``b``, which fall in length.

    Row r of column j is character j - front + r of the longer text, which therefore has so many places in front: half of the edits that
    the difference of the lengths leaves.
    """
    width = bound + 1
    kind = np.uint8 if width <= 8 else np.uint16
    window = 8 * np.dtype(kind).itemsize
    full, one = kind((1 << width) - 1), kind(1)
    front = ((bounds - m + n) // 2).astype(kind)
    # before the first column the rows from 1 on rise by one each
    up = (np.full(len(m), full, kind) >> front << front) & full
    down = np.zeros(len(m), kind)
    # the diagonal that ends at the last cell: its values never fall, and rise by one where its bit is not set
    row, score = (m - n).astype(kind) + front, m - n
    here, out = np.arange(len(m)), np.zeros(len(m), np.int64)
    for j in range(int(n[0])):
        if j % 16 == 0 and j:
            keep = score <= bounds[here]
            if keep.mean() < 0.75:
                out[here[~keep]] = bound + 1
                a, b, up, down, row, score, n, here = (x[keep] for x in (a, b, up, down, row, score, n, here))
        if len(n) and n[-1] <= j:  # the last ones have ended
            active = int(np.searchsorted(-n, -j, "left"))
            out[here[active:]] = score[active:]
            a, b, up, down, row, score, n, here = (x[:active] for x in (a, b, up, down, row, score, n, here))
        if not len(n):
            break
        same = np.packbits(a[:, j : j + window] == b[:, j, None], axis=1, bitorder="little").view(kind).ravel()
        diagonal = ((((same & up) + up) ^ up) | same | down) & full
        rise = down | ~(diagonal | up)
        score = score + (~diagonal >> row & one)
        moved = diagonal >> one
        up = ((diagonal & up) | ~(moved | rise)) & full
        down = moved & rise
    out[here] = score
    return out <= bounds
