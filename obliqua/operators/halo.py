"""Stencils on blocks with a halo: a voxel goes to its own block and to those within reach, packed in arrays.

For a reach of 5 voxels and the usual blocks a voxel travels 1.4 times, whatever the stencil does with it; a block
is a dense array in its task, so its size bounds the memory.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.volume import KEYS
from .blocks import _flat, pack_batches

SIZE = (64, 128, 128)
#: Blocks along one axis at most, so that three places make one number.
MOST = 1 << 20


def number(z, y, x):
    return (z * MOST + y) * MOST + x


def block_packed(voxels: DataFrame, reach: tuple[int, int, int], size: tuple[int, int, int], shape: tuple[int, int, int] | None = None) -> DataFrame:
    """Rows of arrays by block; voxels outside ``shape`` (if given) or below 0 are left out."""
    ends = shape or tuple(MOST * s for s in size)

    def spans(columns: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for place, r, s, n in zip(columns[3:6], reach, size, ends, strict=True):
            p = place.astype(np.int64)
            first = np.maximum(p - r, 0) // s
            out.append((first, np.where((p >= 0) & (p < n), np.minimum(p + r, n - 1) // s, first - 1)))
        return out

    return pack_batches(voxels, [*KEYS, "z", "y", "x", "v"], spans, number)


#: (values with the halo, whether a voxel is there) -> (values of the block, whether they are told).
Work = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def stencil(voxels: DataFrame, reach: tuple[int, int, int], work: Work, shape: tuple[int, int, int], size: tuple[int, int, int] = SIZE) -> DataFrame:
    """The voxels that ``work`` tells of each block; beyond the volume and where no voxel is, values are 0.  Equal places add up."""
    return stencil_by_place(voxels, reach, lambda values, held, key, outside: work(values, held), shape, size)


#: The same with the slice (image, t, c) and, for each axis, how many places of the halo lie beyond the volume at either end.
PlacedWork = Callable[[np.ndarray, np.ndarray, tuple[int, int, int], list[tuple[int, int]]], tuple[np.ndarray, np.ndarray]]


def stencil_by_place(voxels: DataFrame, reach: tuple[int, int, int], work: PlacedWork, shape: tuple[int, int, int], size: tuple[int, int, int] = SIZE) -> DataFrame:
    """A stencil whose work depends on the slice or on the ends of the volume."""
    schema = pa.schema([*[(k, pa.int32()) for k in (*KEYS, "z", "y", "x")], ("v", pa.float64())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        code = key[3].as_py()
        low = [p * s for p, s in zip((code // MOST // MOST, code // MOST % MOST, code % MOST), size, strict=True)]
        own = [min(s, n - a) for s, n, a in zip(size, shape, low, strict=True)]
        wide = [n + 2 * r for n, r in zip(own, reach, strict=True)]
        place = [_flat(table, k) - a + r for k, a, r in zip(("zs", "ls", "os"), low, reach, strict=True)]
        flat = np.ravel_multi_index(place, wide)
        values = np.bincount(flat, _flat(table, "vs"), int(np.prod(wide))).reshape(wide)
        held = np.zeros(values.size, bool)
        held[flat] = True
        outside = [(max(0, r - a), max(0, a + n + r - m)) for r, a, n, m in zip(reach, low, own, shape, strict=True)]
        made, told = work(values, held.reshape(wide), tuple(k.as_py() for k in key[:3]), outside)
        at = np.nonzero(told)
        heads = [np.full(len(at[0]), k.as_py(), np.int32) for k in key[:3]]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip((*heads, *[p + a for p, a in zip(at, low, strict=True)], made[at]), schema.types, strict=True)], schema=schema)

    return block_packed(voxels, reach, size, shape).groupBy(*KEYS, "block").applyInArrow(run, "image_id int, t int, c int, z int, y int, x int, v double")


def correlate(values: np.ndarray, weights: list[float], axis: int) -> np.ndarray:
    """Weighted sums along an axis, shorter by the weights' reach at both ends; always added in the same order."""
    n = values.shape[axis] - len(weights) + 1
    out = 0.0
    for k, w in enumerate(weights):
        out = out + w * np.take(values, range(k, k + n), axis)
    return out


def spread(held: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """Whether any voxel within reach along an axis is there, shorter by the reach at both ends."""
    total = np.cumsum(np.insert(held.astype(np.int32), 0, 0, axis), axis)
    n = held.shape[axis] - 2 * reach
    return np.take(total, range(2 * reach + 1, 2 * reach + 1 + n), axis) > np.take(total, range(n), axis)


def shifted(values: np.ndarray, offset: tuple[int, int, int], reach: tuple[int, int, int]) -> np.ndarray:
    """The values at a place's neighbour, for the places of the block."""
    return values[tuple(slice(r + d, n - r + d) for d, r, n in zip(offset, reach, values.shape, strict=True))]
