"""Interpolation by blocks of the output: raw voxels travel packed, once, and arrays do the sums.

The outputs lie on planes ``k`` and lines ``l`` and each is a weighted sum of a few raw voxels of the same place along
the third axis.  A raw voxel feeds a small window of (k, l), so mostly one block of the output and at borders of blocks two
or four.  Tasks pack the voxels that they read into one row of arrays for each block, these rows are shuffled by block (the only
shuffle), and a block is worked out as a dense array.  Rows shuffled so count blocks and batches, not voxels, and a
block's size bounds the memory of a group whatever the volume's size.

What no raw voxel of the table reaches is left out, as in a sum over a join; equal places add up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.geometry import Acquisition
from ..sources.volume import KEYS

#: Outputs of a block along k, l and the third axis.
BLOCK = (32, 64, 256)
#: Voxels that a task packs at a time.
PACKED = 1 << 18
PACK_SCHEMA = "image_id int, t int, c int, block long, zs array<int>, ls array<int>, os array<int>, vs array<double>"

Grid = np.ndarray
Taps = tuple[Grid, list[tuple[Grid, Grid, Grid]]]


@dataclass(frozen=True)
class Kernel:
    """Where raw voxels go, and of which an output is made."""

    a: Acquisition
    size_k: int
    size_l: int

    def reach(self, z: np.ndarray, lateral: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Least and greatest k and l that a raw voxel may feed (some may not be fed)."""
        raise NotImplementedError

    def taps(self, k: Grid, l: Grid) -> Taps:  # noqa: E741
        """(whether there is an output, [(raw plane, raw line, weight), …])."""
        raise NotImplementedError


@dataclass(frozen=True)
class ShearKernel(Kernel):
    """Two planes and two lines around the place that a deskewed voxel comes from."""

    def reach(self, z, lateral):
        low, high = (z - 1) * self.a.rise, (z + 1) * self.a.rise
        shift = np.minimum(low / self.a.tan, high / self.a.tan), np.maximum(low / self.a.tan, high / self.a.tan)
        return low, high, lateral - 1 + shift[0], lateral + 1 + shift[1]

    def taps(self, k, l):  # noqa: E741
        a = self.a
        scan, place = k / a.rise, l - k / a.tan
        p, q = np.floor(scan), np.floor(place)
        fp, fq = scan - p, place - q
        valid = (p >= 0) & (p + 1 < a.nz) & (q >= 0) & (q + 1 < a.n_lateral)
        return valid, [(p + i, q + j, (fp if i else 1 - fp) * (fq if j else 1 - fq)) for i in (0, 1) for j in (0, 1)]


@dataclass(frozen=True)
class ObjectiveKernel(Kernel):
    """The raw planes before and after a place, each interpolated along its own lines; k counts from the near side."""

    def reach(self, z, lateral):
        a = self.a
        beyond = a.step * a.cos
        low, high = (lateral - 1 - beyond) * a.sin, (lateral + 1 + beyond) * a.sin
        return low, high, low / a.tan + (z - 1) * a.step, high / a.tan + (z + 1) * a.step

    def taps(self, k, l):  # noqa: E741
        a = self.a
        plane = l - k / a.tan
        p = np.floor(plane / a.step)
        after = plane - p * a.step
        before = a.step - after
        depth = k / a.sin
        at, to = depth + after * a.cos, depth - before * a.cos  # along the plane before and the plane after
        q, r = np.floor(at), np.floor(to)
        valid = (p >= 0) & (p + 1 < a.nz) & (q >= 0) & (r >= 0) & (q < a.n_lateral - 1) & (r < a.n_lateral - 1)
        weights = [(p + 1, r + 1, after * (to - r)), (p + 1, r, after * (1 - (to - r))), (p, q + 1, before * (at - q)), (p, q, before * (1 - (at - q)))]
        return valid, [(z, line, w / a.step) for z, line, w in weights]


@dataclass(frozen=True)
class ProjectionKernel(Kernel):
    """For the projection in the objective frame: k is a raw line, and l a pixel between two planes of that line."""

    def reach(self, z, lateral):
        a = self.a
        line = lateral * a.cos
        return lateral, lateral, line + (z - 1) * a.step, line + (z + 1) * a.step

    def taps(self, k, l):  # noqa: E741
        a = self.a
        place = (l - k * a.cos) / a.step
        p = np.floor(place)
        share = place - p
        first, last = np.floor((l - a.nz * a.step) / a.cos), np.ceil(l / a.cos) + 1
        valid = (k >= first) & (k < last) & (p >= 0) & (p < a.nz)
        inner = p + 1 < a.nz
        return valid, [(p, k, np.where(inner, 1 - share, 1.0)), (np.where(inner, p + 1, p), k, np.where(inner, share, 0.0))]


def kernel_of(a: Acquisition) -> Kernel:
    depth, lateral = a.output_shape[0], a.output_shape[1 if a.skew == "Y" else 2]
    return (ShearKernel if a.frame == "shear" else ObjectiveKernel)(a, depth, lateral)


@dataclass(frozen=True)
class Blocks:
    """The grid of blocks over the outputs; a block's number names its three places."""

    kernel: Kernel
    size: tuple[int, int, int] = BLOCK

    @property
    def counts(self) -> tuple[int, int, int]:
        shape = (self.kernel.size_k, self.kernel.size_l, self.kernel.a.n_other)
        return tuple(-(-n // s) for n, s in zip(shape, self.size, strict=True))  # type: ignore[return-value]

    def number(self, k, l, o):  # noqa: E741
        _, nl, no = self.counts
        return (k * nl + l) * no + o

    def ranges(self, number: int) -> tuple[tuple[int, int], tuple[int, int], tuple[int, int]]:
        """The outputs (from, to) of a block along each axis."""
        _, nl, no = self.counts
        places = (number // (nl * no), number // no % nl, number % no)
        shape = (self.kernel.size_k, self.kernel.size_l, self.kernel.a.n_other)
        return tuple((p * s, min(n, (p + 1) * s)) for p, s, n in zip(places, self.size, shape, strict=True))  # type: ignore[return-value]

    def meeting(self, k: tuple[int, int], l: tuple[int, int], o: tuple[int, int]) -> list[int]:  # noqa: E741
        """The blocks that hold outputs of given ranges."""
        spans = []
        for (low, high), s, n in zip((k, l, o), self.size, self.counts, strict=True):
            spans.append(range(max(0, low // s), min(n, -(-high // s))))
        return [self.number(i, j, m) for i in spans[0] for j in spans[1] for m in spans[2]]


Spans = list[tuple[np.ndarray, np.ndarray]]
Number = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def pack(columns: list[np.ndarray], spans: Spans, number: Number, wanted: np.ndarray | None = None) -> pa.RecordBatch | None:
    """(image, t, c, three places, value) of voxels as a row of arrays for each block that they go to.

    ``spans`` holds the first and last block along each axis for each voxel (none if the last is before the first).
    """
    image, t, c, *place, v = columns
    found, numbers = [], []
    most = [int((last - first).max(initial=-1)) + 1 for first, last in spans]
    for steps in product(*map(range, most)):
        at = [first + d for (first, _), d in zip(spans, steps, strict=True)]
        chosen = np.flatnonzero(np.logical_and.reduce([k <= last for k, (_, last) in zip(at, spans, strict=True)]))
        code = number(*[k[chosen] for k in at])
        if wanted is not None:
            keep = np.isin(code, wanted)
            chosen, code = chosen[keep], code[keep]
        found.append(chosen)
        numbers.append(code)
    if not found or not (rows := np.concatenate(found)).size:
        return None
    code = np.concatenate(numbers)
    order = np.lexsort((code, c[rows], t[rows], image[rows]))
    rows, code = rows[order], code[order]
    marks = [image[rows], t[rows], c[rows], code]
    starts = np.flatnonzero(np.concatenate([[True], np.any([m[1:] != m[:-1] for m in marks], axis=0)]))
    offsets = pa.array(np.append(starts, len(rows)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x[rows])) for x in (*[p.astype(np.int32) for p in place], v)]
    heads = [pa.array(m[starts].astype(np.int32)) for m in marks[:3]]
    return pa.RecordBatch.from_arrays([*heads, pa.array(code[starts]), *lists], names=[x.split()[0] for x in PACK_SCHEMA.split(", ")])


def pack_batches(voxels: DataFrame, names: list[str], spans: Callable[[list[np.ndarray]], Spans], number: Number, wanted: np.ndarray | None = None) -> DataFrame:
    """The columns ``names`` of voxels (keys, three places, value) packed by the tasks that read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0

        def made() -> pa.RecordBatch | None:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            return pack(columns, spans(columns), number, wanted)

        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(n).to_numpy(zero_copy_only=False) for n in names])
                rows += batch.num_rows
            if rows >= PACKED:
                if (one := made()) is not None:
                    yield one
                held, rows = [], 0
        if held and (one := made()) is not None:
            yield one

    return voxels.select(*names).mapInArrow(run, PACK_SCHEMA)


def packed(voxels: DataFrame, blocks: Blocks, wanted: np.ndarray | None = None) -> DataFrame:
    """Rows of arrays: the voxels that a task read, by the block that they feed; only of ``wanted`` blocks if given."""
    kernel, a = blocks.kernel, blocks.kernel.a

    def spans(columns: list[np.ndarray]) -> Spans:
        _, _, _, z, lateral, other, _ = columns
        low_k, high_k, low_l, high_l = kernel.reach(z.astype(float), lateral.astype(float))
        out = []
        for low, high, size, step in ((low_k, high_k, kernel.size_k, blocks.size[0]), (low_l, high_l, kernel.size_l, blocks.size[1])):
            first = np.maximum(np.floor(low).astype(np.int64) - 1, 0)
            last = np.minimum(np.ceil(high).astype(np.int64) + 1, size - 1)
            out.append((first // step, np.where(first <= last, last // step, first // step - 1)))
        own = other.astype(np.int64) // blocks.size[2]
        return [*out, (own, np.where((other >= 0) & (other < a.n_other), own, own - 1))]

    return pack_batches(voxels, [*KEYS, "z", a.lateral, a.other, "v"], spans, blocks.number, wanted)


def _flat(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in chunks]) if chunks else np.zeros(0)


Finish = Callable[[tuple, tuple, np.ndarray, np.ndarray], Iterator[dict[str, np.ndarray | pa.Array]]]
Ranges = tuple[tuple[int, int], tuple[int, int], tuple[int, int]]
#: Blocks whose weights a worker keeps; slices of one size have the same.
KEPT_TAPS = 64


def interpolate(voxels: DataFrame, blocks: Blocks, schema: str, finish: Finish, wanted: np.ndarray | None = None, ranges: Callable[[int], Ranges] | None = None) -> DataFrame:
    """The rows that ``finish`` (number of the block, first output of each axis, values, whether a voxel reaches them) makes of each block.

    ``ranges`` may give the part of a block that is asked for.
    """
    kernel, ranges = blocks.kernel, ranges or blocks.ranges
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"int": pa.int32(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
    fields = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, schema.split(", "), strict=True)])
    known: dict[int, tuple] = {}

    def weights(number: int) -> tuple:
        if number not in known:
            if len(known) >= KEPT_TAPS:
                known.clear()
            span = ranges(number)
            k, l = np.meshgrid(np.arange(*span[0]), np.arange(*span[1]), indexing="ij")  # noqa: E741
            valid, taps = kernel.taps(k, l)
            known[number] = span, valid, [(z.astype(np.int64), line.astype(np.int64), np.where(valid, w, 0.0)) for z, line, w in taps] if valid.any() else []
        return known[number]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        number = key[3].as_py()
        ((k0, _), (l0, _), (o0, o1)), valid, taps = weights(number)
        parts = []
        if taps:
            z0, z1 = min(int(z[valid].min()) for z, _, _ in taps), max(int(z[valid].max()) for z, _, _ in taps)
            q0, q1 = min(int(q[valid].min()) for _, q, _ in taps), max(int(q[valid].max()) for _, q, _ in taps)
            shape = (z1 - z0 + 1, q1 - q0 + 1, o1 - o0)
            z, lateral, other, v = (_flat(table, n) for n in ("zs", "ls", "os", "vs"))
            needed = (z >= z0) & (z <= z1) & (lateral >= q0) & (lateral <= q1) & (other >= o0) & (other < o1)
            place = np.ravel_multi_index((z[needed] - z0, lateral[needed] - q0, other[needed] - o0), shape)
            raw = np.bincount(place, v[needed], int(np.prod(shape))).reshape(shape)
            held = np.zeros(raw.size, bool)
            held[place] = True
            held = held.reshape(shape)
            total, reached = np.zeros((*valid.shape, o1 - o0)), np.zeros((*valid.shape, o1 - o0), bool)
            for z, line, w in taps:
                at = np.where(valid, z - z0, 0), np.where(valid, line - q0, 0)
                total += w[..., None] * raw[at]
                reached |= held[at]
            parts = list(finish((number,), (k0, l0, o0), total, reached & valid[..., None]))
        heads = {n: key[i].as_py() for i, n in enumerate(KEYS)}
        made = []
        for part in parts:
            rows = len(part["v"])
            made.append(pa.Table.from_arrays([part[n] if isinstance(part.get(n), pa.Array) else pa.array(np.full(rows, heads[n]) if n in heads else part[n], t) for n, t in zip(names, fields.types, strict=True)], schema=fields))
        return pa.concat_tables(made) if made else fields.empty_table()

    return packed(voxels, blocks, wanted).groupBy(*KEYS, "block").applyInArrow(run, schema)
