"""Cropping while deskewing: each region reads only the raw block behind it.

Voxels go only to those blocks of the output that hold a part of some region, and a block that is worked
out is cut for each of its regions; overlapping regions so share the scan and the sums, and no voxel is joined with a
region.  Crops lie on the whole volume's output grid, so a crop equals
that part of the whole deskewed volume.  ``align="subblock"`` instead deskews
each block on its own grid, as single-block tools do.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Acquisition, Box, crop_plan, safe_raw_box
from ..sources.volume import KEYS, block
from .blocks import Blocks, Ranges, interpolate, kernel_of
from .deskew import axes_of, deskew, kernel_ranges

PLACE_AND_VALUE = ["z", "y", "x", "v"]
PACKED_CROPS = "image_id int, t int, c int, roi_index int, z array<int>, y array<int>, x array<int>, v array<double>"


def packed_crops(voxels: DataFrame, a: Acquisition, boxes: dict[int, Box], places: int | None = None) -> DataFrame:
    """(keys, roi_index, z, y, x, v) with arrays: for each region a row of every block of the output that holds voxels of it.

    With ``places`` values are rounded to so many, and only those above 0 are kept.
    """
    # the union of all raw blocks bounds the scan with literals
    raw = [safe_raw_box(a, b) for b in boxes.values()]
    held = block(voxels, Box(*[(min(getattr(r, k)[0] for r in raw), max(getattr(r, k)[1] for r in raw)) for k in "zyx"]))
    blocks = Blocks(kernel_of(a))
    met: dict[int, list[tuple[int, Ranges]]] = {}
    for index, box in boxes.items():
        spans = kernel_ranges(a, box)
        for number in blocks.meeting(*spans):
            met.setdefault(number, []).append((index, spans))

    def ranges(number: int) -> Ranges:
        """The part of a block that its regions take up together."""
        spans = [spans for _, spans in met[number]]
        return tuple((max(low, min(s[axis][0] for s in spans)), min(high, max(s[axis][1] for s in spans))) for axis, (low, high) in enumerate(blocks.ranges(number)))  # type: ignore[return-value]

    def finish(number, first, total, reached):
        if places is not None:
            total = np.round(total, places)
            reached = reached & (total > 0)
        found, parts = [], []
        for index, spans in met[number[0]]:
            cut = tuple(slice(max(0, low - f), max(0, high - f)) for (low, high), f in zip(spans, first, strict=True))
            place = np.nonzero(reached[cut])
            if len(place[0]):
                at = axes_of(a, *[p + c.start + f for p, c, f in zip(place, cut, first, strict=True)])
                found.append(index)
                parts.append([*[at[k] - getattr(boxes[index], k)[0] for k in "zyx"], total[cut][place]])
        if found:
            offsets = pa.array(np.cumsum([0, *[len(p[3]) for p in parts]]), pa.int32())
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(c, pa.float64() if n == "v" else pa.int32())) for n, c in zip(PLACE_AND_VALUE, columns, strict=True)]
            yield {"roi_index": np.array(found), **dict(zip(PLACE_AND_VALUE, lists, strict=True))}

    return interpolate(held, blocks, PACKED_CROPS, finish, np.array(sorted(met), np.int64), ranges)


def crop(voxels: DataFrame, a: Acquisition, boxes: dict[int, Box], dense: bool = False, align: str = "global") -> DataFrame:
    """(keys, roi_index, z, y, x, v) in each region's own coordinates; zeros are left out unless ``dense``."""
    if not boxes:
        raise ValueError("no regions to crop")
    if align == "subblock":
        out = None
        for index, box in boxes.items():
            one = _subblock(voxels, a, box).withColumn("roi_index", F.lit(index))
            out = one if out is None else out.unionByName(one)
    elif align == "global":
        out = packed_crops(voxels, a, boxes).select(*KEYS, "roi_index", F.inline(F.arrays_zip(*PLACE_AND_VALUE)))
    else:
        raise ValueError(f"unknown alignment {align!r}")
    out = out.select(*KEYS, "roi_index", "z", "y", "x", "v")
    return fill(out, boxes, voxels.select(*KEYS).distinct()) if dense else out


def _subblock(voxels: DataFrame, a: Acquisition, box: Box) -> DataFrame:
    """One region, its raw block deskewed alone and trimmed to the region."""
    plan = crop_plan(a, box)
    own = replace(a, nz=max(1, plan.raw.shape[0]), ny=max(1, plan.raw.shape[1]), nx=max(1, plan.raw.shape[2]))
    raw = block(voxels, plan.raw)
    moved = raw.select(*KEYS, *[(F.col(k) - getattr(plan.raw, k)[0]).cast("int").alias(k) for k in "zyx"], "v")
    made = deskew(moved, own)
    if a.frame == "shear":
        start = a.forward(plan.raw.z[0], plan.raw.y[0], plan.raw.x[0])
        shift = [round(getattr(box, k)[0] - s) for k, s in zip("zyx", start, strict=True)]
        sizes = dict(zip("zyx", plan.shape, strict=True))
    else:
        shift = [plan.excess if k == a.lateral else 0 for k in "zyx"]
        sizes = {a.lateral: plan.shape[1 if a.skew == "Y" else 2]}
    made = made.select(*KEYS, *[(F.col(k) - s).cast("int").alias(k) for k, s in zip("zyx", shift, strict=True)], "v")
    for k in "zyx":
        made = made.filter(F.col(k) >= 0)
        if k in sizes:
            made = made.filter(F.col(k) < sizes[k])
    return made


def fill(cropped: DataFrame, boxes: dict[int, Box], slices: DataFrame) -> DataFrame:
    """The regions with zeros wherever nothing was made; slices and regions are short lists."""
    rows = [(index, *box.shape) for index, box in boxes.items()]
    grid = cropped.sparkSession.createDataFrame(rows, "roi_index int, nz int, ny int, nx int").crossJoin(slices)
    for k in "zyx":
        grid = grid.withColumn(k, F.explode(F.sequence(F.lit(0), F.col(f"n{k}") - 1)))
    columns = [*KEYS, "roi_index", "z", "y", "x"]
    return grid.select(*columns).join(cropped, columns, "left").select(*columns, F.coalesce("v", F.lit(0.0)).alias("v"))
