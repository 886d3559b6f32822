"""Deskewing: a weighted sum of four raw voxels in the (scan, lateral) plane for each output voxel.

Seen from a raw voxel, the outputs that it is one of the four for lie in a small window whose bounds follow from its place.  Raw
voxels so go, packed in arrays, to the blocks of the output that they feed, and a block's sums are made as arrays
(see ``blocks``).  There is no join of a grid with the pixels.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Acquisition, Box, safe_raw_box
from ..sources.volume import block
from .blocks import Blocks, interpolate, kernel_of


def _whole(column: Column) -> Column:
    return column.cast("long")


def _window(low: Column, high: Column, size: int) -> Column:
    """Whole numbers from just below ``low`` to just above ``high``, within an axis; empty where there are none."""
    first = F.greatest(_whole(F.floor(low)) - 1, F.lit(0).cast("long"))
    last = F.least(_whole(F.ceil(high)) + 1, F.lit(size - 1).cast("long"))
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def shear_taps(voxels: DataFrame, a: Acquisition) -> DataFrame:
    """zc, lc, w for each voxel and output place it feeds in the shear frame."""
    depth, lateral = a.output_shape[0], a.output_shape[1 if a.skew == "Y" else 2]
    z, lat = F.col("z"), F.col(a.lateral)
    rows = voxels.withColumn("zc", F.explode(_window((z - 1) * a.rise, (z + 1) * a.rise, depth)))
    scan = F.col("zc") / F.lit(a.rise)
    rows = rows.withColumn("p", _whole(F.floor(scan))).withColumn("fp", scan - F.floor(scan)).filter((F.col("p") >= 0) & (F.col("p") + 1 < a.nz) & ((F.col("p") == z) | (F.col("p") + 1 == z)))
    shift = F.col("zc") / F.lit(a.tan)
    rows = rows.withColumn("lc", F.explode(_window(lat - 1 + shift, lat + 1 + shift, lateral)))
    raw = F.col("lc") - shift
    rows = rows.withColumn("q", _whole(F.floor(raw))).withColumn("fl", raw - F.floor(raw)).filter((F.col("q") >= 0) & (F.col("q") + 1 < a.n_lateral) & ((F.col("q") == lat) | (F.col("q") + 1 == lat)))
    weight = F.when(F.col("p") == z, 1 - F.col("fp")).otherwise(F.col("fp")) * F.when(F.col("q") == lat, 1 - F.col("fl")).otherwise(F.col("fl"))
    return rows.withColumn("w", weight)


def axes_of(a: Acquisition, k, l, o) -> dict:  # noqa: E741
    """z, y and x of places along an output's plane, line and third axis; planes of the objective frame count from the far side."""
    return {"z": k if a.frame == "shear" else a.output_shape[0] - 1 - k, a.lateral: l, a.other: o}


def kernel_ranges(a: Acquisition, box: Box) -> tuple[tuple[int, int], tuple[int, int], tuple[int, int]]:
    """A box of the output as ranges of the kernel's plane, line and third axis."""
    depth = a.output_shape[0]
    k = box.z if a.frame == "shear" else (depth - box.z[1], depth - box.z[0])
    return k, getattr(box, a.lateral), getattr(box, a.other)


def deskew(voxels: DataFrame, a: Acquisition, box: Box | None = None, size: tuple[int, int, int] | None = None) -> DataFrame:
    """Deskewed voxels; those that no raw voxel reaches are left out.

    With a box of the output only its voxels are made, in the volume's own
    coordinates, and the raw block behind it becomes a filter on the scan.
    """
    blocks = Blocks(kernel_of(a), size) if size else Blocks(kernel_of(a))
    wanted = None
    if box is not None:
        voxels = block(voxels, safe_raw_box(a, box))
        wanted = np.array(sorted(blocks.meeting(*kernel_ranges(a, box))), np.int64)

    def finish(_, first, total, reached):
        place = np.nonzero(reached)
        at = axes_of(a, *[p + f for p, f in zip(place, first, strict=True)])
        keep = slice(None)
        if box is not None:
            keep = np.logical_and.reduce([(at[n] >= getattr(box, n)[0]) & (at[n] < getattr(box, n)[1]) for n in "zyx"])
        yield {**{n: at[n][keep] for n in "zyx"}, "v": total[place][keep]}

    return interpolate(voxels, blocks, "image_id int, t int, c int, z int, y int, x int, v double", finish, wanted)
