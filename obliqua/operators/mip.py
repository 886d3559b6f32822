"""Maximum-intensity projections straight from raw planes.

With "nearest" every raw voxel expands to the pixels that it can win, and a maximum that is combined before its
shuffle finishes.  With "linear" the sums are made by blocks of arrays (see ``blocks``), each block gives the maxima along its own depth, and
nothing like the deskewed volume is shuffled.  The maximum starts from 0,
so that negative values never show.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Acquisition
from ..sources.volume import KEYS
from .blocks import Blocks, Kernel, ProjectionKernel, interpolate, kernel_of
from .deskew import _window, shear_taps

INTERPOLATIONS = ("nearest", "linear")


PIXELS = "image_id int, t int, c int, lc int, other int, v double"


def _objective_nearest(voxels: DataFrame, a: Acquisition, lateral: int) -> DataFrame:
    z, lat = F.col("z"), F.col(a.lateral)
    line = lat * a.cos
    rows = voxels.withColumn("lc", F.explode(_window(line + (z - 1.5) * a.step, line + (z + 1.5) * a.step, lateral)))
    # a pixel looks only at the lateral lines that its bounded range holds
    first, last = F.floor((F.col("lc") - a.nz * a.step) / a.cos), F.ceil(F.col("lc") / a.cos) + 1
    rows = rows.filter((lat >= first) & (lat < last)).withColumn("half", (F.col("lc") - line) / a.step + 0.5)
    nearest = F.when(F.col("half") >= 0, F.floor("half")).otherwise(F.ceil("half"))  # toward zero
    return rows.filter(nearest == z).select(*KEYS, "lc", F.col(a.other).alias("other"), "v")


def _shear_nearest(voxels: DataFrame, a: Acquisition) -> DataFrame:
    z, lat = F.col("z"), F.col(a.lateral)
    rows = shear_taps(voxels, a)
    near = (F.col("p") + (F.col("fp") >= 0.5).cast("int") == z) & (F.col("q") + (F.col("fl") >= 0.5).cast("int") == lat)
    return rows.filter(near).select(*KEYS, "lc", F.col(a.other).alias("other"), "v")


def _linear(voxels: DataFrame, kernel: Kernel) -> DataFrame:
    """The greatest value above 0 of each pixel in each block."""

    def finish(_, first, total, reached):
        top = np.where(reached, total, 0.0).max(0)
        line, other = np.nonzero(top > 0)
        yield {"lc": line + first[1], "other": other + first[2], "v": top[line, other]}

    return interpolate(voxels, Blocks(kernel), PIXELS, finish)


def project(voxels: DataFrame, a: Acquisition, interpolation: str = "nearest", shape: tuple[int, int] | None = None, truncate: bool = False) -> DataFrame:
    """(keys, y, x, v): the projection along the deskewed depth; pixels never above 0 are left out.

    ``shape`` (y, x) fixes the grid, as that of the deskewed volume does; ``truncate`` gives
    whole numbers as integer pixel types would.
    """
    if interpolation not in INTERPOLATIONS:
        raise ValueError(f"unknown interpolation {interpolation!r}; one of {INTERPOLATIONS}")
    rows, columns = shape or a.mip_shape()
    lateral, other = (rows, columns) if a.skew == "Y" else (columns, rows)
    if interpolation == "linear":
        made = _linear(voxels, ProjectionKernel(a, a.n_lateral, lateral) if a.frame == "objective" else kernel_of(a))
    else:
        made = _objective_nearest(voxels, a, lateral) if a.frame == "objective" else _shear_nearest(voxels, a)
    made = made.filter((F.col("lc") < lateral) & (F.col("other") < other) & (F.col("v") > 0))
    value = F.max("v")
    out = made.groupBy(*KEYS, F.col("lc").cast("int").alias(a.lateral), F.col("other").alias(a.other)).agg((F.floor(value).cast("double") if truncate else value).alias("v"))
    return out.select(*KEYS, "y", "x", "v")


def projection_of(deskewed: DataFrame) -> DataFrame:
    """The same from a deskewed volume."""
    return deskewed.filter("v > 0").groupBy(*KEYS, "y", "x").agg(F.max("v").alias("v"))


def best_plane(voxels: DataFrame) -> DataFrame:
    """The plane with the largest sum of each slice, the lower one of equals."""
    sums = voxels.groupBy(*KEYS, "z").agg(F.sum("v").alias("total"))
    return sums.groupBy(*KEYS).agg(F.max_by("z", F.struct("total", -F.col("z"))).alias("z"), F.max("total").alias("total"))


def first_images(slices: DataFrame) -> DataFrame:
    """The first (t, c) of each region."""
    first = slices.groupBy("roi_index").agg(F.min(F.struct("t", "c")).alias("first"))
    return first.select("roi_index", "first.t", "first.c")


