"""Opening an image of any kind that is read here: its voxels, and what its metadata tells.

Files are read by the data source of ``datasource``, so that ranges in a query reach them; tables of voxels are Parquet.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import datasource, naming, volume
from .layouts import CziLayout, open_layout, scenes_of


@dataclass(frozen=True)
class Opened:
    voxels: DataFrame
    sizes: tuple[int, int, int, int, int]  # t, c, z, y, x
    dtype: str
    pixel_sizes: tuple[float | None, float | None, float | None] = (None, None, None)
    channels: tuple[str, ...] = ()
    planes: DataFrame | None = None  # (image_id, t, c, z) that the file holds, where it may lack some
    one_image: bool = True  # False for a table, which may hold several


def open_image(spark: SparkSession, path: str, scene: int = 0, image_id: int = 0, sizes: tuple[int, int, int, int, int] | None = None) -> Opened:
    """The image of a CZI, TIFF, OME-Zarr or BDV file or a Parquet table of voxels, told by its name.

    A table is scanned for its sizes, unless they are given.
    """
    layout = open_layout(path, scene)
    if layout is None:
        voxels = volume.read_voxels(spark, path)
        if sizes is None:
            ends = voxels.agg(*[(F.max(k) + 1).alias(k) for k in ("t", "c", "z", "y", "x")]).first()
            sizes = tuple(n or 0 for n in ends)
        return Opened(voxels, sizes, "float64", one_image=False)
    planes = None
    if isinstance(layout, CziLayout):
        planes = spark.createDataFrame([(image_id, *p.start[:3]) for p in layout.pieces], "image_id int, t int, c int, z int")
    return Opened(datasource.read_image(spark, path, scene, image_id), layout.sizes, layout.dtype, layout.pixel_sizes, layout.channels, planes)


def open_scenes(spark: SparkSession, path: str) -> Opened:
    """All scenes of a file as images of one table, numbered in the order of their scene numbers; they must be of one size and type."""
    opened = [open_image(spark, path, k, image_id=k) for k in range(len(scenes_of(path)))]
    first = opened[0]
    if odd := [k for k, o in enumerate(opened) if (o.sizes, o.dtype, o.pixel_sizes) != (first.sizes, first.dtype, first.pixel_sizes)]:
        raise ValueError(f"{path}: scenes {odd} differ from the first in size, type or voxels; open them apart")
    together = lambda frames: reduce(DataFrame.unionByName, frames)
    planes = together([o.planes for o in opened]) if first.planes is not None else None
    return Opened(together([o.voxels for o in opened]), first.sizes, first.dtype, first.pixel_sizes, first.channels, planes, one_image=len(opened) == 1)


@dataclass(frozen=True)
class Layer:
    """What a viewer shows as one layer: a scene, or a channel of it."""

    name: str
    voxels: DataFrame
    scale: tuple[float, float, float]
    channel: int | None = None


def layers(spark: SparkSession, path: str) -> list[Layer]:
    """The layers of a file: each channel of each scene where channels have names of their own, else each scene.

    Names are those of the channels, with the scene before them where there are several; a scene without named channels has the
    file's name.  Voxel sizes that are not known count as 1.
    """
    scenes, out = scenes_of(path), []
    for k, number in enumerate(scenes):
        opened = open_image(spark, path, k, image_id=k)
        scale = tuple(s or 1.0 for s in opened.pixel_sizes)
        named = len(opened.channels) > 1 and not any(re.fullmatch(r"(Channel:\d+:\d+)?", n) for n in opened.channels)
        if named:
            for c, name in enumerate(opened.channels):
                out.append(Layer(f"{number} - {name}" if len(scenes) > 1 else name, opened.voxels.filter(F.col("c") == c), scale, c))
        else:
            stem = naming.stem(path)
            stem = stem[:-4] if stem.lower().endswith(".czi") else stem
            out.append(Layer(f"{stem} - {number}" if len(scenes) > 1 else stem, opened.voxels, scale))
    return out
