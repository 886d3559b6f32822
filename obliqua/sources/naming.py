"""File names and their parts."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSIONS = {"h5": "h5", "omezarr": "ome.zarr", "tiff": "ome.tif", "parquet": "parquet", "csv": "csv"}
IMAGE_ENDINGS = (".ome.tif", ".ome.tiff", ".ome.zarr", ".tif", ".tiff", ".zarr", ".h5", ".xml", ".parquet")


def suffix(prefix: str | None = None, roi: int | None = None, channel: int | None = None, time: int | None = None) -> str:
    parts = [prefix, None if roi is None else f"ROI_{roi}", None if channel is None else f"C{channel}", None if time is None else f"T{time}"]
    return "_".join(p for p in parts if p is not None)


def suffix_column(prefix: Column, roi: Column, channel: Column, time: Column) -> Column:
    """The same as a column; null parts are skipped."""
    label = lambda mark, c: F.concat(F.lit(mark), c.cast("string"))
    return F.concat_ws("_", prefix, label("ROI_", roi), label("C", channel), label("T", time))


def free_path(folder: str, name: str, extension: str) -> Path:
    """A path that does not exist yet: ``_1``, then ``_1_2`` and so on are put behind the name."""
    path, k = Path(folder) / f"{name}.{extension}", 1
    while path.exists():
        name = f"{name}_{k}"
        path, k = Path(folder) / f"{name}.{extension}", k + 1
    return path


def stem(path: str) -> str:
    """A file's name without an image ending; other dots stay."""
    name = Path(path).name
    for ending in sorted(IMAGE_ENDINGS, key=len, reverse=True):
        if name.lower().endswith(ending):
            return name[: -len(ending)]
    return name
