"""Regions of interest: reading, units, selection, checks.

A region list is short (people draw it), so files are parsed on the driver and
plans take it as a DataFrame of one row a region.
"""

from __future__ import annotations

import csv
import struct
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROI_SCHEMA = "roi_index int, top double, left double, bottom double, right double"


def shapes_boxes(vertices: DataFrame) -> DataFrame:
    """Bounding box of each shape of a vertex table (row_id, index, a0, a1), numbered in order of appearance."""
    boxes = vertices.groupBy("index").agg(F.min("row_id").alias("first"), F.min("a0").alias("top"), F.min("a1").alias("left"), F.max("a0").alias("bottom"), F.max("a1").alias("right"))
    # distributed rank: how many shapes begin before this one; shapes are few
    earlier = boxes.select(F.col("first").alias("f"))
    ranked = boxes.join(earlier, F.col("f") < F.col("first"), "left").groupBy("index", "first", "top", "left", "bottom", "right").agg(F.count("f").cast("int").alias("roi_index"))
    return ranked.select("roi_index", "top", "left", "bottom", "right")


def read_shapes_csv(path: str) -> list[tuple[float, float, float, float]]:
    """(top, left, bottom, right) of each shape in a vertex CSV: its last two axis columns count."""
    with open(path, newline="") as file:
        rows = list(csv.DictReader(file))
    if not rows:
        raise ValueError(f"{path} has no shapes")
    axes = sorted((c for c in rows[0] if c.startswith("axis-")), key=lambda c: int(c[5:]))[-2:]
    if "index" not in rows[0] or len(axes) < 2:
        raise ValueError(f"{path} needs a column 'index' and two columns 'axis-*'")
    shapes: dict[str, list[tuple[float, float]]] = {}
    for row in rows:
        shapes.setdefault(row["index"], []).append((float(row[axes[0]]), float(row[axes[1]])))
    return [(min(y for y, _ in v), min(x for _, x in v), max(y for y, _ in v), max(x for _, x in v)) for v in shapes.values()]


def _imagej(data: bytes) -> tuple[float, float, float, float] | None:
    """The bounding box in the header of an ImageJ region; None for kinds without one."""
    if data[:4] != b"Iout":
        raise ValueError("not an ImageJ region")
    # Fixed values of the format: kinds with a box (polygon, rectangle, oval, freehand, traced)
    if data[6] not in (0, 1, 2, 7, 8):
        return None
    top, left, bottom, right = struct.unpack(">4h", data[8:16])
    return float(top), float(left), float(bottom), float(right)


def read_imagej(path: str) -> list[tuple[float, float, float, float]]:
    kind = Path(path).suffix.lower()
    if kind == ".roi":
        parts = [Path(path).read_bytes()]
    elif kind == ".zip":
        with zipfile.ZipFile(path) as archive:
            parts = [archive.read(n) for n in archive.namelist() if n.lower().endswith(".roi")]
    else:
        raise ValueError(f"{path} is no .roi or .zip file")
    return [box for box in map(_imagej, parts) if box is not None]


def read_regions(path: str) -> list[tuple[float, float, float, float]]:
    return read_shapes_csv(path) if path.lower().endswith(".csv") else read_imagej(path)


def units_of(paths: list[str], units: str = "Auto") -> str:
    """Microns or Pixels: as told, else CSV files are in microns and others in pixels; a mixture is refused."""
    if units not in ("Auto", "Microns", "Pixels"):
        raise ValueError(f"unknown units {units!r}")
    if units != "Auto":
        return units
    implied = {"Microns" if p.lower().endswith(".csv") else "Pixels" for p in paths}
    if len(implied) > 1:
        raise ValueError("regions in microns and in pixels cannot be mixed; name the units")
    return implied.pop() if implied else "Pixels"


def units_column(path: Column) -> Column:
    return F.when(F.lower(path).like("%.csv"), "Microns").otherwise("Pixels")


def in_pixels(rois: DataFrame, dy: float) -> DataFrame:
    """Micron regions in pixels: both axes by the y voxel."""
    return rois.select("roi_index", *[(F.col(c) / F.lit(dy)).alias(c) for c in ("top", "left", "bottom", "right")])


def in_microns(rois: DataFrame, dy: float) -> DataFrame:
    return rois.select("roi_index", *[(F.col(c) * F.lit(dy)).alias(c) for c in ("top", "left", "bottom", "right")])


def subset(rois: DataFrame, wanted: str | list[int] | None, count: int) -> DataFrame:
    """The regions named by their numbers, or by text like "2,5,7"; numbers that do not exist are refused."""
    if wanted is None:
        return rois
    numbers = [int(x) for x in wanted.split(",")] if isinstance(wanted, str) else list(wanted)
    if bad := [n for n in numbers if not 0 <= n < count]:
        raise ValueError(f"no regions {bad} among {count}")
    return rois.filter(F.col("roi_index").isin(numbers))


def outside(rois: DataFrame, height: int, width: int) -> DataFrame:
    """The regions that reach beyond the deskewed image; a warning, not an error."""
    return rois.filter((F.col("bottom") > height) | (F.col("right") > width) | (F.col("top") < 0) | (F.col("left") < 0)).select("roi_index")


def pixel_boxes(rois: DataFrame) -> DataFrame:
    """Whole-number bounds: corners rounded half to even, not below 0."""
    low = lambda c: F.greatest(F.rint(c), F.lit(0.0)).cast("int")
    return rois.select("roi_index", low("top").alias("y0"), low("bottom").alias("y1"), low("left").alias("x0"), low("right").alias("x1"))


def iteration(rois: DataFrame, slices: DataFrame) -> DataFrame:
    """Every (region, time, channel) with its relative numbers, to be ordered by region, time, channel.

    ``slices`` holds the (t, c) to process: one row a slice, so both sides are small.
    """
    from pyspark.sql import Window

    numbered = slices.select("t", "c", (F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("t")) - 1).alias("time_index"), (F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("c")) - 1).alias("channel_index"))
    return rois.select("roi_index").crossJoin(numbered)


def as_frame(spark: SparkSession, boxes: list[tuple[float, float, float, float]]) -> DataFrame:
    return spark.createDataFrame([(i, *map(float, b)) for i, b in enumerate(boxes)], ROI_SCHEMA)
