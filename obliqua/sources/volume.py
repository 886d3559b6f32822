"""Volumes as DataFrames: voxel, line and block layouts, and selections on them.

``voxels(image_id, t, c, z, y, x, v)`` leaves out zeros; ``rows`` keeps a whole
x-line in one array; ``blocks`` holds bytes for array code.  Written sorted by (t, c, z),
row-group statistics let Parquet skip what a selection does not need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import Box

KEYS = ["image_id", "t", "c"]
COLUMNS = [*KEYS, "z", "y", "x", "v"]


def normalise(df: DataFrame) -> DataFrame:
    """Any table with z, y, x, v as voxels: missing keys are 0, integers ints, values doubles.

    Tables with fewer axes are refused, as their order cannot be told.
    """
    missing = {"z", "y", "x", "v"} - set(df.columns)
    if missing:
        raise ValueError(f"a volume needs columns {sorted(missing)}")
    return df.select(*[(F.col(k) if k in df.columns else F.lit(0)).cast("int").alias(k) for k in KEYS], *[F.col(k).cast("int").alias(k) for k in "zyx"], F.col("v").cast("double").alias("v"))


def dimension_orders(axes: int) -> list[str]:
    """The orders that an array of so many axes may have."""
    orders = {3: ["ZYX"], 4: ["TZYX", "CZYX"], 5: ["TCZYX", "CTZYX"]}
    if axes not in orders:
        raise ValueError("volumes have 3, 4 or 5 axes")
    return orders[axes]


def read_voxels(spark: SparkSession, path: str) -> DataFrame:
    return normalise(spark.read.parquet(path))


def to_rows(voxels: DataFrame, nx: int) -> DataFrame:
    """One dense x-line in each row."""
    pairs = voxels.groupBy(*KEYS, "z", "y").agg(F.map_from_entries(F.collect_list(F.struct("x", "v"))).alias("m"))
    line = F.transform(F.sequence(F.lit(0), F.lit(nx - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)).cast("float"))
    return pairs.select(*KEYS, "z", "y", line.alias("row"))


def from_rows(rows: DataFrame) -> DataFrame:
    """Voxels of lines, zeros left out."""
    return rows.select(*KEYS, "z", "y", F.posexplode("row").alias("x", "v")).filter("v <> 0").withColumn("v", F.col("v").cast("double"))


def write_voxels(voxels: DataFrame, path: str) -> None:
    """Parquet partitioned by time and channel and sorted by plane, so that ranges prune."""
    voxels.repartition("t", "c", "z").sortWithinPartitions("t", "c", "z", "y", "x").write.partitionBy("t", "c").parquet(path)


def span(value: tuple[int, int] | range | None, size: int) -> range:
    """A half-open range of indexes: a missing or zero bound takes the default; outside the axis it is refused."""
    if isinstance(value, range):
        start, stop = value.start, value.stop
    else:
        start, stop = value if value is not None else (None, None)
    out = range(start or 0, stop or size)
    if out.start < 0 or out.stop > size:
        raise ValueError(f"range {out.start} to {out.stop} is outside 0 to {size}")
    return out


def between(column: str, span: tuple[int, int] | range) -> Column:
    start, stop = (span.start, span.stop) if isinstance(span, range) else span
    return (F.col(column) >= start) & (F.col(column) < stop)


def select(voxels: DataFrame, times: range | None = None, channels: range | None = None) -> DataFrame:
    """Times and channels, as filters that reach the scan."""
    for column, wanted in (("t", times), ("c", channels)):
        if wanted is not None:
            voxels = voxels.filter(between(column, wanted))
    return voxels


def block(voxels: DataFrame, box: Box) -> DataFrame:
    """The voxels of a raw block, as literal ranges that reach the scan."""
    return voxels.filter(between("z", box.z) & between("y", box.y) & between("x", box.x))


def one_slice(voxels: DataFrame, t: int, c: int, size_t: int, size_c: int) -> DataFrame:
    if not (0 <= t < size_t and 0 <= c < size_c):
        raise IndexError(f"no slice t={t}, c={c} in {size_t} x {size_c}")
    return voxels.filter((F.col("t") == t) & (F.col("c") == c))


def flip_scan(voxels: DataFrame, nz: int) -> DataFrame:
    """The scan direction reversed, before any deskew and whatever the skew."""
    return voxels.withColumn("z", (F.lit(nz - 1) - F.col("z")).cast("int"))


def flipped_range(z: tuple[int, int], nz: int) -> tuple[int, int]:
    """The stored planes that are ``z`` once the scan direction is reversed."""
    return nz - z[1], nz - z[0]


def stack(layers: list[DataFrame], axis: str, extents: list[int] | None = None) -> DataFrame:
    """Volumes laid one after another along t or c, each by the extents of those before it.

    Extents that are not given reach as far as the voxels with a value: one number a layer comes to the driver.
    """
    if axis not in ("t", "c"):
        raise ValueError("layers stack along t or c")
    if not layers:
        raise ValueError("no layers")
    if extents is None:
        extents = [(layer.agg(F.max(axis)).first()[0] or 0) + 1 for layer in layers[:-1]] + [1]
    out, at = None, 0
    for layer, extent in zip(layers, extents, strict=True):
        moved = layer.withColumn(axis, (F.col(axis) + at).cast("int"))
        out, at = moved if out is None else out.unionByName(moved), at + extent
    return out


def scene_numbers(scenes: DataFrame) -> DataFrame:
    """Reader index of each scene: its place among the sorted keys. Few rows by nature."""
    from pyspark.sql import Window

    return scenes.withColumn("scene_index", (F.row_number().over(Window.partitionBy("image_id").orderBy("scene_key")) - 1).cast("int"))


def named_channels(meta: DataFrame) -> DataFrame:
    """Channels whose names are no placeholders like ``Channel:0:1``."""
    return meta.filter(~F.col("channel_name").rlike(r"^Channel:\d+:\d+$"))


def complete_frames(voxels: DataFrame, channels: int, depth: int, planes: DataFrame | None = None) -> DataFrame:
    """Without the last time of each image if it lacks a plane of some channel.

    ``planes`` (image_id, t, c, z) lists the planes that a reader found; else those count that hold a value.
    Only the images that lose a frame are joined, and only by (image, time).
    """
    held = (planes if planes is not None else voxels).select(*KEYS, "z").distinct()
    last = held.groupBy("image_id", "t").agg(F.count("*").alias("n")).groupBy("image_id").agg(F.max(F.struct("t", "n")).alias("last"))
    bad = last.filter(F.col("last.n") < channels * depth).select("image_id", F.col("last.t").alias("t"))
    return voxels.join(bad, ["image_id", "t"], "left_anti").select(voxels.columns)


def image_meta(voxels: DataFrame, voxel: tuple[float, float, float], dtype: str) -> DataFrame:
    """(image_id, sizes, voxel sizes, logical type): as far as the voxels with a value reach."""
    ends = [(F.max(k) + 1).alias(f"size_{k}") for k in ("t", "c", "z", "y", "x")]
    sizes = [F.lit(v).alias(f"d{k}") for k, v in zip("zyx", voxel, strict=True)]
    return voxels.groupBy("image_id").agg(*ends).select("*", *sizes, F.lit(dtype).alias("logical_dtype"))


def pixel_sizes(known: tuple[float | None, float | None, float | None], given: tuple[float, float, float] | None, default: tuple[float, float, float]) -> tuple[float, float, float]:
    """The sizes that the user gave, else those of the metadata if all three are set, else the defaults."""
    if given is not None:
        return given
    return default if any(k is None for k in known) else known  # type: ignore[return-value]
