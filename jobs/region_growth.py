"""Job: how the bright part of every region grows and moves over the times of every image.

    python -m jobs.region_growth --config jobs/region_growth.json --input VOXELS --regions BOXES --output FOLDER

Reads a table of voxels and one of regions (any that the configuration's SQL expressions turn into
them), deskews the regions only, finds Otsu's threshold of each region, time and channel, measures the
voxels above it, and compares each time with the one measured before.  Writes Parquet partitioned by blocks of images.

A rerun gives the same rows: each block of images that it works on is replaced as a whole, others stay.  With
``blocks`` a run takes some blocks only, and the filter goes before any other work.

Defined cases: rows with a null key, place or value are no voxels; rows of one place add up; regions may overlap and reach
outside; a region of no size, and one whose voxels are all alike or dark, gives no row (with one level only
there is no threshold); empty tables give an empty output.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obliqua.functions.geometry import Acquisition, Box, region_box
from obliqua.operators import crop, filters
from obliqua.sources import volume

from .common import command_line, named_columns

log = logging.getLogger("jobs.region_growth")
SLICE = [*volume.KEYS, "roi_index"]
#: Regions are a list on the driver, as the geometry of each is worked out there.
MOST_REGIONS = 100_000


@dataclass(frozen=True)
class Settings:
    input: str
    regions: str
    output: str
    voxels: dict[str, str]
    boxes: dict[str, str]
    size: tuple[int, int, int]  # z, y, x
    pixel_sizes: tuple[float, float, float]
    angle: float = 30.0
    skew: str = "Y"
    frame: str = "objective"
    z_range: tuple[int, int] | None = None
    images_per_block: int = 100
    blocks: tuple[int, int] | None = None  # from, to (not included)

    @property
    def acquisition(self) -> Acquisition:
        return Acquisition(*self.size, *self.pixel_sizes, self.angle, self.skew, self.frame)


def voxels(spark: SparkSession, s: Settings) -> DataFrame:
    """The voxels of the blocks to work on; the crop adds up those of one place."""
    made = volume.normalise(named_columns(spark.read.parquet(s.input), s.voxels)).dropna()
    if s.blocks is not None:
        first, end = (n * s.images_per_block for n in s.blocks)
        made = made.filter((F.col("image_id") >= first) & (F.col("image_id") < end))
    return made


def boxes(spark: SparkSession, s: Settings) -> dict[int, Box]:
    """The output box of each region, by its number; a number that comes twice is refused."""
    rows = named_columns(spark.read.parquet(s.regions), s.boxes).dropna().limit(MOST_REGIONS + 1).collect()
    if len(rows) > MOST_REGIONS:
        raise ValueError(f"more than {MOST_REGIONS} regions: run the job for parts of them")
    if len({r["roi_index"] for r in rows}) < len(rows):
        raise ValueError("regions have numbers of their own")
    z = volume.span(s.z_range, s.acquisition.output_shape[0])
    made = {int(r["roi_index"]): region_box([(float(r["top"]), float(r["left"])), (float(r["bottom"]), float(r["right"]))], z.start, z.stop) for r in rows}
    return {k: b for k, b in made.items() if min(b.shape) > 0}


def growth(cropped: DataFrame, sizes: dict[int, int], voxel: tuple[float, float, float]) -> DataFrame:
    """Measures of each slice's bright voxels and the change since the time before.

    ``cropped`` has rows of arrays.  It is used more than once, so it should be kept, and dealt by slice: its voxels then meet
    the levels, are counted and measured where they are.  ``sizes`` are the voxels of each region, dark ones too.
    """
    counts = cropped.sparkSession.createDataFrame(list(sizes.items()), "roi_index int, n_voxels long")
    sized = cropped.join(F.broadcast(counts), "roi_index")  # the list of regions
    levels = filters.otsu_of_arrays(sized, SLICE)
    # a row a slice, which meets rows of arrays before they are taken apart
    bright = cropped.join(levels.hint("shuffle_hash"), SLICE).select(*SLICE, "threshold", F.inline(F.arrays_zip(*crop.PLACE_AND_VALUE))).filter("v >= threshold").withColumn("label", F.lit(1))
    found = filters.measures(bright, keys=[*SLICE, "threshold"], mean=filters.exact_mean(F.col("v")))
    mid = [(F.col(f"centroid_{k}") * size).alias(f"{k}_um") for k, size in zip("zyx", voxel, strict=True)]
    placed = found.select(*SLICE, "threshold", "area", (F.col("area") * voxel[0] * voxel[1] * voxel[2]).alias("volume_um3"), *mid, "intensity_mean")
    before = Window.partitionBy("image_id", "c", "roi_index").orderBy("t")  # a row a time
    moved = F.sqrt(sum((F.col(f"{k}_um") - F.lag(f"{k}_um").over(before)) ** 2 for k in "zyx"))
    return placed.select("*", (F.col("area") - F.lag("area").over(before)).alias("grown"), moved.alias("moved_um"))


def run(spark: SparkSession, s: Settings) -> dict[str, int]:
    """Measures how regions grow and move, and returns what was read and written."""
    a, regions = s.acquisition, boxes(spark, s)
    read = spark.read.parquet(s.input).count()  # from the files' footers
    log.info("read %d rows of %s and %d regions of %s", read, s.input, len(regions), s.regions)
    if not regions:
        raise ValueError(f"{s.regions} holds no region of any size")
    cropped = crop.packed_crops(voxels(spark, s), a, regions, places=6).repartition(*SLICE).persist()
    try:
        measured = growth(cropped, {k: b.shape[0] * b.shape[1] * b.shape[2] for k, b in regions.items()}, (a.new_dz, *s.pixel_sizes[1:]))
        rounded = measured.withColumns({k: F.round(k, 3 if k == "intensity_mean" else 6) for k in ("threshold", "volume_um3", "z_um", "y_um", "x_um", "intensity_mean", "moved_um")})
        placed = rounded.withColumn("image_block", F.floor(F.col("image_id") / s.images_per_block).cast("int"))
        # a block's rows are few beside its voxels: one file for each
        placed.repartition("image_block").write.partitionBy("image_block").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(s.output)
    finally:
        cropped.unpersist()
    written = result(spark, s)
    if s.blocks is not None:
        written = written.filter((F.col("image_block") >= s.blocks[0]) & (F.col("image_block") < s.blocks[1]))
    told = {"rows_read": read, "regions": len(regions), "rows_written": written.count()}
    log.info("wrote %d measures to %s", told["rows_written"], s.output)
    return told


SCHEMA = "image_id int, t int, c int, roi_index int, threshold double, area long, volume_um3 double, z_um double, y_um double, x_um double, intensity_mean double, grown long, moved_um double, image_block int"


def result(spark: SparkSession, s: Settings) -> DataFrame:
    """The output as it stands."""
    return spark.read.schema(SCHEMA).parquet(s.output)


if __name__ == "__main__":
    command_line("region_growth", Settings, run, ("input", "regions", "output"))
