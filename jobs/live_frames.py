"""Job: a table of frames that follows an acquisition while its planes arrive.

    python -m jobs.live_frames --config jobs/live_frames.json --input PLANES --output FOLDER --checkpoint FOLDER

Planes are rows of files that come into a folder, with their 8-bit pixels as bytes (here the UTF-8 bytes
of texts); the input is a folder or a pattern of paths.  A run takes the files that no run before it has taken, and ends.  Each new plane is measured once
and kept as one small row; then the frames of the blocks of images that it belongs to are made
anew from these rows: brightness, saturation and the sharpest plane of each image, time and channel.  The last time of an
image is left out while it lacks planes, as a microscope writes it last, and comes in with the planes that
complete it, in whatever order they arrive.

Exactly once: the file stream's checkpoint numbers the batches; a batch that is repeated after a failure replaces its own rows
and the same blocks.  ``planes`` is partitioned by block and batch, ``frames`` by block.

Defined cases: rows with a null key or no pixels (null) are no planes and are counted as left out; an
empty plane is there but has no pixels; of a plane that comes again the one of the last batch counts, within a batch that
with the greatest checksum; an empty folder gives no frames; other columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obliqua.operators import mip
from obliqua.sources import volume

from .common import command_line, named_columns

log = logging.getLogger("jobs.live_frames")
PLANE = [*volume.KEYS, "z"]
MEASURED = "image_id int, t int, c int, z int, n_pixels long, total long, least int, brightest int, saturated long, edges long, mark long"
PLANES = f"{MEASURED}, image_block int, batch long"
FRAMES = "image_id int, t int, c int, n_planes long, n_pixels long, total long, least int, brightest int, saturated long, intensity_mean double, sharpest_z int, image_block int"


@dataclass(frozen=True)
class Settings:
    input: str
    output: str
    checkpoint: str
    schema: str
    planes: dict[str, str]
    channels: int
    depth: int
    saturated: int = 255
    images_per_block: int = 100
    files_at_once: int = 1000


def measured(planes: DataFrame, saturated: int) -> DataFrame:
    """A row of whole numbers for each plane; ``edges`` is the sum of squared steps from pixel to pixel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column("pixels"):
                pixels = np.frombuffer(raw.as_buffer(), np.uint8)
                steps = np.diff(pixels.astype(np.int64))
                ends = (int(pixels.min()), int(pixels.max())) if len(pixels) else (None, None)
                rows.append((len(pixels), int(pixels.sum(dtype=np.int64)), *ends, int((pixels >= saturated).sum()), int(steps @ steps)))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in PLANE], *columns, batch.column("mark")], names=[x.split()[0] for x in MEASURED.split(", ")])

    return planes.select(*PLANE, F.xxhash64("pixels").alias("mark"), "pixels").mapInArrow(run, MEASURED)


def frames(planes: DataFrame, channels: int, depth: int) -> DataFrame:
    """(image, time, channel) rows of measured planes, without last times that lack planes."""
    fields = [c for c in planes.columns if c not in PLANE]
    latest = planes.groupBy(*PLANE).agg(F.max(F.struct("batch", "mark", *[c for c in fields if c not in ("batch", "mark")])).alias("last")).select(*PLANE, "last.*")
    whole = volume.complete_frames(latest, channels, depth)
    sums = whole.groupBy(*volume.KEYS, "image_block").agg(
        F.count("*").alias("n_planes"), F.sum("n_pixels").alias("n_pixels"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("brightest").alias("brightest"), F.sum("saturated").alias("saturated")
    )
    sharpest = mip.best_plane(whole.withColumn("v", F.col("edges"))).select(*volume.KEYS, F.col("z").alias("sharpest_z"))
    mean = F.when(F.col("n_pixels") > 0, F.round(F.col("total") / F.col("n_pixels"), 6))
    return sums.join(sharpest, volume.KEYS).withColumn("intensity_mean", mean).select(*[x.split()[0] for x in FRAMES.split(", ")])


def run(spark: SparkSession, s: Settings) -> dict[str, int]:
    """Takes the planes that are new, brings the frames up to date, and returns what was read and written."""
    told = {"rows_read": 0, "planes_written": 0, "rows_left_out": 0, "batches": 0}

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = measured(batch.dropna(), s.saturated).withColumn("image_block", F.floor(F.col("image_id") / s.images_per_block).cast("int"))
        rows.withColumn("batch", F.lit(number).cast("long")).write.partitionBy("image_block", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{s.output}/planes")
        held = session.read.schema(PLANES).parquet(f"{s.output}/planes")
        fresh = held.filter(F.col("batch") == number)
        written = fresh.count()
        if written:
            # only blocks that got planes are read, by their partitions
            made = frames(held.join(fresh.select("image_block").distinct(), "image_block", "left_semi"), s.channels, s.depth)
            made.repartition("image_block").write.partitionBy("image_block").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{s.output}/frames")
        read = batch.count()  # of the files' footers
        told.update(rows_read=told["rows_read"] + read, planes_written=told["planes_written"] + written, batches=told["batches"] + 1)
        log.info("batch %d: read %d rows, %d planes written to %s", number, read, written, s.output)

    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", s.files_at_once).parquet(s.input)
    query = named_columns(stream, s.planes).writeStream.foreachBatch(take).option("checkpointLocation", s.checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    told["rows_left_out"] = told["rows_read"] - told["planes_written"]
    log.info("read %d new rows of %s: %d planes, %d left out", told["rows_read"], s.input, told["planes_written"], told["rows_left_out"])
    return told


def result(spark: SparkSession, s: Settings) -> DataFrame:
    """The frames as they stand; none before the first plane."""
    try:
        return spark.read.schema(FRAMES).parquet(f"{s.output}/frames")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], FRAMES)


if __name__ == "__main__":
    command_line("live_frames", Settings, run, ("input", "output", "checkpoint"))
