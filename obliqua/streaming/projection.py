"""Projections of a growing acquisition: an extension, as the batch operators have no streams.

Planes arrive as files; each contributes to its slice's projection on its own, so a
running maximum per pixel is all the state there is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.geometry import Acquisition
from ..operators.mip import project
from ..sources.volume import normalise

SCHEMA = "image_id int, t int, c int, z int, y int, x int, v double"


def read_planes(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    return normalise(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(folder))


def running_projection(planes: DataFrame, a: Acquisition) -> DataFrame:
    """The objective-frame projection by nearest planes, which needs no two planes at once."""
    if a.frame != "objective":
        raise ValueError("running projections need the objective frame")
    return project(planes, a, "nearest")


def start(projection: DataFrame, name: str) -> StreamingQuery:
    """Keeps the projection so far in a table in memory."""
    return projection.writeStream.outputMode("complete").format("memory").queryName(name).start()
