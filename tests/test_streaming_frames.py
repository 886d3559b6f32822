"""Frames of a stream against the batch rule, for planes in any order and with some missing."""

import random
import time

import pytest
from pyspark.sql import functions as F

from obliqua.sources.volume import complete_frames
from obliqua.streaming.frames import frames_as_they_come

CHANNELS, DEPTH = 2, 3
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
SCHEMA = "image_id int, t int, c int, z int"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(PROVIDER, before)


def whole(image, t):
    return [(image, t, c, z) for c in range(CHANNELS) for z in range(DEPTH)]


def kept(spark, rows):
    """The frames that the batch rule keeps."""
    voxels = spark.createDataFrame(rows, SCHEMA).withColumn("y", F.lit(0)).withColumn("x", F.lit(0)).withColumn("v", F.lit(1.0))
    return {(r.image_id, r.t) for r in complete_frames(voxels, CHANNELS, DEPTH).select("image_id", "t").distinct().collect()}


def test_frames_come_when_they_are_whole_and_the_rest_after_a_while(spark, rocks, tmp_path):
    r = random.Random(3)
    rows = whole(0, 0) + whole(0, 1) + whole(0, 2)[:-1] + whole(1, 0)[1:] + whole(1, 4) + whole(2, 0)[:2] + whole(3, 5) + whole(3, 5)[:2]
    r.shuffle(rows)
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def arrive(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)

    arrive(rows[:12])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    query = frames_as_they_come(stream, CHANNELS, DEPTH, patience_ms=8000).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(processingTime="500 milliseconds").start()

    def told():
        try:
            return {(x.image_id, x.t): (x.n_planes, x.complete) for x in spark.read.parquet(out).collect()}
        except Exception:  # nothing is written yet
            return {}

    def wait_for(wanted):
        """Batches go on for the timers, so that a stream is never done."""
        deadline = time.time() + 40
        while told() != wanted and time.time() < deadline and query.isActive:
            time.sleep(0.5)
        assert told() == wanted, query.exception()

    try:
        arrive(rows[12:20])
        arrive(rows[20:] + [(None, 1, 0, 0), (0, None, 0, 0)])
        wanted = dict.fromkeys([(0, 0), (0, 1), (1, 4), (3, 5)], (6, True)) | {(1, 0): (5, False)}
        wait_for(wanted)
        assert wanted.keys() == kept(spark, rows)
        arrive([whole(0, 2)[-1], whole(1, 0)[0]])  # the last time is whole at last; a frame that has been told stays as it is
        wait_for(wanted | {(0, 2): (6, True)})
        assert told().keys() == kept(spark, [*rows, whole(0, 2)[-1]])
    finally:
        query.stop()
    assert spark.read.parquet(out).count() == len(told())


def test_planes_outside_the_sizes_are_refused(spark, rocks, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(0, 0, 2, 0)], SCHEMA).write.parquet(folder)
    query = frames_as_they_come(spark.readStream.schema(SCHEMA).parquet(folder), CHANNELS, DEPTH).writeStream.format("memory").queryName("refused").outputMode("append").start()
    with pytest.raises(Exception, match="outside 2 channels"):
        query.awaitTermination(40)
    query.stop()
