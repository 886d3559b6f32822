"""Thresholds of slices without an empty or dark place, against numpy."""

import numpy as np
import pytest

from obliqua import queries
from obliqua.operators import filters

SCHEMA = "image_id int, t int, c int, z int, y int, x int, v double"


def best(values):
    """The centre of the first bin after which both classes, neither of them empty, differ most."""
    top = values.max()
    counts, mid = np.bincount(np.minimum(values * 256 // top, 255).astype(int), minlength=256), (np.arange(256) + 0.5) * top / 256
    scores = {}
    for k in range(256):
        low, high = counts[: k + 1], counts[k + 1 :]
        if low.sum() and high.sum():
            gap = (low * mid[: k + 1]).sum() / low.sum() - (high * mid[k + 1 :]).sum() / high.sum()
            scores[mid[k]] = round(low.sum() * high.sum() * gap * gap, 3)
    return max(scores, key=lambda m: (scores[m], -m))


def table(spark, slices):
    rows = [(i, 0, 0, 0, 0, x, float(v)) for i, values in slices.items() for x, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def test_otsu_of_a_slice_whose_voxels_are_all_bright(spark):
    r = np.random.default_rng(5)
    slices = {0: r.integers(900, 2000, 300), 1: np.concatenate([r.integers(0, 9, 150), r.integers(700, 900, 150)])}
    got = {row.image_id: row.threshold for row in filters.otsu(table(spark, slices), 300).collect()}
    assert got == pytest.approx({i: best(v) for i, v in slices.items()})


def test_slices_of_one_level_have_no_threshold(spark):
    slices = {0: np.zeros(20), 1: np.full(20, 7), 2: np.array([3] * 10 + [9] * 10)}
    got = {row.image_id: row.threshold for row in filters.otsu(table(spark, slices), 20).collect()}
    assert got == pytest.approx({2: best(slices[2])})


def test_otsu_of_arrays_equals_that_of_voxels(spark):
    r = np.random.default_rng(8)
    slices = {i: np.where(r.random(60) < 0.8, r.integers(1, 2000, 60), 0) for i in range(9)} | {9: np.full(60, 7), 10: r.integers(900, 2000, 60)}
    voxels = table(spark, slices).filter("v > 0")
    rows = [(i, 60, [float(x) for x in part]) for i, values in slices.items() for part in np.array_split(values[values > 0], 5)]
    arrays = spark.createDataFrame(rows, "image_id int, n_voxels long, v array<double>").repartition(7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # slices go on in the next batch
    try:
        got = {row.image_id: row.threshold for row in filters.otsu_of_arrays(arrays, ["image_id"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {row.image_id: row.threshold for row in filters.otsu(voxels, 60).collect()}
    assert got == want and len(want) == 10


def test_otsu_of_filled_slices_equals_its_sql(spark, tmp_path):
    """Slices with a value at every place have an empty lowest bin; others lack voxels, and one has dark ones."""
    import duckdb
    from pyspark.sql import functions as F

    n = queries.NZ * queries.NY * queries.NX
    place, slice_ = F.col("id") % n, (F.col("id") / n).cast("long")
    made = spark.range(4 * n).select(
        (slice_ % 2).cast("int").alias("l_linenumber"),
        F.when(slice_ < 2, "O").otherwise("F").alias("l_linestatus"),
        (place % queries.NZ).alias("l_orderkey"),
        ((place / queries.NZ).cast("long") % queries.NY).alias("l_partkey"),
        ((place / (queries.NZ * queries.NY)).cast("long")).alias("l_suppkey"),
        (F.when((slice_ == 3) & (place % 5 == 0), 1).otherwise(F.pmod(F.xxhash64("id"), F.lit(400)) + 100)).cast("decimal(15,2)").alias("l_quantity"),
    )
    made.filter((slice_ != 2) | (place % 7 > 0)).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.t, r.c): r.threshold for r in queries.queries()["otsu_threshold"](spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = {(r.t, r.c): r.threshold for r in duck.execute(queries.oracle_sql()["otsu_threshold"]).df().itertuples()}
    assert got == want and len(want) == 4
    assert sum(level < 2 for level in want.values()) == 2
