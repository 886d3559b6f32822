"""Interpolation by blocks: the same as loops for every size of block, and few rows shuffled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from obliqua.functions.geometry import Acquisition, Box
from obliqua.operators import blocks, crop, mip
from obliqua.operators.deskew import deskew
from tests.test_operators import dense, frame, loop_shear

RAW = np.where(np.random.default_rng(5).random((9, 13, 11)) < 0.6, np.random.default_rng(6).normal(50, 40, (9, 13, 11)), 0)


def loop_objective(raw, a):
    """The kernel of the objective frame as nested loops, for Y-skew."""
    out = np.zeros(a.output_shape)
    for k in range(out.shape[0]):
        for y in range(out.shape[1]):
            place = y - k / a.tan
            p = int(np.floor(place / a.step))
            after = place - p * a.step
            before = a.step - after
            at, to = k / a.sin + after * a.cos, k / a.sin - before * a.cos
            q, r = int(np.floor(at)), int(np.floor(to))
            if 0 <= p < a.nz - 1 and 0 <= q < a.ny - 1 and 0 <= r < a.ny - 1:
                later = (to - r) * raw[p + 1, r + 1] + (1 - (to - r)) * raw[p + 1, r]
                earlier = (at - q) * raw[p, q + 1] + (1 - (at - q)) * raw[p, q]
                out[out.shape[0] - 1 - k, y] = (after * later + before * earlier) / a.step
    return out


@pytest.mark.parametrize("size", [(1, 1, 1), (3, 4, 5), (32, 64, 256)])
@pytest.mark.parametrize("angle,steps", [(30.0, 1.0), (45.0, 2.3), (60.0, 0.4)])
@pytest.mark.parametrize("kind", ["shear", "objective"])
def test_every_block_size_gives_the_loops(spark, size, angle, steps, kind):
    a = Acquisition(*RAW.shape, steps, 1.0, 1.0, angle, "Y", kind)
    want = (loop_shear if kind == "shear" else loop_objective)(RAW, a)
    made = deskew(frame(spark, RAW).repartition(3), a, size=size)
    assert np.allclose(dense(made, a.output_shape), want)
    assert made.count() == made.select("z", "y", "x").distinct().count()
    box = Box((1, 4), (3, 12), (2, 7))
    part = np.zeros_like(want)
    part[1:4, 3:12, 2:7] = want[1:4, 3:12, 2:7]
    assert np.allclose(dense(deskew(frame(spark, RAW), a, box, size=size), a.output_shape), part)


def test_skew_along_x_is_the_same_turned(spark):
    a, b = Acquisition(*RAW.shape, 1.5, 1.0, 1.0, 40.0, "Y"), Acquisition(9, 11, 13, 1.5, 1.0, 1.0, 40.0, "X")
    assert np.allclose(dense(deskew(frame(spark, RAW.transpose(0, 2, 1)), b), b.output_shape).transpose(0, 2, 1), dense(deskew(frame(spark, RAW), a), a.output_shape))


def test_odd_tables(spark):
    a = Acquisition(*RAW.shape, 1.0, 1.0, 1.0, 45.0, "Y")
    once = dense(deskew(frame(spark, RAW), a), a.output_shape)
    twice = frame(spark, RAW).unionByName(frame(spark, RAW)).withColumn("block", F.lit("x")).withColumn("zs", F.lit(0))
    assert np.allclose(dense(deskew(twice, a), a.output_shape), 2 * once)
    assert deskew(frame(spark, np.zeros((1, 1, 1))), a).count() == 0
    beyond = frame(spark, RAW).withColumn("x", (F.col("x") + 100).cast("int")).unionByName(frame(spark, RAW).withColumn("z", (F.col("z") - 50).cast("int")))
    assert deskew(beyond, a).count() == 0
    zero = deskew(frame(spark, RAW).withColumn("v", F.lit(0.0)), a)  # a voxel of the table with the value 0 is there
    assert zero.count() == deskew(frame(spark, RAW), a).count() and zero.agg(F.max("v")).first()[0] == 0


def test_slices_stay_apart(spark):
    a = Acquisition(*RAW.shape, 1.0, 1.0, 1.0, 45.0, "Y")
    two = frame(spark, RAW, t=1).unionByName(frame(spark, 3 * RAW, c=2)).unionByName(frame(spark, 2 * RAW).withColumn("image_id", F.lit(9)))
    once = loop_shear(RAW, a)
    for where, times in (("t = 1 and c = 0 and image_id = 0", 1), ("c = 2 and t = 0", 3), ("image_id = 9", 2)):
        assert np.allclose(dense(deskew(two, a).filter(where), a.output_shape), times * once)


@pytest.mark.parametrize("kind", ["shear", "objective"])
def test_regions_that_overlap_and_cross_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(crop, "Blocks", lambda kernel: blocks.Blocks(kernel, (3, 4, 5)))
    a = Acquisition(*RAW.shape, 1.3, 1.0, 1.0, 35.0, "Y", kind)
    whole = dense(deskew(frame(spark, RAW), a), a.output_shape)
    boxes = {0: Box((0, 5), (2, 11), (1, 9)), 4: Box((3, 6), (2, 11), (0, 3)), 7: Box((2, 3), (90, 99), (0, 3)), 9: Box((-2, 2), (-3, 4), (-1, 30))}
    made = crop.crop(frame(spark, RAW), a, boxes).collect()
    for index, box in boxes.items():
        got = {(r.z + box.z[0], r.y + box.y[0], r.x + box.x[0]): r.v for r in made if r.roi_index == index}
        want = {tuple(map(int, p)): whole[tuple(p)] for p in np.argwhere(whole) if all(lo <= n < hi for n, (lo, hi) in zip(p, (box.z, box.y, box.x), strict=True))}
        assert got.keys() >= want.keys() and all(abs(v - want.get(p, 0)) < 1e-9 for p, v in got.items())
        assert all(lo <= n < hi for p in got for n, (lo, hi) in zip(p, (box.z, box.y, box.x), strict=True))


@pytest.mark.parametrize("size", [(2, 3, 4), (32, 64, 256)])
def test_projections_by_blocks_equal_those_of_the_volume(spark, monkeypatch, size):
    monkeypatch.setattr(mip, "Blocks", lambda kernel: blocks.Blocks(kernel, size))
    a = Acquisition(*RAW.shape, 1.3, 1.0, 1.0, 35.0, "Y")
    want = np.maximum(loop_shear(RAW, a).max(0), 0)
    got = np.zeros_like(want)
    for r in mip.project(frame(spark, RAW), a, "linear").collect():
        got[r.y, r.x] = r.v
    assert np.allclose(got, want)
    b = Acquisition(*RAW.shape, 1.3, 1.0, 1.0, 35.0, "Y", "objective")
    got = np.zeros(b.mip_shape())
    for r in mip.project(frame(spark, RAW), b, "linear").collect():
        got[r.y, r.x] = r.v
    want = np.zeros(b.mip_shape())
    for y in range(want.shape[0]):
        for j in range(int(np.floor((y - b.nz * b.step) / b.cos)), int(np.ceil(y / b.cos)) + 1):
            place = (y - j * b.cos) / b.step
            n = int(np.floor(place))
            if 0 <= j < b.ny and 0 <= n < b.nz:
                value = RAW[n, j] if n + 1 == b.nz else (1 - (place - n)) * RAW[n, j] + (place - n) * RAW[n + 1, j]
                want[y] = np.maximum(want[y], value)
    assert np.allclose(got, want)


def test_rows_shuffled_count_blocks_and_not_voxels(spark):
    a = Acquisition(20, 40, 60, 1.0, 1.0, 1.0, 45.0, "Y")
    raw = frame(spark, np.ones((20, 40, 60))).coalesce(2)
    grid = blocks.Blocks(blocks.kernel_of(a))
    moved = blocks.packed(raw, grid)
    sizes = moved.selectExpr("count(*) as n", "sum(size(vs)) as v").first()
    assert sizes["n"] <= 2 * np.prod(grid.counts) and 48_000 <= sizes["v"] <= 1.6 * 48_000
    assert "Exchange" not in moved._jdf.queryExecution().toString()
    plan = deskew(raw, a)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    wanted = np.array(grid.meeting((0, 2), (0, 2), (0, 60)), np.int64)
    assert {r.block for r in blocks.packed(raw, grid, wanted).collect()} <= set(wanted.tolist())
