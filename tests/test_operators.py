"""Operators against plain array loops, and by properties that must hold."""

import math

import numpy as np
import pytest

from obliqua.functions import dtypes
from obliqua.functions.geometry import Acquisition, Box
from obliqua.operators import crop, decon, estimate, filters, labels, mip, rois
from obliqua.operators.deskew import deskew
from obliqua.sources import volume

RNG = np.random.default_rng(3)


def frame(spark, array, t=0, c=0):
    at = np.argwhere(array != 0)
    rows = [(0, t, c, *map(int, p), float(array[tuple(p)])) for p in at]
    return spark.createDataFrame(rows, "image_id int, t int, c int, z int, y int, x int, v double")


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["z"], r["y"], r["x"]] = r["v"]
    return out


def loop_shear(raw, a):
    """The kernel as nested loops over the output, for Y-skew."""
    out = np.zeros(a.output_shape)
    for z in range(out.shape[0]):
        for y in range(out.shape[1]):
            p, q = math.floor(z / a.rise), math.floor(y - z / a.tan)
            fp, fq = z / a.rise - p, y - z / a.tan - q
            if 0 <= p < a.nz - 1 and 0 <= q < a.ny - 1:
                out[z, y] = (1 - fp) * ((1 - fq) * raw[p, q] + fq * raw[p, q + 1]) + fp * ((1 - fq) * raw[p + 1, q] + fq * raw[p + 1, q + 1])
    return out


def test_shear_deskew_equals_the_loops(spark):
    a = Acquisition(8, 12, 5, 2.0, 1.04, 1.04, 45.0, "Y", "shear")
    raw = RNG.integers(0, 50, (8, 12, 5)).astype(float)
    assert np.allclose(dense(deskew(frame(spark, raw), a), a.output_shape), loop_shear(raw, a))


def test_x_skew_is_y_skew_with_axes_swapped(spark):
    raw = RNG.integers(0, 50, (6, 7, 9)).astype(float)
    for kind in ("shear", "objective"):
        x = Acquisition(6, 7, 9, 2.0, 1.0, 1.04, 40.0, "X", kind)
        y = Acquisition(6, 9, 7, 2.0, 1.04, 1.0, 40.0, "Y", kind)
        one = dense(deskew(frame(spark, raw), x), x.output_shape)
        two = dense(deskew(frame(spark, raw.swapaxes(1, 2)), y), y.output_shape)
        assert np.allclose(one, two.swapaxes(1, 2))


def test_objective_deskew_of_one_voxel(spark):
    raw = np.zeros((5, 5, 5))
    raw[2, 0, 0] = 10
    a = Acquisition(5, 5, 5, 1.0, 1.0, 1.0, 60.0, "Y", "objective")
    out = dense(deskew(frame(spark, raw), a), a.output_shape)
    assert np.isclose(out[2, 2, 0], 0.56624335, atol=1e-6)


@pytest.mark.parametrize("kind", ["shear", "objective"])
def test_flipping_twice_changes_nothing(spark, kind):
    raw = RNG.integers(0, 9, (5, 6, 4)).astype(float)
    a = Acquisition(5, 6, 4, 2.0, 1.0, 1.0, 45.0, "Y", kind)
    flipped = volume.flip_scan(frame(spark, raw[::-1]), 5)
    assert np.allclose(dense(deskew(flipped, a), a.output_shape), dense(deskew(frame(spark, raw), a), a.output_shape))


@pytest.mark.parametrize(("kind", "skew"), [("shear", "Y"), ("shear", "X"), ("objective", "Y"), ("objective", "X")])
def test_crops_equal_the_part_of_the_whole(spark, kind, skew):
    raw = RNG.integers(1, 90, (12, 20, 18)).astype(float)
    a = Acquisition(12, 20, 18, 2.0, 1.04, 1.04, 35.0, skew, kind)
    whole = dense(deskew(frame(spark, raw), a), a.output_shape)
    nz, ny, nx = a.output_shape
    box = Box((1, nz - 1), (ny // 3, ny // 3 + 6), (nx // 3, nx // 3 + 5))
    rows = crop.crop(frame(spark, raw), a, {7: box}, dense=True).collect()
    assert len(rows) == np.prod(box.shape)
    for r in rows:
        assert np.isclose(r["v"], whole[r["z"] + box.z[0], r["y"] + box.y[0], r["x"] + box.x[0]])


def test_subblock_crop_lies_within_a_voxel(spark):
    raw = np.zeros((30, 40, 12))
    raw[10:14, 18:24, 4:8] = 500
    a = Acquisition(30, 40, 12, 1.0, 1.0, 1.0, 45.0, "Y", "shear")
    nz, ny, nx = a.output_shape
    box = Box((2, 18), (20, 45), (2, 10))
    one = dense(crop.crop(frame(spark, raw), a, {0: box}), box.shape)
    two = dense(crop.crop(frame(spark, raw), a, {0: box}, align="subblock"), box.shape)
    centre = lambda v: np.array([(i * v).sum() / v.sum() for i in np.indices(v.shape)])
    assert one.sum() > 0
    assert np.abs(centre(one) - centre(two)).max() <= 1


def test_projection_equals_the_maximum_of_the_deskewed_volume(spark):
    raw = RNG.integers(0, 90, (8, 12, 5)).astype(float)
    a = Acquisition(8, 12, 5, 2.0, 1.04, 1.04, 45.0, "Y", "shear")
    full = loop_shear(raw, a).max(0)
    got = np.zeros_like(full)
    for r in mip.project(frame(spark, raw), a, "linear").collect():
        got[r["y"], r["x"]] = r["v"]
    assert np.allclose(got, full)


def test_nearest_projection_truncates_toward_zero(spark):
    a = Acquisition(6, 10, 2, 1.0, 1.0, 1.0, 30.0, "Y", "objective")
    raw = RNG.integers(1, 99, (6, 10, 2)).astype(float)
    want = np.zeros(a.mip_shape())
    for y in range(want.shape[0]):
        for j in range(max(0, math.floor((y - 6) / a.cos)), min(10, math.ceil(y / a.cos) + 1)):
            n = int((y - a.cos * j) + 0.5)
            if 0 <= n < 6:
                want[y] = np.maximum(want[y], raw[n, j])
    got = np.zeros_like(want)
    for r in mip.project(frame(spark, raw), a).collect():
        got[r["y"], r["x"]] = r["v"]
    assert (got == want).all()


def test_negative_values_never_show_in_a_projection(spark):
    a = Acquisition(4, 6, 2, 1.0, 1.0, 1.0, 45.0)
    assert mip.project(frame(spark, -np.ones((4, 6, 2))), a, "linear").count() == 0


def test_saturating_casts(spark):
    df = spark.createDataFrame([(114.83,), (82.099,), (0.9,), (-2.7,), (1e9,), (float("nan"),), (2.5,)], "v double")
    assert [r[0] for r in df.select(dtypes.saturate(df.v, "int16")).collect()] == [115, 82, 1, -3, 32767, 0, 2]
    assert [r[0] for r in df.select(dtypes.saturate(df.v, "uint8")).collect()] == [115, 82, 1, 0, 255, 0, 2]


def test_labels_join_across_corners():
    mask = np.zeros((3, 3, 6), bool)
    mask[0, 0, 0] = mask[1, 1, 1] = mask[2, 2, 5] = True
    found = labels.label_array(mask)
    assert found[0, 0, 0] == found[1, 1, 1] == 1
    assert found[2, 2, 5] == 2


def test_blur_and_label_of_one_voxel(spark):
    raw = np.zeros((5, 5, 5))
    raw[2, 2, 2] = 10
    labelled = labels.label_blocks(filters.above(filters.gaussian(frame(spark, raw), 1.0, raw.shape), 0.5))
    assert {(r["z"], r["y"], r["x"]): r["label"] for r in labelled.collect()}[2, 2, 2] == 1


def test_deconvolution_in_blocks_sharpens_and_keeps_the_sum(spark):
    point = np.zeros((20, 24, 24))
    point[9:11, 11:13, 11:13] = 100
    psf = np.ones((3, 3, 3))
    blurred = np.zeros_like(point)
    for p in np.argwhere(point):
        blurred[tuple(slice(k - 1, k + 2) for k in p)] += point[tuple(p)] / 27
    out = dense(decon.deconvolve(frame(spark, blurred), {0: psf}, point.shape, 20, block=(10, 12, 12)), point.shape)
    assert np.abs(out - point).sum() < np.abs(blurred - point).sum()
    whole = decon.richardson_lucy(blurred, psf, 20)
    assert np.corrcoef(out.ravel(), whole.ravel())[0, 1] > 0.95
    with pytest.raises(ValueError, match="point-spread"):
        decon.check_psfs({0: psf}, 2)


def test_estimates_and_chunks(spark):
    assert [estimate.slurm_bytes(x) for x in ("16G", "16384", "0", "garbage")] == [16 << 30, 16 << 30, None, None]
    table = spark.createDataFrame([(i,) for i in range(5)], "roi_index int")
    assert sorted(map(list, [r["rois"] for r in estimate.chunks(table, 3, 5).collect()])) == [[0, 3], [1, 4], [2]]
    assert estimate.host_limit(10 << 30, {"SLURM_MEM_PER_CPU": "1G", "SLURM_CPUS_PER_TASK": "4"}) == 4 << 30
    none = estimate.region_estimate(spark.createDataFrame([], estimate.SHAPES), 2)
    assert estimate.workers(none, estimate.Limits()).first()["workers"] == 1
    sizes = spark.createDataFrame([(0, None), (1, 512), (2, 1536), (3, 3 << 30)], "i int, n long")
    assert [r[0] for r in sizes.select(estimate.format_bytes_column(sizes.n)).collect()] == ["unknown", "512 B", "1.50 KiB", "3.00 GiB"]


def test_regions_from_files(tmp_path, spark):
    path = tmp_path / "shapes.csv"
    path.write_text("index,shape-type,vertex-index,axis-0,axis-1,axis-2\n" + "".join(f"{i},polygon,{k},0,{y},{x}\n" for i, (y0, x0) in enumerate([(1.0, 2.0), (5.0, 6.0)]) for k, (y, x) in enumerate([(y0, x0), (y0, x0 + 3), (y0 + 4, x0 + 3), (y0 + 4, x0)])))
    assert rois.read_regions(str(path)) == [(1.0, 2.0, 5.0, 5.0), (5.0, 6.0, 9.0, 9.0)]
    roi = tmp_path / "a.roi"
    roi.write_bytes(b"Iout\x00\xe3\x01\x00" + np.array([3, 4, 10, 20], ">i2").tobytes() + bytes(48))
    assert rois.read_regions(str(roi)) == [(3.0, 4.0, 10.0, 20.0)]
    assert rois.units_of([str(path)]) == "Microns"
    with pytest.raises(ValueError, match="mixed"):
        rois.units_of([str(path), str(roi)])
    scaled = rois.in_pixels(rois.as_frame(spark, [(1.0, 2.0, 3.0, 4.0)]), 0.5).first()
    assert (scaled["top"], scaled["right"]) == (2.0, 8.0)
    with pytest.raises(ValueError, match="no regions"):
        rois.subset(rois.as_frame(spark, [(0, 0, 1, 1)]), [3], 1)


def test_incomplete_last_frame_is_dropped(spark):
    whole, short = np.ones((2, 3, 3)), np.ones((2, 3, 3))
    short[1] = 0
    both = frame(spark, whole, 0).unionByName(frame(spark, short, 1))
    assert {r["t"] for r in volume.complete_frames(both, 1, 2).collect()} == {0}
    # a plane that was found counts, whatever it holds; a channel that is missing as a whole does not
    found = both.select("image_id", "t", "c", "z").unionByName(spark.createDataFrame([(0, 1, 0, 1)], "image_id int, t int, c int, z int"))
    assert {r["t"] for r in volume.complete_frames(both, 1, 2, found).collect()} == {0, 1}
    assert {r["t"] for r in volume.complete_frames(both, 2, 2, found).collect()} == {0}


def test_layers_stack_by_their_extents(spark):
    layer = frame(spark, np.ones((1, 1, 2)), 0).unionByName(frame(spark, np.ones((1, 1, 2)), 1))
    made = volume.stack([layer, layer], "t")
    assert made.count() == made.distinct().count() == 8 and {r["t"] for r in made.collect()} == {0, 1, 2, 3}
    assert {r["t"] for r in volume.stack([layer, layer], "t", [5, 2]).collect()} == {0, 1, 5, 6}


def test_ranges():
    assert volume.span((0, 0), 5) == range(0, 5)
    with pytest.raises(ValueError, match="outside"):
        volume.span((0, 6), 5)
    with pytest.raises(ValueError, match="axes"):
        volume.dimension_orders(2)
