"""The growth job against arithmetic in numpy, its reruns and its blocks of images."""

import itertools
import json

import numpy as np
import pytest

from jobs import common, region_growth
from obliqua.functions.geometry import Acquisition

SIZE, PIXELS, ANGLE = (8, 10, 6), (2.0, 1.0, 1.0), 45.0
REGIONS = [(3, 0, 0, 8, 6), (5, 4, 1, 10, 5)]


def shear(volume, a):
    """The deskewed volume by the two interpolations of its definition."""
    out = np.zeros(a.output_shape)
    for z, y in itertools.product(range(out.shape[0]), range(out.shape[1])):
        scan, lateral = z / a.rise, y - z / a.tan
        p, q = int(np.floor(scan)), int(np.floor(lateral))
        if 0 <= p and p + 1 < a.nz and 0 <= q and q + 1 < a.ny:
            fp, fq = scan - p, lateral - q
            out[z, y] = (1 - fp) * ((1 - fq) * volume[p, q] + fq * volume[p, q + 1]) + fp * ((1 - fq) * volume[p + 1, q] + fq * volume[p + 1, q + 1])
    return out


def otsu(values):
    """The centre of the bin after which both classes differ most."""
    top = values.max()
    bins = np.minimum(np.floor(values * 256 / top), 255).astype(int)
    counts, mid = np.bincount(bins.ravel(), minlength=256), (np.arange(256) + 0.5) * top / 256
    best = None
    for k in np.flatnonzero(counts):
        low, high = counts[: k + 1].sum(), counts[k + 1 :].sum()
        if high:
            gap = (counts[: k + 1] * mid[: k + 1]).sum() / low - (counts[k + 1 :] * mid[k + 1 :]).sum() / high
            score = round(low * high * gap * gap, 3)
            if best is None or score > best[0]:
                best = (score, mid[k])
    return best[1]


@pytest.fixture(scope="module")
def volumes():
    r = np.random.default_rng(3)
    return {(i, t, 0): np.where(r.random(SIZE) < 0.5, r.integers(1, 200, SIZE), 0) for i in range(5) for t in (0, 1, 4)}


@pytest.fixture
def inputs(spark, tmp_path, volumes):
    rows = [(i, t, c, *map(int, at), float(v[tuple(at)])) for (i, t, c), v in volumes.items() for at in np.argwhere(v)]
    rows += [(None, 0, 0, 1, 1, 1, 9.0), (0, 0, 0, 1, None, 1, 9.0), (0, 0, 0, 1, 1, 1, None)]
    spark.createDataFrame(rows, "image_id int, t int, c int, z int, y int, x int, v double").repartition(3).write.parquet(str(tmp_path / "voxels"))
    spark.createDataFrame([*REGIONS, (9, 2, 2, 2, 5)], "n int, top int, lft int, bottom int, rght int").write.parquet(str(tmp_path / "regions"))
    return tmp_path


def job(folder, output="out", **more):
    return common.settings(
        region_growth.Settings,
        {"voxels": {k: k for k in ("image_id", "t", "c", "z", "y", "x", "v")}, "boxes": {"roi_index": "n", "top": "top", "left": "lft", "bottom": "bottom", "right": "rght"}, "size": SIZE, "pixel_sizes": PIXELS, "angle": ANGLE, "frame": "shear", "z_range": [0, 5], "images_per_block": 2} | more,
        input=str(folder / "voxels"), regions=str(folder / "regions"), output=str(folder / output),
    )


def expected(volumes):
    a, out = Acquisition(*SIZE, *PIXELS, ANGLE, "Y", "shear"), {}
    for (i, t, c), volume in volumes.items():
        made = np.round(shear(volume, a), 6)
        for roi, top, left, bottom, right in REGIONS:
            cut = made[0:5, top:bottom, left:right]
            level = otsu(cut)
            at = np.argwhere(cut >= level)
            out[i, t, c, roi] = (level, len(at), len(at) * a.new_dz, *(at.mean(0) * (a.new_dz, 1, 1)), cut[tuple(at.T)].mean())
    return out


def rows(spark, s):
    return {(r.image_id, r.t, r.c, r.roi_index): r for r in region_growth.result(spark, s).collect()}


def test_measures_equal_arithmetic_and_a_rerun_changes_nothing(spark, inputs, volumes):
    s = job(inputs)
    told = region_growth.run(spark, s)
    got, want = rows(spark, s), expected(volumes)
    assert told == {"rows_read": sum(int((v > 0).sum()) for v in volumes.values()) + 3, "regions": 2, "rows_written": len(want)}
    assert got.keys() == want.keys()
    for key, w in want.items():
        g = got[key]
        assert (g.threshold, g.area, g.volume_um3, g.z_um, g.y_um, g.x_um, g.intensity_mean) == pytest.approx(w, abs=1e-3)
        i, t, c, roi = key
        before = {4: 1, 1: 0}.get(t)
        if before is None:
            assert g.grown is None and g.moved_um is None
        else:
            past = want[i, before, c, roi]
            assert g.grown == w[1] - past[1] and g.moved_um == pytest.approx(np.linalg.norm(np.subtract(w[3:6], past[3:6])), abs=1e-5)
    assert region_growth.run(spark, s) == told and rows(spark, s) == got
    assert {p.name for p in (inputs / "out").glob("image_block=*")} == {"image_block=0", "image_block=1", "image_block=2"}


def test_blocks_are_replaced_alone(spark, inputs, volumes):
    whole, parts = job(inputs), job(inputs, "parts")
    region_growth.run(spark, whole)
    for blocks in ([0, 1], [1, 3], [1, 2]):  # the last once more
        told = region_growth.run(spark, job(inputs, "parts", blocks=blocks))
    assert told["rows_written"] == 2 * 3 * 2
    assert rows(spark, parts) == rows(spark, whole)


def test_settings_that_cannot_be_are_refused(spark, inputs):
    with pytest.raises(ValueError, match="unknown settings"):
        job(inputs, colour=1)
    spark.createDataFrame([(1, 0, 0, 3, 3), (1, 0, 0, 4, 4)], "n int, top int, lft int, bottom int, rght int").write.parquet(str(inputs / "twice"))
    with pytest.raises(ValueError, match="numbers of their own"):
        region_growth.boxes(spark, region_growth.Settings(**{**job(inputs).__dict__, "regions": str(inputs / "twice")}))
    spark.createDataFrame([], "n int, top int, lft int, bottom int, rght int").write.parquet(str(inputs / "none"))
    with pytest.raises(ValueError, match="no region"):
        region_growth.run(spark, region_growth.Settings(**{**job(inputs).__dict__, "regions": str(inputs / "none")}))


def test_an_empty_table_gives_an_empty_output(spark, inputs):
    spark.createDataFrame([], "image_id int, t int, c int, z int, y int, x int, v double").write.parquet(str(inputs / "dark"))
    s = region_growth.Settings(**{**job(inputs).__dict__, "input": str(inputs / "dark")})
    assert region_growth.run(spark, s)["rows_written"] == 0


def test_the_shipped_configuration_and_the_command_line(inputs, monkeypatch):
    seen = []

    class Session:
        builder = property(lambda self: self)
        appName = lambda self, name: self
        getOrCreate = lambda self: self
        stop = lambda self: seen.append("stopped")

    monkeypatch.setattr(common, "SparkSession", Session())
    common.command_line("region_growth", region_growth.Settings, lambda spark, s: seen.append(s) or {}, ("input", "regions", "output"), ["--input", "elsewhere"])
    assert seen[0].input == "elsewhere" and seen[0].output == common.shipped("region_growth")["output"] and seen[1] == "stopped"
    (inputs / "own.json").write_text(json.dumps(common.shipped("region_growth") | {"angle": 30.0}))
    common.command_line("region_growth", region_growth.Settings, lambda spark, s: seen.append(s) or {}, ("input",), ["--config", str(inputs / "own.json")])
    assert seen[2].angle == 30.0


def test_voxels_are_measured_where_the_crops_were_dealt(spark, inputs, volumes):
    s = job(inputs)
    regions = region_growth.boxes(spark, s)
    cropped = region_growth.crop.packed_crops(region_growth.voxels(spark, s), s.acquisition, regions, places=6).repartition(*region_growth.SLICE).persist()
    try:
        assert cropped.count() == len(volumes) * len(regions)  # a row for each block of a region, not for each voxel
        plan = region_growth.growth(cropped, {k: 200 for k in regions}, (1.0, 1.0, 1.0))
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        cropped.unpersist()
    _, inner = text.split("InMemoryRelation")[0].split("Generate inline")
    assert "Exchange" not in inner  # the arrays stay where they are


def test_means_do_not_hang_on_the_order_of_rows(spark):
    values = np.round(np.random.default_rng(2).random(4000) * 300, 6)
    want = sum(int(round(v * 10**6)) for v in values) / 10**6 / len(values)
    for order in (values, values[::-1], np.sort(values)):
        rows = spark.createDataFrame([(float(v),) for v in order], "v double").coalesce(1)
        assert rows.agg(region_growth.filters.exact_mean(rows.v).alias("m")).first().m == pytest.approx(want, rel=1e-15)
