"""Several images in one table, backgrounds with and without a crop, and workflows that run once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from obliqua.functions.geometry import Acquisition
from obliqua.plans.config import CropSettings
from obliqua.plans.pipeline import Pipeline
from obliqua.plans.workflow import FUNCTIONS
from obliqua.sources import images
from obliqua.sources.reader import open_image
from tests.test_operators import dense, frame
from tests.test_plans import blob, settings


def square(tmp_path, name="r.csv", y=(6, 12), x=(2, 8)):
    path = tmp_path / name
    path.write_text("index,axis-0,axis-1\n" + "".join(f"0,{a},{b}\n" for a, b in ((y[0], x[0]), (y[0], x[1]), (y[1], x[1]), (y[1], x[0]))))
    return CropSettings(str(path))


def two(spark):
    """Image 3 and image 7, the second twice as bright and of another form."""
    other = np.zeros((10, 14, 9))
    other[2:8, 4:10, 1:4] = 100
    return frame(spark, blob()).withColumn("image_id", F.lit(3)).unionByName(frame(spark, other).withColumn("image_id", F.lit(7))), {3: blob(), 7: other}


def apart(spark, tmp_path, **extra):
    """Each image's result when it is run alone."""
    return {m: dense(Pipeline(spark, settings(tmp_path, **extra), frame(spark, raw)).process(), shape(tmp_path, **extra)) for m, raw in two(spark)[1].items()}


def shape(tmp_path, **extra):
    made = settings(tmp_path, **extra)
    return made.acquisition.output_shape if made.crop is None else (made.acquisition.output_shape[0], 6, 6)


@pytest.mark.parametrize("kind", ["tiff", "omezarr"])
@pytest.mark.parametrize("cropped", [False, True])
def test_two_images_give_two_files(spark, tmp_path, kind, cropped):
    extra = {"crop": square(tmp_path)} if cropped else {}
    want = apart(spark, tmp_path, **extra)
    rows = Pipeline(spark, settings(tmp_path, save_type=kind, zarr_packing="blosc", **extra), two(spark)[0]).save().collect()
    assert sorted(r["image_id"] for r in rows) == [3, 7] and len({r["path"] for r in rows}) == 2
    for r in rows:
        assert f"image_{r['image_id']}_ROI_0" in r["path"] and (tmp_path / f"image_deskewed_image_{r['image_id']}_ROI_0.lattice.json").exists()
        assert (dense(open_image(spark, r["path"]).voxels, shape(tmp_path, **extra)) == want[r["image_id"]]).all()


def test_two_images_stay_apart_in_a_table(spark, tmp_path):
    want = apart(spark, tmp_path)
    path = Pipeline(spark, settings(tmp_path), two(spark)[0]).save().first()["path"]
    held = spark.read.parquet(path)
    assert all((dense(held.filter(F.col("image_id") == m), shape(tmp_path)) == want[m]).all() for m in want)


@pytest.mark.parametrize("mip", [False, True])
def test_one_image_keeps_its_name(spark, tmp_path, mip):
    rows = Pipeline(spark, settings(tmp_path, save_type="tiff", mip=mip), two(spark)[0].filter("image_id = 7")).save().collect()
    assert [(r["image_id"], r["path"].rpartition("/")[2]) for r in rows] == [(7, "image_deskewed_ROI_0.ome.tif")]


def test_workflows_keep_images_apart(spark, tmp_path):
    flow = {"mask": ["threshold", "deskewed_image", 50.0], "labels": ["label", "mask"], "out": ["regionprops", "labels"]}
    areas = {m: int((made >= 50).sum()) for m, made in apart(spark, tmp_path).items()}
    run = Pipeline(spark, settings(tmp_path, workflow=flow), two(spark)[0])
    got = {r["image_id"]: r["value"] for r in run.process_workflow()[1].filter("name = 'area'").collect()}
    assert got == areas and areas[3] != areas[7]
    rows = run.save_workflow().collect()
    assert sorted(r["path"].rpartition("/")[2] for r in rows) == [f"image_deskewed_image_{m}_ROI_0_output_0.csv" for m in (3, 7)]
    pictures = Pipeline(spark, settings(tmp_path, workflow={"mask": ["threshold", "deskewed_image", 50.0]}, save_type="tiff"), two(spark)[0]).save_workflow().collect()
    assert {r["image_id"]: int(images.read_tiff(r["path"]).sum()) for r in pictures} == areas


def test_a_workflow_runs_once_for_each_slice(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "log")

    def counted(image):
        with open(log, "a") as file:
            file.write("x")
        return (image > 50).astype(float), {"sum": [float(image.sum())]}

    monkeypatch.setitem(FUNCTIONS, "counted", counted)
    run = Pipeline(spark, settings(tmp_path, workflow={"out": ["counted", "deskewed_image"]}, save_type="tiff"), two(spark)[0])
    kept = set(spark.sparkContext._jsc.getPersistentRDDs())
    rows = run.save_workflow().collect()
    assert len(rows) == 4 and len(open(log).read()) == 2
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= kept


def psf(tmp_path):
    one = np.zeros((1, 1, 3, 3, 3))
    one[0, 0, 1, 1, 1] = 1
    path = str(tmp_path / "psf.tif")
    images.write_tiff(path, iter(one[0, 0]), one.shape, "float32", (1, 1, 1))
    return path


@pytest.mark.parametrize("word,plane", [("auto", -1), ("second_last", -2)])
@pytest.mark.parametrize("flip", [False, True])
@pytest.mark.parametrize("cropped", [False, True])
def test_backgrounds_are_of_the_whole_plane(spark, tmp_path, word, plane, flip, cropped):
    raw = blob() + np.random.default_rng(0).integers(90, 110, (10, 14, 9))
    turned = raw[::-1] if flip else raw
    median = float(np.median(turned[plane]))
    assert median > 50
    extra = {"crop": square(tmp_path)} if cropped else {}
    plain = Pipeline(spark, settings(tmp_path, invert_scan=flip, **extra), frame(spark, np.maximum(raw - median, 0)))
    less = Pipeline(spark, settings(tmp_path, invert_scan=flip, deconvolution={"psf": (psf(tmp_path),), "iterations": 3, "background": word}, **extra), frame(spark, raw))
    want, got = (dense(p.process(), shape(tmp_path, **extra)) for p in (plain, less))
    assert want.max() > 100 and np.abs(want - got).max() <= 1


def test_a_background_plane_without_voxels_is_dark(spark, tmp_path):
    less = Pipeline(spark, settings(tmp_path, deconvolution={"psf": (psf(tmp_path),), "iterations": 2, "background": "auto"}), frame(spark, blob()))
    plain = Pipeline(spark, settings(tmp_path), frame(spark, blob()))
    want, got = (dense(p.process(), shape(tmp_path)) for p in (plain, less))
    assert np.abs(want - got).max() <= 1 and Acquisition(10, 14, 9, 1.0, 1.0, 1.0, 45.0, "Y", "shear").output_shape == want.shape
