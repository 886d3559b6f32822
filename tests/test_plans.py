import importlib.util
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from obliqua.__main__ import main, parser, settings_from
from obliqua.functions.geometry import Acquisition
from obliqua.operators import decon
from obliqua.operators.mip import project
from obliqua.plans.config import CropSettings, Settings, checked, merge
from obliqua.operators.estimate import Limits
from obliqua.plans.pipeline import Pipeline, open_settings, sized_errors, warn_if_large
from obliqua.plans.workflow import Workflow, table
from obliqua.sources import images, naming
from obliqua.sources.reader import open_image
from obliqua.streaming.projection import SCHEMA, read_planes, running_projection, start
from tests.test_operators import dense, frame


def settings(tmp_path, **changes):
    base = dict(input_image="", save_dir=str(tmp_path), size_t=1, size_c=1, size_z=10, size_y=14, size_x=9, pixel_sizes=(1.0, 1.0, 1.0), angle=45.0, frame="shear")
    return Settings(**{**base, **changes})


def blob():
    raw = np.zeros((10, 14, 9))
    raw[3:6, 5:9, 3:6] = 200
    return raw


def test_tiff_round_trip(tmp_path):
    planes = np.random.default_rng(0).integers(0, 999, (1, 2, 3, 5, 7))
    path = str(tmp_path / "a.ome.tif")
    images.write_tiff(path, (p for p in planes.reshape(-1, 5, 7)), planes.shape, "uint16", (2.0, 1.0, 1.0))
    assert (images.read_tiff(path) == planes.reshape(-1, 5, 7)).all()
    with pytest.raises(ValueError, match="plane"):
        images.write_tiff(path, iter([np.zeros((4, 4))]), planes.shape, "uint16", (1, 1, 1))


def test_zarr_chunks(tmp_path):
    import zlib

    planes = np.arange(2 * 3 * 4).reshape(2, 3, 4)
    images.write_zarr(str(tmp_path / "a.ome.zarr"), iter(planes), (1, 1, 2, 3, 4), "uint16", (1.0, 1.0, 1.0))
    meta = json.loads((tmp_path / "a.ome.zarr/0/.zarray").read_text())
    chunk = np.frombuffer(zlib.decompress((tmp_path / "a.ome.zarr/0/0/0/0/0/0").read_bytes()), meta["dtype"]).reshape(meta["chunks"])
    assert (chunk[0, 0] == planes).all()


@pytest.mark.parametrize("kind", ["tiff", "omezarr"])
def test_images_open_with_their_metadata(spark, tmp_path, kind):
    raw = np.random.default_rng(2).integers(0, 99, (2, 2, 3, 5, 70)).astype(float)
    path = str(tmp_path / f"a.ome.{'tif' if kind == 'tiff' else 'zarr'}")
    images.WRITERS[kind](path, iter(raw.reshape(-1, 5, 70)), raw.shape, "uint16", (0.5, 0.25, 0.25))
    made, opened = open_settings(spark, {"input_image": path, "save_dir": str(tmp_path), "angle": 40.0})
    assert (opened.sizes, made.dtype, made.pixel_sizes, made.size_x, made.angle) == ((2, 2, 3, 5, 70), "uint16", (0.5, 0.25, 0.25), 70, 40.0)
    got = np.zeros(raw.shape)
    for v in opened.voxels.collect():
        got[v["t"], v["c"], v["z"], v["y"], v["x"]] = v["v"]
    assert (got == raw).all()
    assert Pipeline(spark, made).process().count() > 0


@pytest.mark.parametrize("kind", ["tiff", "omezarr"])
def test_files_of_many_tasks_equal_the_voxels(spark, tmp_path, kind):
    raw = np.random.default_rng(3).integers(0, 9, (2, 2, 70, 3, 4)).astype(float)
    raw[1, 0] = raw[0, 1, 3:9] = 0
    whole = None
    for t in range(2):
        for c in range(2):
            one = frame(spark, raw[t, c], t).withColumn("c", F.lit(c))
            whole = one if whole is None else whole.unionByName(one)
    path = str(tmp_path / f"a.ome.{'tif' if kind == 'tiff' else 'zarr'}")
    status = images.save_groups(whole.withColumn("roi_index", F.lit(0)), ["roi_index"], kind, {(0,): path}, {(0,): raw.shape[2:]}, 2, 2, "uint16", (1.0, 1.0, 1.0)).collect()
    assert [(r["path"], r["error"]) for r in status] == [(path, None)]
    got = np.zeros(raw.shape)
    for v in open_image(spark, path).voxels.collect():
        got[v["t"], v["c"], v["z"], v["y"], v["x"]] = v["v"]
    assert (got == raw).all()


def test_names_that_are_taken_stay(spark, tmp_path):
    run = Pipeline(spark, settings(tmp_path, save_type="tiff"), frame(spark, blob()))
    first, second = run.save().first()["path"], run.save().first()["path"]
    assert first != second and images.read_tiff(first).shape == images.read_tiff(second).shape


def test_crops_have_a_sidecar_each(spark, tmp_path):
    regions = tmp_path / "r.csv"
    regions.write_text("index,axis-0,axis-1\n" + "".join(f"{k},{y + 3 * k},{x}\n" for k in (0, 1) for y, x in ((6, 2), (6, 8), (12, 8), (12, 2))))
    run = Pipeline(spark, settings(tmp_path, crop=CropSettings(str(regions))), frame(spark, blob()))
    run.save()
    origins = [json.loads((tmp_path / f"image_deskewed_ROI_{k}.lattice.json").read_text())["output"]["origin_zyx_px"][1] for k in (0, 1)]
    assert origins[1] - origins[0] == 3


def test_workflow_results_are_saved(spark, tmp_path):
    flow = {"mask": ["threshold", "deskewed_image", 50.0], "labels": ["label", "mask"], "out": ["regionprops", "labels"]}
    rows = Pipeline(spark, settings(tmp_path, workflow=flow), frame(spark, blob())).save_workflow().collect()
    assert [r["path"].rpartition(".")[2] for r in rows] == ["csv"]
    head, line = (tmp_path / "image_deskewed_ROI_0_output_0.csv").read_text().splitlines()[:2]
    assert head.startswith("time,channel,label,area,centroid-0") and line.startswith("T0,C0,1")
    rows = Pipeline(spark, settings(tmp_path, workflow={"mask": ["threshold", "deskewed_image", 50.0]}, save_type="tiff"), frame(spark, blob())).save_workflow().collect()
    assert len(rows) == 1 and images.read_tiff(rows[0]["path"]).max() == 1


def test_deconvolution_takes_off_a_background_and_no_more_than_the_crop(spark, tmp_path):
    psf = np.zeros((1, 1, 3, 3, 3))
    psf[0, 0, 1, 1, 1] = 1
    path, regions = str(tmp_path / "psf.tif"), tmp_path / "r.csv"
    images.write_tiff(path, iter(psf[0, 0]), psf.shape, "float32", (1, 1, 1))
    regions.write_text("index,axis-0,axis-1\n" + "".join(f"0,{y},{x}\n" for y, x in ((6, 2), (6, 8), (16, 8), (16, 2))))
    for extra in ({}, {"crop": CropSettings(str(regions))}):
        plain = Pipeline(spark, settings(tmp_path, **extra), frame(spark, np.maximum(blob() - 20, 0)))
        less = Pipeline(spark, settings(tmp_path, deconvolution={"psf": (path,), "iterations": 3, "background": 20.0}, **extra), frame(spark, blob()))
        want, got = ({tuple(r[k] for k in "zyx"): r["v"] for r in p.process().collect() if r["v"] > 1} for p in (plain, less))
        assert set(want) == set(got) and all(abs(want[k] - got[k]) <= 1 for k in want)
    assert decon.plane_medians(frame(spark, np.array([[[0, 3.0], [5, 9]]])), 4).first()["median"] == 4.0


@pytest.mark.parametrize("kind", ["tiff", "omezarr", "parquet"])
def test_pipeline_saves_and_leaves_a_sidecar(spark, tmp_path, kind):
    raw = blob()
    run = Pipeline(spark, settings(tmp_path, save_type=kind), frame(spark, raw))
    rows = run.save().collect()
    assert [r["error"] for r in rows] == [None]
    document = json.loads((tmp_path / "image_deskewed.lattice.json").read_text() if kind == "parquet" else (tmp_path / "image_deskewed_ROI_0.lattice.json").read_text())
    assert document["config"]["angle"] == 45.0
    if kind == "tiff":
        assert np.allclose(images.read_tiff(rows[0]["path"]), dense(run.process(), run.settings.acquisition.output_shape))


def test_crop_workflow_and_projection(spark, tmp_path):
    regions = tmp_path / "r.csv"
    regions.write_text("index,axis-0,axis-1\n" + "".join(f"0,{y},{x}\n" for y, x in ((6, 2), (6, 8), (16, 8), (16, 2))))
    flow = {"mask": ["threshold", "deskewed_image", 50.0], "labels": ["label", "mask"], "out": ["regionprops", "labels"]}
    run = Pipeline(spark, settings(tmp_path, crop=CropSettings(str(regions)), workflow=flow), frame(spark, blob()))
    pixels, measured = run.process_workflow()
    assert pixels.count() == 0
    assert {r["name"] for r in measured.collect()} >= {"label", "area"}
    assert {r["time"] for r in measured.collect()} == {"T0"}
    flat = Pipeline(spark, settings(tmp_path, mip=True), frame(spark, blob())).process()
    assert {r["z"] for r in flat.collect()} == {0}
    assert run.estimate().count() == 1


def test_workflows_are_checked():
    with pytest.raises(ValueError, match="one last task"):
        Workflow().set("a", "threshold", "deskewed_image").set("b", "threshold", "deskewed_image").leaf()
    with pytest.raises(ValueError, match="no task takes"):
        Workflow().set("a", "threshold", 3).leaf()
    with pytest.raises(ValueError, match="registered"):
        Workflow().set("a", "os.system", "deskewed_image")
    assert list(table({"a": [1, 2], "b": 3}, "T0", "C1").columns) == ["time", "channel", "a", "b"]
    assert len(table([1, 2, 3], "T0", "C0")) == 1
    assert table(5, "T0", "C0")["0"].tolist() == [5]


def test_settings_are_checked(tmp_path):
    with pytest.raises(ValueError, match="has no"):
        checked(Settings, {"nonsense": 1})
    with pytest.raises(ValueError, match="twice"):
        merge({"angle": 1}, {"angle": 2})
    assert merge({"crop": {"a": 1}}, {"crop": {"b": 2}}) == {"crop": {"a": 1, "b": 2}}
    with pytest.raises(ValueError, match="outside"):
        settings(tmp_path, time_range=(0, 4))
    with pytest.raises(ValueError):
        settings(tmp_path).copy_with(skew="Q")
    if importlib.util.find_spec("h5py") is None:
        with pytest.raises(ValueError, match="h5py"):
            settings(tmp_path, save_type="h5")
    assert settings(tmp_path).name == settings(tmp_path, save_name="image_deskewed").name == "image_deskewed"


def test_command_line(tmp_path, capsys):
    document = tmp_path / "c.json"
    document.write_text(json.dumps({"input_image": "a", "save_dir": "b", "size_t": 1, "size_c": 1, "size_z": 4, "size_y": 5, "size_x": 6}))
    made = checked(Settings, settings_from(parser().parse_args(["process", "--config", str(document), "--angle", "40", "--roi-files", "x.csv"])))
    assert (made.angle, made.crop.roi_files) == (40.0, ("x.csv",))
    assert main(["--show-schema"]) == 0
    assert "angle" in json.loads(capsys.readouterr().out)
    assert main(["process", "--config", str(document), "--size-t", "2"]) == 2


def test_memory_warnings_and_errors():
    a = Acquisition(4, 5, 6)
    with pytest.warns(UserWarning, match="deskewed volume"):
        assert warn_if_large(a, "uint16", Limits(host_free=10))
    assert not warn_if_large(a, "uint16", Limits(host_free=10))
    with pytest.raises(MemoryError, match="deskewed size"), sized_errors(a):
        raise RuntimeError("java.lang.OutOfMemoryError: heap")
    with pytest.raises(KeyError), sized_errors(a):
        raise KeyError("other")


def test_names(tmp_path):
    assert naming.suffix("a", 1, None, 3) == "a_ROI_1_T3"
    assert naming.stem("sample.v2_deskewed.ome.tif") == "sample.v2_deskewed"
    for name in ("n.csv", "n_1.csv"):
        (tmp_path / name).write_text("")
    assert naming.free_path(str(tmp_path), "n", "csv").name == "n_1_2.csv"


def test_running_projection_equals_the_batch(spark, tmp_path):
    a = Acquisition(4, 6, 3, 1.0, 1.0, 1.0, 30.0, "Y", "objective")
    raw = np.random.default_rng(1).integers(1, 50, (4, 6, 3)).astype(float)
    folder = str(tmp_path / "planes")
    for z in range(4):
        frame(spark, raw).filter(f"z = {z}").select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.mode("append").parquet(folder)
    query = start(running_projection(read_planes(spark, folder, 1), a), "projection_so_far")
    query.processAllAvailable()
    query.stop()
    got = {tuple(r) for r in spark.table("projection_so_far").collect()}
    assert got == {tuple(r) for r in project(frame(spark, raw), a).collect()}
