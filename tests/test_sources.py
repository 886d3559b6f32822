"""The data source of image files: the same voxels as the file holds, and no piece opened outside the ranges of a query."""

import json
import struct
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual

from obliqua.functions.geometry import Acquisition
from obliqua.plans.config import CropSettings, Settings
from obliqua.plans.pipeline import Pipeline
from obliqua.sources import codecs, images
from obliqua.sources.datasource import ImageReader
from obliqua.sources.layouts import read_psf
from obliqua.sources.reader import layers, open_image, open_scenes
from tests.test_files import write_czi

SHAPE = (3, 2, 9, 20, 16)
VALUES = np.random.default_rng(4).integers(0, 60, SHAPE)


def striped_tiff(path, planes, rows):
    """A classic little-endian TIFF of plain strips of so many lines, one page a plane."""
    out, link = bytearray(b"II" + struct.pack("<HI", 42, 0)), 4
    for plane in planes:
        height, width = plane.shape
        strips = [plane[y : y + rows].astype("<u2").tobytes() for y in range(0, height, rows)]
        offsets = []
        for s in strips:
            offsets.append(len(out))
            out += s
        lists = len(out)
        out += struct.pack(f"<{2 * len(strips)}I", *offsets, *map(len, strips))
        entries = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, 16), (259, 3, 1, 1), (273, 4, len(strips), lists), (277, 3, 1, 1), (278, 4, 1, rows), (279, 4, len(strips), lists + 4 * len(strips)), (339, 3, 1, 1)]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries)
        link = len(out)
        out += struct.pack("<I", 0)
    Path(path).write_bytes(out)


def zarr(path, how, chunks=(1, 1, 2, 8, 5)):
    """An OME-Zarr group written by hand, its chunks packed by ``how``."""
    images.start_zarr(str(path), SHAPE, "uint16", (1.0, 1.0, 1.0))
    about = json.loads((path / "0/.zarray").read_text()) | {"chunks": list(chunks), "compressor": {"id": how} if how else None, "dimension_separator": "."}
    (path / "0/.zarray").write_text(json.dumps(about))
    pack = {None: bytes, "zlib": zlib.compress, "gzip": lambda b: zlib.compress(b, wbits=31), "blosc": lambda b: codecs.blosc_pack(b, 2, block=64), "zstd": lambda b: pa.compress(b, codec="zstd", asbytes=True)}[how]
    for at in np.ndindex(*[-(-n // k) for n, k in zip(SHAPE, chunks, strict=True)]):
        full = np.zeros(chunks, "<u2")
        part = VALUES[tuple(slice(a * k, (a + 1) * k) for a, k in zip(at, chunks, strict=True))]
        full[tuple(slice(0, n) for n in part.shape)] = part
        (path / "0" / ".".join(map(str, at))).write_bytes(pack(full.tobytes()))


KINDS = ["czi", "czi zstd", "czi zstd head", "czi zstd low bytes first", "tiff", "zarr plain", "zarr zlib", "zarr gzip", "zarr blosc", "zarr zstd"]


@pytest.fixture(scope="module", params=KINDS)
def file(request, tmp_path_factory):
    folder, kind = tmp_path_factory.mktemp("image"), request.param
    if kind.startswith("czi"):
        path = folder / "a.czi"
        write_czi(path, {(0, t, c, z, 0, 0): VALUES[t, c, z] for t, c, z in np.ndindex(*SHAPE[:3])}, how=dict(zip(KINDS, (0, 5, 6, -6)))[kind])
    elif kind == "tiff":
        path = folder / "a.ome.tif"
        images.write_tiff(str(path), iter(VALUES.reshape(-1, *SHAPE[3:])), SHAPE, "uint16", (1.0, 1.0, 1.0))
    else:
        path = folder / "a.ome.zarr"
        zarr(path, kind.split()[1] if "plain" not in kind else None)
    return str(path)


def dense(voxels):
    out = np.zeros(SHAPE)
    for r in voxels.collect():
        out[r.t, r.c, r.z, r.y, r.x] = r.v
    return out


def test_all_voxels_and_ranges_of_them(spark, file):
    opened = open_image(spark, file)
    assert opened.sizes == SHAPE and opened.dtype == "uint16"
    assert (dense(opened.voxels) == VALUES).all()
    want = np.zeros(SHAPE)
    want[1, :, 2:5, 7:11, 3:] = VALUES[1, :, 2:5, 7:11, 3:]
    cut = opened.voxels.filter("t = 1 and z >= 2 and z < 5 and y > 6 and y <= 10 and x >= 3 and v > 0")
    assert (dense(cut) == want).all()
    odd = opened.voxels.filter("t in (0, 2) and z between 1 and 1 and (y = 3 or x = 2) and c is not null")
    want = np.zeros(SHAPE)
    want[::2, :, 1, 3], want[::2, :, 1, :, 2] = VALUES[::2, :, 1, 3], VALUES[::2, :, 1, :, 2]
    assert (dense(odd) == want).all()
    for none in ("t = 7", "t = -1", "image_id = 4", "z > 3 and z < 2", "x >= 16"):
        assert opened.voxels.filter(none).count() == 0
    assert open_image(spark, file, image_id=9).voxels.filter("image_id = 9 and t = 0 and c = 0 and z = 0").count() == (VALUES[0, 0, 0] > 0).sum()


def opened_pieces(reader):
    layout = reader.layout()
    return sum(layout.count(task.work) for task in reader.partitions())


def test_filters_choose_the_pieces(file):
    def reader(*filters):
        one = ImageReader({"path": file, "task_bytes": "700"})
        return one, one.pushFilters(list(filters))

    whole, left = reader()
    zarr_file = file.endswith(".zarr")
    assert opened_pieces(whole) == (3 * 2 * 5 * 3 * 4 if zarr_file else 54) and not left and len(whole.partitions()) > 10
    one, left = reader(EqualTo(("t",), 1), IsNotNull(("z",)), GreaterThan(("z",), 1), LessThanOrEqual(("z",), 3), GreaterThanOrEqual(("y",), 8), LessThan(("y",), 16), EqualTo(("image_id",), 0), EqualTo(("v",), 3.0))
    assert [type(f).__name__ for f in left] == ["EqualTo"]
    assert opened_pieces(one) == (2 * 1 * 1 * 4 if zarr_file else 4)
    some, left = reader(In(("t",), (0, 2)))
    assert len(left) == 1 and opened_pieces(some) == opened_pieces(whole)
    assert reader(EqualTo(("t",), 5))[0].partitions() == [] == reader(EqualTo(("image_id",), 5))[0].partitions()


@pytest.mark.parametrize("kind", ["czi", "czi zstd", "zarr"])
@pytest.mark.parametrize("flip", [False, True])
def test_a_run_over_one_time_and_a_small_crop_opens_nothing_else(spark, tmp_path, kind, flip):
    """All pieces but those behind the crop are spoilt: a run that opened one of them would fail or differ."""
    path, out = tmp_path / f"a.{kind.split()[0]}", tmp_path / "out"
    settings = dict(save_dir=str(out), size_t=3, size_c=2, size_z=9, size_y=20, size_x=16, pixel_sizes=(1.0, 1.0, 1.0), angle=45.0, frame="shear", time_range=(1, 2), invert_scan=flip)
    regions = tmp_path / "r.csv"
    regions.write_text("index,axis-0,axis-1\n" + "".join(f"0,{y},{x}\n" for y, x in ((4, 2), (4, 5), (7, 5), (7, 2))))
    crop = CropSettings(str(regions), z_range=(0, 1))
    table = str(tmp_path / "t.parquet")
    rows = [(0, *map(int, at), float(VALUES[tuple(at)])) for at in np.argwhere(VALUES)]
    spark.createDataFrame(rows, "image_id int, t int, c int, z int, y int, x int, v double").write.parquet(table)
    want = Pipeline(spark, Settings(input_image=table, crop=crop, **settings)).process().collect()
    box = next(iter(Pipeline(spark, Settings(input_image=table, crop=crop, **settings)).boxes().values()))
    from obliqua.functions.geometry import safe_raw_box

    raw = safe_raw_box(Acquisition(9, 20, 16, 1.0, 1.0, 1.0, 45.0, "Y", "shear"), box)
    z = {8 - k if flip else k for k in range(*raw.z)}
    assert len(z) < 9
    if kind == "zarr":
        zarr(path, "zlib", (1, 1, 1, 20, 16))
        for f in (path / "0").glob("[0-9]*"):
            t, _, k, _, _ = map(int, f.name.split("."))
            if t != 1 or k not in z:
                f.write_bytes(b"spoilt")
    else:
        places = write_czi(path, {(0, t, c, k, 0, 0): VALUES[t, c, k] for t, c, k in np.ndindex(*SHAPE[:3])}, how=0 if kind == "czi" else 5)
        data = bytearray(path.read_bytes())
        for (_, t, _, k, _, _), (a, b) in places.items():
            if t != 1 or k not in z:
                data[a:b] = b"\xff" * (b - a)
        path.write_bytes(data)
    got = Pipeline(spark, Settings(input_image=str(path), crop=crop, **settings)).process().collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_only_the_strips_of_a_page_that_are_needed_are_read(spark, tmp_path):
    path = str(tmp_path / "s.tif")
    planes = VALUES[0, 0]
    striped_tiff(path, planes, 3)
    page = images.tiff_pages(path)[0][2]
    assert page["rows"] == 3 and len(page["offsets"]) == 7
    first, lines = images.read_lines(path, page, 7, 11)
    assert first == 6 and (lines == planes[2, 6:12]).all()
    assert (images.read_page(path, page) == planes[2]).all()
    got = {(r.z, r.y, r.x): r.v for r in open_image(spark, path).voxels.filter("y = 19").collect()}
    assert got == {(z, 19, x): planes[z, 19, x] for z in range(9) for x in range(16) if planes[z, 19, x]}


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=700), st.sampled_from([1, 2, 4, 8, 3]), st.sampled_from(["zstd", "zlib"]), st.sampled_from([16, 64, 1 << 18]))
def test_blosc_frames_come_back(data, item, codec, block):
    frame = codecs.blosc_pack(data, item, codec, block)
    assert codecs.blosc_unpack(frame) == data
    with pytest.raises(ValueError):
        codecs.blosc_unpack(frame[:-1])


def blosc_frame(data, item, codec, number, flags, block, streams):
    """A frame as other writers make them, with blocks cut into one stream for each byte of an item."""
    blocks = []
    for at in range(0, len(data), block):
        raw = np.frombuffer(data[at : at + block], np.uint8)
        cut = streams if len(raw) == block else 1
        mixed = codecs.shuffle(raw, item) if flags & 1 else raw
        each = len(raw) // cut
        made = b""
        for k in range(cut):
            part = mixed[k * each : (k + 1) * each].tobytes()
            small = pa.compress(part, codec=codec, asbytes=True)
            small = part if len(small) >= len(part) else small
            made += struct.pack("<i", len(small)) + small
        blocks.append(made)
    starts, at = [], 16 + 4 * len(blocks)
    for b in blocks:
        starts.append(at)
        at += len(b)
    return struct.pack("<BBBBIII", 2, 1, flags | number << 5, item, len(data), block, at) + struct.pack(f"<{len(starts)}I", *starts) + b"".join(blocks)


@pytest.mark.parametrize("codec,number", [("lz4_raw", 1), ("snappy", 2), ("zstd", 4)])
def test_blosc_blocks_of_several_streams(codec, number):
    data = np.random.default_rng(1).integers(0, 300, 1500).astype("<u2").tobytes()
    for block, streams in ((512, 2), (128, 1), (4096, 1)):  # a block of fewer than 128 items is one stream
        for flags in (0, 1):
            assert codecs.blosc_unpack(blosc_frame(data, 2, codec, number, flags, block, streams)) == data
    assert codecs.blosc_unpack(struct.pack("<BBBBIII", 2, 1, 2, 2, 5, 5, 21) + b"plain") == b"plain"
    with pytest.raises(ValueError, match="blosclz"):
        codecs.blosc_unpack(blosc_frame(b"a" * 600, 2, "zstd", 0, 16, 600, 1))


def test_bits_are_put_back():
    items = np.random.default_rng(0).integers(0, 1 << 16, 19).astype("<u2")
    whole = items[:16]
    planes = np.stack([(whole >> k) & 1 for k in range(16)]).astype(np.uint8)
    mixed = np.concatenate([np.packbits(planes.reshape(-1), bitorder="little"), items[16:].view(np.uint8)])
    assert (codecs.bit_unshuffle(mixed, 2).view("<u2") == items).all()


def test_other_packings_are_refused(spark, tmp_path):
    path = tmp_path / "a.zarr"
    zarr(path, None)
    about = json.loads((path / "0/.zarray").read_text())
    (path / "0/.zarray").write_text(json.dumps(about | {"compressor": {"id": "lzma"}}))
    with pytest.raises(ValueError, match="not read"):
        open_image(spark, str(path))


def scenes(path, names, second=(9, 8)):
    """Two scenes of two channels, the second of a given size."""
    r = np.random.default_rng(6)
    planes = {(s, 0, c, z, 0, 0): r.integers(1, 50, (9, 8) if s == 3 else second) for s in (3, 8) for c in range(2) for z in range(4)}
    write_czi(path, planes, f"<I><Dimensions><Channels>{''.join(f'<Channel Name=\"{n}\"/>' for n in names)}</Channels></Dimensions></I>".encode() if names else b"")
    return planes


def test_scenes_are_images_of_one_table(spark, tmp_path):
    planes = scenes(tmp_path / "a.czi", ("red", "green"))
    opened = open_scenes(spark, str(tmp_path / "a.czi"))
    assert opened.sizes == (1, 2, 4, 9, 8) and not opened.one_image and opened.planes.count() == 16
    got = {(r.image_id, r.c, r.z, r.y, r.x): r.v for r in opened.voxels.collect()}
    assert got == {(int(k[0] == 8), k[2], k[3], y, x): float(p[y, x]) for k, p in planes.items() for y in range(9) for x in range(8)}
    made = dict(save_dir=str(tmp_path), size_t=1, size_c=2, size_z=4, size_y=9, size_x=8, pixel_sizes=(1.0, 1.0, 1.0), angle=45.0, frame="shear", save_type="tiff")
    rows = Pipeline(spark, Settings(input_image=str(tmp_path / "a.czi"), **made), opened).save().collect()
    assert sorted(r["image_id"] for r in rows) == [0, 1] and all(images.read_tiff(r["path"]).any() for r in rows)
    scenes(tmp_path / "b.czi", (), second=(5, 8))
    with pytest.raises(ValueError, match="scenes .1. differ"):
        open_scenes(spark, str(tmp_path / "b.czi"))


def test_layers_have_the_names_of_scenes_and_channels(spark, tmp_path):
    scenes(tmp_path / "a.czi", ("red", "green"))
    found = layers(spark, str(tmp_path / "a.czi"))
    assert [(x.name, x.channel) for x in found] == [("3 - red", 0), ("3 - green", 1), ("8 - red", 0), ("8 - green", 1)]
    assert found[3].voxels.select("image_id", "c").distinct().collect() == [(1, 1)] and found[0].scale == (1.0, 1.0, 1.0)
    scenes(tmp_path / "b.czi", ())
    assert [(x.name, x.channel) for x in layers(spark, str(tmp_path / "b.czi"))] == [("b - 3", None), ("b - 8", None)]
    path = str(tmp_path / "c.ome.tif")
    images.write_tiff(path, iter(VALUES[:1].reshape(-1, 20, 16)), (1, 2, 9, 20, 16), "uint16", (0.5, 0.1, 0.1), ["one", "two"])
    assert [(x.name, x.scale) for x in layers(spark, path)] == [("one", (0.5, 0.1, 0.1)), ("two", (0.5, 0.1, 0.1))]


def test_point_spread_functions_of_other_files_are_padded(tmp_path):
    psf = np.random.default_rng(0).integers(1, 99, (5, 18, 7))
    write_czi(tmp_path / "psf.czi", {(0, t, c, z, 0, 0): psf[z] * (1 + t + c) for t in range(2) for c in range(2) for z in range(5)}, how=6)
    got = read_psf(str(tmp_path / "psf.czi"))
    assert got.shape == (16, 32, 16) and (got[:5, :18, :7] == psf).all() and (got[5, :18, :7] == psf[3]).all()
    images.write_zarr(str(tmp_path / "psf.zarr"), iter(psf), (1, 1, 5, 18, 7), "uint16", (1, 1, 1), packing="blosc")
    assert (read_psf(str(tmp_path / "psf.zarr")) == got).all()
    images.write_tiff(str(tmp_path / "psf.tif"), iter(psf), (1, 1, 5, 18, 7), "uint16", (1, 1, 1))
    assert read_psf(str(tmp_path / "psf.tif")).shape == psf.shape
