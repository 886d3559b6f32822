import struct

import numpy as np
import pyarrow as pa
import pytest

from obliqua.sources import bdv, czi, images, reader
from obliqua.sources.volume import complete_frames


def segment(name, data):
    return struct.pack("<16sqq", name.encode(), len(data), len(data)) + data


def packed(pixels, how):
    """Bytes of a plane: plain (0), zstd (5), zstd with a head (6), or with low bytes before high ones (-6)."""
    raw = pixels.astype("<u2")
    if how == 0:
        return raw.tobytes()
    mixed = raw.view(np.uint8).reshape(-1, 2).T.tobytes() if how == -6 else raw.tobytes()
    return {5: b"", 6: b"\x01", -6: b"\x03\x01\x01"}[how] + pa.compress(mixed, codec="zstd", asbytes=True)


def write_czi(path, planes, xml=b"", how=0):
    """A file of planes: {(scene, t, c, z, y, x): pixels}, all packed one way; returns where each plane's bytes lie."""
    def entry(key, pixels, position):
        axes = [(k, v, 1) for k, v in zip("STCZ", key[:4], strict=True)] + [("Y", key[4], pixels.shape[0]), ("X", key[5], pixels.shape[1])]
        body = struct.pack("<2siqii", b"DV", 1, position, 0, abs(how)) + bytes(6) + struct.pack("<i", len(axes))
        return body + b"".join(struct.pack("<4siifi", k.encode(), start, size, 0.0, size) for k, start, size in axes)

    out, entries, places = bytearray(32 + 512), [], {}
    for key, pixels in planes.items():
        position = len(out)
        one = entry(key, pixels, position)
        raw = packed(pixels, how)
        head = struct.pack("<iiq", 3, 0, len(raw)) + one
        out += segment("ZISRAWSUBBLOCK", head.ljust(256, b"\0") + b"<m>" + raw)
        places[key] = (len(out) - len(raw), len(out))
        entries.append(one)
    about = len(out)
    out += segment("ZISRAWMETADATA", struct.pack("<ii", len(xml), 0).ljust(256, b"\0") + xml)
    where = len(out)
    out += segment("ZISRAWDIRECTORY", struct.pack("<i", len(entries)).ljust(128, b"\0") + b"".join(entries))
    out[:544] = segment("ZISRAWFILE", (bytes(52) + struct.pack("<qq", where, about)).ljust(512, b"\0"))
    path.write_bytes(out)
    return places


def test_czi_planes_drift_over_one_canvas(spark, tmp_path):
    r = np.random.default_rng(0)
    planes = {(2, t, 0, z, 0, dx): r.integers(1, 99, (12, 20)) for t, dx in enumerate((5, 0, 2)) for z in range(4)}
    planes[1, 0, 0, 0, 0, 0] = r.integers(1, 9, (3, 3))
    path = tmp_path / "a.czi"
    write_czi(path, planes, b'<I><Dimensions><Channels><Channel Name="green"/></Channels></Dimensions></I>')
    about = czi.describe(str(path), 1)
    assert (about.size_t, about.size_z, about.size_y, about.size_x, about.channel_names, about.scene) == (3, 4, 12, 25, ("green",), 2)
    got = {(v["t"], v["z"], v["y"], v["x"]): v["v"] for v in reader.open_image(spark, str(path), 1).voxels.collect()}
    want = {(k[1], k[3], y, x + k[5]): float(p[y, x]) for k, p in planes.items() if k[0] == 2 for y in range(12) for x in range(20)}
    assert got == want
    assert czi.describe(str(path), 2) is None
    opened = reader.open_image(spark, str(path), 1)
    assert opened.sizes == (3, 1, 4, 12, 25) and opened.planes.count() == 12
    whole = complete_frames(opened.voxels, 1, 4, opened.planes).select("t").distinct().count()
    assert whole == 3
    del planes[2, 2, 0, 3, 0, 2]  # the last time is short of a plane
    write_czi(path, planes)
    opened = reader.open_image(spark, str(path), 1)
    assert {r["t"] for r in complete_frames(opened.voxels, 1, 4, opened.planes).select("t").distinct().collect()} == {0, 1}
    (tmp_path / "b.czi").write_bytes(b"no")
    assert czi.describe(str(tmp_path / "b.czi")) is None


def test_xml_as_mappings():
    assert czi.xml_tree("<a k='1'><b>x</b><b>y</b><c/></a>") == {"a": {"@k": "1", "b": ["x", "y"], "c": None}}


def test_point_spread_functions(tmp_path):
    path = str(tmp_path / "psf.tif")
    psf = np.random.default_rng(0).random((1, 1, 5, 6, 7))
    images.write_tiff(path, iter(psf[0, 0]), psf.shape, "float32", (1, 1, 1))
    assert images.read_psf(path, 4).shape == (8, 8, 8)


def test_pyramid_levels_and_setup():
    volume = np.arange(2 * 4 * 4).reshape(2, 4, 4)
    assert np.allclose(bdv.reduce(volume, (1, 2, 2))[0], [[2.5, 4.5], [10.5, 12.5]])
    assert bdv.reduce(volume, (2, 4, 4)).shape == (1, 1, 1)
    assert "<size>4 4 2</size>" in bdv.setup_xml("a.h5", (2, 4, 4), 1, 1, (1, 1, 1))
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(ValueError, match="h5py"):
            bdv.read("a.h5", 0, 0)
