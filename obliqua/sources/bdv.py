"""BDV files (HDF5 and XML), where the h5py package is there: a pyramid of levels for each time and channel."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree as Xml

import numpy as np

LEVELS = ((1, 1, 1), (1, 2, 2), (2, 4, 4))


def _h5py():
    try:
        import h5py
    except ImportError as error:
        raise ValueError("BDV files need the h5py package") from error
    return h5py


def reduce(volume: np.ndarray, factors: tuple[int, int, int]) -> np.ndarray:
    """Means over blocks; a rest at a far end repeats its last voxel."""
    pads = [(0, -n % f) for n, f in zip(volume.shape, factors, strict=True)]
    full = np.pad(volume.astype(float), pads, mode="edge")
    z, y, x = (n // f for n, f in zip(full.shape, factors, strict=True))
    return full.reshape(z, factors[0], y, factors[1], x, factors[2]).mean((1, 3, 5))


def setup_xml(name: str, shape: tuple[int, int, int], times: int, channels: int, voxel: tuple[float, float, float]) -> str:
    root = Xml.Element("SpimData", version="0.2")
    sequence = Xml.SubElement(root, "SequenceDescription")
    loader = Xml.SubElement(sequence, "ImageLoader", format="bdv.hdf5")
    Xml.SubElement(loader, "hdf5", type="relative").text = name
    setups = Xml.SubElement(sequence, "ViewSetups")
    for c in range(channels):
        setup = Xml.SubElement(setups, "ViewSetup")
        for tag, text in (("id", c), ("name", f"channel {c}"), ("size", " ".join(map(str, shape[::-1])))):
            Xml.SubElement(setup, tag).text = str(text)
        size = Xml.SubElement(setup, "voxelSize")
        Xml.SubElement(size, "unit").text = "micrometer"
        Xml.SubElement(size, "size").text = " ".join(map(str, voxel[::-1]))
    points = Xml.SubElement(sequence, "Timepoints", type="range")
    Xml.SubElement(points, "first").text, Xml.SubElement(points, "last").text = "0", str(times - 1)
    return Xml.tostring(root, encoding="unicode")


def write(path: str, volumes: Iterator[np.ndarray], shape: tuple[int, int, int], times: int, channels: int, dtype: str, voxel: tuple[float, float, float], projection: bool = False) -> None:
    """Volumes in (t, c) order; times and channels number from 0; a projection's pyramid leaves out the level in z."""
    h5py = _h5py()
    levels = LEVELS[:2] if projection else LEVELS
    source = iter(volumes)
    with h5py.File(path, "w") as file:
        for t in range(times):
            for c in range(channels):
                volume = next(source)
                for k, factors in enumerate(levels):
                    file.create_dataset(f"t{t:05d}/s{c:02d}/{k}/cells", data=np.rint(reduce(volume, factors)).astype(dtype), compression="gzip", chunks=True)
        for c in range(channels):
            file[f"s{c:02d}/resolutions"] = np.array([f[::-1] for f in levels], float)
            file[f"s{c:02d}/subdivisions"] = np.array([[64, 64, 64]] * len(levels))
    with open(f"{path.removesuffix('.h5')}.xml", "w") as out:
        out.write(setup_xml(path.rpartition("/")[2], shape, times, channels, voxel))


def read(path: str, t: int, c: int) -> np.ndarray:
    """The finest level of one slice."""
    with _h5py().File(path, "r") as file:
        return file[f"t{t:05d}/s{c:02d}/0/cells"][()]


def describe(path: str) -> tuple[int, int, tuple[int, int, int], str]:
    """(times, channels, shape, type) of a file."""
    with _h5py().File(path, "r") as file:
        times = sorted(k for k in file if k.startswith("t"))
        cells = file[times[0]]
        first = cells[sorted(cells)[0]]["0/cells"]
        return len(times), len(cells), tuple(first.shape), first.dtype.name


def voxel_sizes(path: str) -> tuple[float | None, float | None, float | None]:
    """(z, y, x) sizes from the XML file beside, where there is one."""
    try:
        text = Xml.parse(f"{path.removesuffix('.h5')}.xml").findtext(".//voxelSize/size")
    except (OSError, Xml.ParseError):
        text = None
    return tuple(float(n) for n in text.split())[::-1] if text else (None, None, None)
