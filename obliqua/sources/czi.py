"""CZI files: the plane directory, what it says of the image, and planes read by the executors.

The format is a chain of segments; the sub-block directory lists where each plane's pixels lie.
Grey planes are read, plain or packed by zstd, each once, by the task that needs it; the path must
reach every executor.  Files with tiles of a mosaic or axes beyond T, C, Z, Y, X are
declined by ``describe`` (None), for a reader that knows them.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from pathlib import Path
from xml.etree import ElementTree

import numpy as np

from .codecs import czi_zstd

# Fixed values of the format: pixel types by number, and the packings that are read.
PIXELS = {0: "uint8", 1: "uint16", 2: "float32"}
PLAIN, ZSTD, MARKED_ZSTD = 0, 5, 6


@dataclass(frozen=True)
class Plane:
    scene: int
    t: int
    c: int
    z: int
    y: int
    x: int
    height: int
    width: int
    dtype: str
    position: int
    compression: int = PLAIN


@dataclass(frozen=True)
class Description:
    size_t: int
    size_c: int
    size_z: int
    size_y: int
    size_x: int
    dtype: str
    channel_names: tuple[str, ...]
    scene: int


def _segment(file, position: int) -> tuple[str, bytes]:
    file.seek(position)
    name, _, used = struct.unpack("<16sqq", file.read(32))
    return name.rstrip(b"\0").decode("ascii", "replace"), file.read(max(0, used))


def _entry(data: bytes, at: int) -> tuple[dict[str, tuple[int, int]], int, int, int, int]:
    """(start and size of each axis, pixel type, position, compression, where the next entry begins)."""
    schema, pixel, position, _, compression = struct.unpack_from("<2siqii", data, at)
    if schema != b"DV":
        raise ValueError("unknown directory entry")
    (count,) = struct.unpack_from("<i", data, at + 28)
    axes = {}
    for k in range(count):
        name, start, size, _, _ = struct.unpack_from("<4siifi", data, at + 32 + 20 * k)
        axes[name.rstrip(b"\0").decode()] = (start, size)
    return axes, pixel, position, compression, at + 32 + 20 * count


def _directory(path: str) -> tuple[list[tuple[dict, int, int, int]], bytes]:
    """All entries and the metadata XML."""
    with open(path, "rb") as file:
        name, head = _segment(file, 0)
        if name != "ZISRAWFILE":
            raise ValueError(f"{path} is no CZI file")
        where, about = struct.unpack_from("<qq", head, 52)
        _, data = _segment(file, where)
        (count,) = struct.unpack_from("<i", data, 0)
        entries, at = [], 128
        for _ in range(count):
            axes, pixel, position, compression, at = _entry(data, at)
            entries.append((axes, pixel, position, compression))
        xml = b""
        if about:
            _, data = _segment(file, about)
            xml = data[256 : 256 + struct.unpack_from("<i", data, 0)[0]]
    return entries, xml


def planes(path: str) -> list[Plane]:
    """Every plane of a file; ValueError where one is compressed or of a kind not read."""
    out = []
    for axes, pixel, position, compression, in _directory(path)[0]:
        if compression not in (PLAIN, ZSTD, MARKED_ZSTD) or pixel not in PIXELS:
            raise ValueError("only grey planes, plain or packed by zstd, are read")
        first = lambda k, axes=axes: axes.get(k, (0, 1))[0]
        out.append(Plane(first("S"), first("T"), first("C"), first("Z"), first("Y"), first("X"), axes["Y"][1], axes["X"][1], PIXELS[pixel], position, compression))
    return out


def describe(path: str, scene_index: int = 0) -> Description | None:
    """Sizes, type and channel names of a scene, the i-th of the sorted scene numbers; None where this reader declines.

    Planes may drift sideways: the canvas spans them all.
    """
    try:
        entries, xml = _directory(path)
        if any(size > 1 for axes, *_ in entries for k, (_, size) in axes.items() if k not in "TCZYXSM") or any(axes.get("M", (0, 1))[0] > 0 for axes, *_ in entries):
            return None
        found = planes(path)
    except (OSError, ValueError, struct.error):
        return None
    scenes = sorted({p.scene for p in found})
    if not 0 <= scene_index < len(scenes):
        return None
    own = [p for p in found if p.scene == scenes[scene_index]]
    extent = lambda lo, hi: max(hi) - min(lo)
    channels = max(p.c for p in own) + 1
    names = [n.get("Name") or n.get("Id") or "" for n in ElementTree.fromstring(xml).iterfind(".//Dimensions/Channels/Channel")] if xml else []
    return Description(
        max(p.t for p in own) + 1, channels, max(p.z for p in own) + 1,
        extent([p.y for p in own], [p.y + p.height for p in own]), extent([p.x for p in own], [p.x + p.width for p in own]),
        own[0].dtype, tuple(names[:channels]) if len(names) >= channels else tuple(f"Channel:{scenes[scene_index]}:{i}" for i in range(channels)), scenes[scene_index],
    )


def pixel_sizes(path: str) -> tuple[float | None, float | None, float | None]:
    """(z, y, x) sizes in microns from the scaling in the metadata, which is in metres."""
    xml = _directory(path)[1]
    found = {d.get("Id"): d.findtext("Value") for d in ElementTree.fromstring(xml).iterfind(".//Scaling/Items/Distance")} if xml else {}
    return tuple(float(found[k]) * 1e6 if found.get(k) else None for k in "ZYX")


def read_plane(path: str, position: int, height: int, width: int, dtype: str, compression: int = PLAIN, rows: tuple[int, int] | None = None) -> np.ndarray:
    """A plane, or its lines from one to another; of a plain plane no other bytes are read."""
    first, end = rows or (0, height)
    kind = np.dtype(dtype).newbyteorder("<")
    with open(path, "rb") as file:
        file.seek(position + 32)
        metadata, _, size = struct.unpack("<iiq", file.read(16))
        head = file.read(512)
        _, _, _, _, entry_end = _entry(head, 0)
        start = position + 32 + max(256, 16 + entry_end) + metadata
        if compression == PLAIN:
            file.seek(start + first * width * kind.itemsize)
            raw = file.read((end - first) * width * kind.itemsize)
            return np.frombuffer(raw, kind).reshape(end - first, width)
        file.seek(start)
        raw = czi_zstd(file.read(size), height * width * kind.itemsize, compression == MARKED_ZSTD)
    return np.frombuffer(raw, kind).reshape(height, width)[first:end]


def xml_tree(text: str | bytes) -> dict:
    """An XML document as nested mappings: attributes as ``@name``, repeated children as lists, text as the value or ``#text``."""

    def value(node):
        out: dict = {f"@{k}": v for k, v in node.attrib.items()}
        for child in node:
            made = value(child)
            if child.tag in out:
                out[child.tag] = [*(out[child.tag] if isinstance(out[child.tag], list) else [out[child.tag]]), made]
            else:
                out[child.tag] = made
        text = (node.text or "").strip()
        if not out:
            return text or None
        return out | ({"#text": text} if text else {})

    root = ElementTree.fromstring(text)
    return {root.tag: value(root)}
