"""Where the pixels of an image file lie: which pieces meet given ranges, and reading them.

A layout lists pieces of a file (planes, pages, chunks, volumes) by their place on the axes (t, c, z, y, x).  Only pieces that
meet the ranges asked for become tasks, and of a plane only its lines within them are read where the packing allows it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product
from pathlib import Path
from typing import Any
from xml.etree import ElementTree

import numpy as np

from . import bdv, codecs, czi, images

AXES = ("t", "c", "z", "y", "x")
Range = tuple[int, int]
Block = tuple[tuple[int, ...], np.ndarray]


@dataclass(frozen=True)
class Piece:
    """A box of the image and what its reader needs to find it."""

    start: tuple[int, ...]
    size: tuple[int, ...]
    where: Any

    def meets(self, bounds: dict[str, Range]) -> bool:
        return all(s < bounds[k][1] and s + n > bounds[k][0] for k, s, n in zip(AXES, self.start, self.size, strict=True))


@dataclass
class Layout:
    path: str
    sizes: tuple[int, int, int, int, int]
    dtype: str
    pixel_sizes: tuple[float | None, float | None, float | None] = (None, None, None)
    channels: tuple[str, ...] = ()
    pieces: list[Piece] = field(default_factory=list)

    def tasks(self, bounds: dict[str, Range], most_bytes: int) -> list[Any]:
        """Runs of pieces in the order of the file, each of about so many pixel bytes at most."""
        out: list[list[Piece]] = []
        held, item = 0, np.dtype(self.dtype).itemsize
        for piece in self.pieces:
            if piece.meets(bounds):
                size = math.prod(piece.size) * item
                if not out or held + size > most_bytes:
                    out.append([])
                    held = 0
                out[-1].append(piece)
                held += size
        return out

    def count(self, task: Any) -> int:
        """The pieces that a task opens."""
        return len(task)

    def blocks(self, task: Any, bounds: dict[str, Range]) -> Iterator[Block]:
        """(place, pixels) of each piece, whole or at least as far as the ranges reach."""
        for piece in task:
            yield self.read(piece, bounds)

    def read(self, piece: Piece, bounds: dict[str, Range]) -> Block:
        raise NotImplementedError

    def lines(self, piece: Piece, bounds: dict[str, Range]) -> Range:
        """The lines of a plane that the range of y asks for, counted in the plane."""
        low, high = bounds["y"]
        return max(0, low - piece.start[3]), min(piece.size[3], high - piece.start[3])


class CziLayout(Layout):
    def read(self, piece: Piece, bounds: dict[str, Range]) -> Block:
        first, end = self.lines(piece, bounds)
        pixels = czi.read_plane(self.path, *piece.where, rows=(first, end))
        return (*piece.start[:3], piece.start[3] + first, piece.start[4]), pixels[None, None, None]


class TiffLayout(Layout):
    def read(self, piece: Piece, bounds: dict[str, Range]) -> Block:
        first, pixels = images.read_lines(self.path, piece.where, *self.lines(piece, bounds))
        return (*piece.start[:3], piece.start[3] + first, piece.start[4]), pixels[None, None, None]


class BdvLayout(Layout):
    def read(self, piece: Piece, bounds: dict[str, Range]) -> Block:
        return piece.start, bdv.read(self.path, *piece.start[:2])[None, None]


@dataclass
class ZarrLayout(Layout):
    """The chunks form a grid, so tasks are runs of numbers in the part of the grid that meets the ranges."""

    about: dict[str, Any] = field(default_factory=dict)

    def tasks(self, bounds: dict[str, Range], most_bytes: int) -> list[Any]:
        chunks, axes, shape = self.about["chunks"], self.about["axes"], dict(zip(AXES, self.sizes, strict=True))
        if any(bounds[k][0] > 0 or bounds[k][1] < 1 for k in AXES if k not in axes):
            return []
        grid = []
        for k in axes:
            low, high = max(0, bounds[k][0]), min(shape[k], bounds[k][1])
            grid.append((low // chunks[k], -(-high // chunks[k])) if low < high else (0, 0))
        total = math.prod(b - a for a, b in grid)
        each = max(1, most_bytes // max(1, math.prod(chunks.values()) * np.dtype(self.dtype).itemsize))
        return [(grid, first, min(total, first + each)) for first in range(0, total, each)]

    def count(self, task: Any) -> int:
        return task[2] - task[1]

    def blocks(self, task: Any, bounds: dict[str, Range]) -> Iterator[Block]:
        grid, first, end = task
        chunks, axes, kind = self.about["chunks"], self.about["axes"], np.dtype(self.about["dtype"])
        shape = dict(zip(AXES, self.sizes, strict=True))
        for number in range(first, end):
            at = [a + int(n) for (a, _), n in zip(grid, np.unravel_index(number, [b - a for a, b in grid]), strict=True)]
            file = Path(self.about["level"]) / self.about["separator"].join(map(str, at))
            try:
                raw = file.read_bytes()
            except FileNotFoundError:  # chunks of the fill value may be left out
                continue
            start = {k: n * chunks[k] for k, n in zip(axes, at, strict=True)}
            block = np.frombuffer(codecs.chunk_unpack(self.about["compressor"], raw), kind).reshape([chunks[k] for k in axes])
            block = block[tuple(slice(0, shape[k] - start[k]) for k in axes)]
            yield tuple(start.get(k, 0) for k in AXES), block.reshape([block.shape[axes.index(k)] if k in axes else 1 for k in AXES])


def czi_layout(path: str, scene: int = 0) -> Layout:
    about = czi.describe(path, scene)
    if about is None:
        raise ValueError(f"{path}: this kind of CZI file, or scene {scene}, is not read")
    own = sorted((p for p in czi.planes(path) if p.scene == about.scene), key=lambda p: p.position)
    top, left = min(p.y for p in own), min(p.x for p in own)
    pieces = [Piece((p.t, p.c, p.z, p.y - top, p.x - left), (1, 1, 1, p.height, p.width), (p.position, p.height, p.width, p.dtype, p.compression)) for p in own]
    return CziLayout(path, (about.size_t, about.size_c, about.size_z, about.size_y, about.size_x), about.dtype, czi.pixel_sizes(path), about.channel_names, pieces)


def tiff_layout(path: str) -> Layout:
    """Pages in the order that the OME description tells, else one stack."""
    pages, text = images.tiff_pages(path)
    sizes, order, voxel, names = {"T": 1, "C": 1, "Z": len(pages)}, "ZCT", (None, None, None), ()
    if "<OME" in text:
        pixels = ElementTree.fromstring(text).find(".//{*}Pixels")
        sizes, order = {k: int(pixels.get(f"Size{k}", 1)) for k in "TCZ"}, pixels.get("DimensionOrder", "XYZCT")[2:]
        voxel = tuple(float(n) if (n := pixels.get(f"PhysicalSize{k}")) else None for k in "ZYX")
        names = tuple(c.get("Name", "") for c in pixels.iterfind("{*}Channel"))
        if math.prod(sizes.values()) != len(pages):
            raise ValueError(f"{path} has {len(pages)} pages for sizes {sizes}")
    pieces = []
    for at, page in zip(product(*[range(sizes[k]) for k in reversed(order)]), pages, strict=True):  # the last axis of the order is the slowest
        place = dict(zip(reversed(order), at, strict=True))
        pieces.append(Piece((*(place[k] for k in "TCZ"), 0, 0), (1, 1, 1, page["height"], page["width"]), page))
    return TiffLayout(path, (sizes["T"], sizes["C"], sizes["Z"], pages[0]["height"], pages[0]["width"]), np.dtype(pages[0]["dtype"]).name, voxel, names, pieces)


def zarr_layout(path: str) -> Layout:
    """The finest level of an OME-Zarr 0.4 group; chunks plain or by zlib, gzip, zstd or Blosc."""
    attributes = json.loads((Path(path) / ".zattrs").read_text())
    scales = attributes["multiscales"][0]
    level = Path(path) / scales["datasets"][0]["path"]
    array = json.loads((level / ".zarray").read_text())
    axes = [a["name"] for a in scales["axes"]]
    how = array["compressor"]
    if (how["id"] if how else None) not in codecs.READ_CHUNKS or array.get("order", "C") != "C" or array.get("filters"):
        raise ValueError(f"{path}: chunks packed by {how} are not read")
    shape = dict(zip(axes, array["shape"], strict=True))
    scale = next((dict(zip(axes, c["scale"], strict=True)) for c in scales["datasets"][0].get("coordinateTransformations", []) if c["type"] == "scale"), {})
    names = tuple(c.get("label", "") for c in attributes.get("omero", {}).get("channels", []))
    about = {"level": str(level), "axes": axes, "chunks": dict(zip(axes, array["chunks"], strict=True)), "compressor": how, "separator": array.get("dimension_separator", "."), "dtype": array["dtype"]}
    return ZarrLayout(path, tuple(shape.get(a, 1) for a in AXES), np.dtype(array["dtype"]).name, tuple(scale.get(a) for a in "zyx"), names, about=about)


def bdv_layout(path: str) -> Layout:
    """The finest level of every slice, where the HDF5 package is there."""
    file = path.removesuffix(".xml") + (".h5" if path.endswith(".xml") else "")
    times, channels, shape, kind = bdv.describe(file)
    pieces = [Piece((t, c, 0, 0, 0), (1, 1, *shape), None) for t in range(times) for c in range(channels)]
    return BdvLayout(file, (times, channels, *shape), kind, bdv.voxel_sizes(file), (), pieces)


def open_layout(path: str, scene: int = 0) -> Layout | None:
    """The layout of a file by its name; None for other names."""
    name = path.lower().rstrip("/")
    if name.endswith(".czi"):
        return czi_layout(path, scene)
    if name.endswith((".tif", ".tiff")):
        return tiff_layout(path)
    if name.endswith(".zarr"):
        return zarr_layout(path)
    if name.endswith((".h5", ".xml")):
        return bdv_layout(path)
    return None


def scenes_of(path: str) -> list[int]:
    """The scene numbers that a file knows, sorted; a file of another kind has one."""
    return sorted({p.scene for p in czi.planes(path)}) if path.lower().endswith(".czi") else [0]


def stack(path: str, scene: int = 0) -> np.ndarray:
    """The (z, y, x) stack of a file's first time and channel."""
    layout = open_layout(path, scene)
    if layout is None:
        raise ValueError(f"{path}: a file of this name is not read")
    out = np.zeros(layout.sizes[2:], layout.dtype)
    bounds = {"t": (0, 1), "c": (0, 1), **{k: (0, n) for k, n in zip("zyx", layout.sizes[2:], strict=True)}}
    for task in layout.tasks(bounds, 1 << 30):
        for (_, _, z, y, x), block in layout.blocks(task, bounds):
            cut = block[0, 0][: out.shape[0] - z, : out.shape[1] - y, : out.shape[2] - x]
            out[z : z + cut.shape[0], y : y + cut.shape[1], x : x + cut.shape[2]] = cut
    return out


def read_psf(path: str) -> np.ndarray:
    """A point-spread function: a TIFF stack as it is, the first stack of another file with its far ends reflected up to multiples of 16."""
    if path.lower().endswith((".tif", ".tiff")):
        return images.read_psf(path)
    return images.padded_psf(path, stack(path).astype(float), 16)
