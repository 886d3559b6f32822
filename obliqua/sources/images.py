"""Image files without imaging libraries: OME-TIFF and OME-Zarr writers, a TIFF reader, CSV and sidecar sinks.

Arrays are (t, c, z, y, x).  Files are written by tasks, on a folder that all executors share.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, is_dataclass
from enum import Enum
from itertools import groupby, repeat
from operator import itemgetter
from pathlib import Path
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dtypes import written_type
from .codecs import blosc_pack
from .naming import stem

# Fixed values of TIFF: tag numbers, field types, and sample formats by kind.
TAGS = {"width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "description": 270, "offsets": 273, "samples": 277, "rows": 278, "counts": 279, "format": 339}
FORMATS = {"u": 1, "i": 2, "f": 3}
FIELD = {3: "H", 4: "I", 16: "Q", 2: "c"}


def ome_xml(shape: tuple[int, int, int, int, int], dtype: str, voxel: tuple[float, float, float], channels: list[str]) -> str:
    t, c, z, y, x = shape
    names = "".join(f'<Channel ID="Channel:0:{i}" Name="{n}" SamplesPerPixel="1"/>' for i, n in enumerate(channels))
    kind = {"float32": "float", "float64": "double"}.get(dtype, dtype)
    return (
        '<?xml version="1.0" encoding="UTF-8"?><OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06"><Image ID="Image:0" Name="image">'
        f'<Pixels ID="Pixels:0" DimensionOrder="XYZCT" Type="{kind}" SizeX="{x}" SizeY="{y}" SizeZ="{z}" SizeC="{c}" SizeT="{t}" '
        f'PhysicalSizeZ="{voxel[0]}" PhysicalSizeY="{voxel[1]}" PhysicalSizeX="{voxel[2]}">{names}<TiffData/></Pixels></Image></OME>'
    )


def write_tiff(path: str, planes: Iterator[np.ndarray], shape: tuple[int, int, int, int, int], dtype: str, voxel: tuple[float, float, float], channels: list[str] | None = None) -> None:
    """A BigTIFF with one deflated page for each plane, streamed in t, c, z order; the name appears when all is written."""

    def deflated() -> Iterator[bytes]:
        for number, plane in enumerate(planes):
            if plane.shape != shape[-2:]:
                raise ValueError(f"plane {number} is {plane.shape}, not {shape[-2:]}")
            yield deflate(plane, dtype)

    write_pages(path, deflated(), shape, dtype, voxel, channels)


def deflate(plane: np.ndarray, dtype: str) -> bytes:
    return zlib.compress(np.ascontiguousarray(plane.astype(np.dtype(written_type(dtype)).newbyteorder("<"))).tobytes())


def write_pages(path: str, pages: Iterator[bytes], shape: tuple[int, int, int, int, int], dtype: str, voxel: tuple[float, float, float], channels: list[str] | None = None) -> None:
    """The same from planes that are deflated already."""
    dtype = written_type(dtype)
    kind = np.dtype(dtype).newbyteorder("<")
    with open(f"{path}.part", "wb") as file:
        file.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16))
        link = 8
        for number, data in enumerate(pages):
            at = file.tell()
            file.write(data)
            entries = [("width", 4, shape[4]), ("height", 4, shape[3]), ("bits", 3, 8 * kind.itemsize), ("compression", 3, 8), ("photometric", 3, 1), ("offsets", 16, at), ("samples", 3, 1), ("rows", 4, shape[3]), ("counts", 16, len(data)), ("format", 3, FORMATS[kind.kind])]
            text = None
            if number == 0:
                text = ome_xml(shape, dtype, voxel, channels or [f"C{i}" for i in range(shape[1])]).encode() + b"\0"
                place = file.tell()
                file.write(text)
                entries.append(("description", 2, place))
            start = file.tell()
            file.write(struct.pack("<Q", len(entries)))
            for name, field, value in sorted(entries, key=lambda e: TAGS[e[0]]):
                count = len(text) if name == "description" and text else 1
                file.write(struct.pack("<HHQQ", TAGS[name], field, count, value))
            file.write(struct.pack("<Q", 0))
            end = file.tell()
            file.seek(link)
            file.write(struct.pack("<Q", start))
            file.seek(end)
            link = end - 8
    os.replace(f"{path}.part", path)


def tiff_pages(path: str) -> tuple[list[dict[str, Any]], str]:
    """Where the pages of a classic or BigTIFF file of stripped, plain or deflated grey planes lie, and the first page's description."""
    pages, text, names = [], "", {v: k for k, v in TAGS.items()}
    with open(path, "rb") as file:
        head = file.read(16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order is None:
            raise ValueError(f"{path} is no TIFF file")
        big = struct.unpack(order + "H", head[2:4])[0] == 43
        word, number, item = ("Q", "Q", 20) if big else ("I", "H", 12)
        wide = struct.calcsize(word)

        def at_place(place: int, form: str) -> tuple:
            file.seek(place)
            return struct.unpack(order + form, file.read(struct.calcsize(order + form)))

        (at,) = struct.unpack_from(order + word, head, 8 if big else 4)
        while at:
            (count,) = at_place(at, number)
            at += struct.calcsize(number)
            page: dict[str, list[int]] = {}
            for k in range(count):
                tag, field, n = at_place(at + k * item, "HH" + word)
                letter, place = FIELD.get(field), at + k * item + 4 + wide
                if tag in names and letter:
                    if n * struct.calcsize(letter) > wide:
                        (place,) = at_place(place, word)
                    if letter == "c":
                        file.seek(place)
                        text = text or (file.read(n).rstrip(b"\0").decode(errors="replace") if names[tag] == "description" else "")
                    else:
                        page[names[tag]] = list(at_place(place, f"{n}{letter}"))
            (at,) = at_place(at + count * item, word)
            how = page.get("compression", [1])[0]
            if how not in (1, 8, 32946) or page.get("samples", [1])[0] != 1:
                raise ValueError(f"compression {how} with {page.get('samples', [1])[0]} samples is not read")
            letter = {1: "u", 2: "i", 3: "f"}[page.get("format", [1])[0]]
            pages.append({"offsets": page["offsets"], "counts": page["counts"], "deflated": how != 1, "dtype": f"{order}{letter}{page['bits'][0] // 8}", "height": page["height"][0], "width": page["width"][0], "rows": min(page.get("rows", page["height"])[0], page["height"][0])})
    return pages, text


def read_lines(path: str, page: dict[str, Any], first: int, end: int) -> tuple[int, np.ndarray]:
    """(number of the first line, lines) of the strips of a page that hold the lines asked for; other strips are not read."""
    rows = page["rows"]
    strips = range(first // rows, -(-end // rows))
    with open(path, "rb") as file:
        raw = []
        for k in strips:
            file.seek(page["offsets"][k])
            data = file.read(page["counts"][k])
            raw.append(zlib.decompress(data) if page["deflated"] else data)
    return strips.start * rows, np.frombuffer(b"".join(raw), page["dtype"]).reshape(-1, page["width"])


def read_page(path: str, page: dict[str, Any]) -> np.ndarray:
    return read_lines(path, page, 0, page["height"])[1]


def read_tiff(path: str) -> np.ndarray:
    """All pages of a file as (pages, y, x); see ``tiff_pages``."""
    return np.stack([read_page(path, page) for page in tiff_pages(path)[0]])


CHUNK = (64, 256, 256)


#: The metadata of the packings that chunks are written by.
PACKINGS = {"zlib": {"id": "zlib", "level": 5}, "blosc": {"id": "blosc", "cname": "zstd", "clevel": 3, "shuffle": 1, "blocksize": 0}}


def start_zarr(path: str, shape: tuple[int, int, int, int, int], dtype: str, voxel: tuple[float, float, float], chunk: tuple[int, int, int] = CHUNK, packing: str = "zlib") -> None:
    """The metadata of an OME-Zarr 0.4 group of one level, chunks of one (t, c) each; chunks that are not there hold 0."""
    kind = np.dtype(written_type(dtype)).newbyteorder("<" if np.dtype(written_type(dtype)).itemsize > 1 else "|")
    chunks = [1, 1, *[min(a, b) for a, b in zip(chunk, shape[2:], strict=True)]]
    level = Path(path) / "0"
    level.mkdir(parents=True, exist_ok=True)
    axes = [{"name": "t", "type": "time"}, {"name": "c", "type": "channel"}, *[{"name": k, "type": "space", "unit": "micrometer"} for k in "zyx"]]
    scale = [{"type": "scale", "scale": [1.0, 1.0, *voxel]}]
    attributes = {"multiscales": [{"version": "0.4", "axes": axes, "datasets": [{"path": "0", "coordinateTransformations": scale}]}], "omero": {"channels": [{"label": f"C{i}", "color": "FFFFFF", "active": True} for i in range(shape[1])]}}
    (Path(path) / ".zgroup").write_text(json.dumps({"zarr_format": 2}))
    (Path(path) / ".zattrs").write_text(json.dumps(attributes))
    (level / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": list(shape), "chunks": chunks, "dtype": kind.str, "compressor": PACKINGS[packing], "fill_value": 0, "order": "C", "filters": None, "dimension_separator": "/"}))


def write_slab(path: str, t: int, c: int, z: int, slab: np.ndarray, dtype: str, depth: int, chunk: tuple[int, int, int] = CHUNK, packing: str = "zlib") -> None:
    """The chunks of planes from ``z``, a multiple of the chunks' depth, on; each file appears when it is whole."""
    kind = np.dtype(written_type(dtype)).newbyteorder("<")
    size = [min(chunk[0], depth), *[min(a, b) for a, b in zip(chunk[1:], slab.shape[1:], strict=True)]]
    for y in range(0, slab.shape[1], size[1]):
        for x in range(0, slab.shape[2], size[2]):
            part = slab[:, y : y + size[1], x : x + size[2]]
            if part.any():
                full = np.zeros(size, kind)
                full[tuple(slice(0, n) for n in part.shape)] = part
                file = Path(path) / "0" / str(t) / str(c) / str(z // size[0]) / str(y // size[1]) / str(x // size[2])
                file.parent.mkdir(parents=True, exist_ok=True)
                part_file = file.with_name(f"{file.name}.{uuid.uuid4().hex}.part")
                part_file.write_bytes(zlib.compress(full.tobytes(), 5) if packing == "zlib" else blosc_pack(full.tobytes(), kind.itemsize))
                os.replace(part_file, file)


def write_zarr(path: str, planes: Iterator[np.ndarray], shape: tuple[int, int, int, int, int], dtype: str, voxel: tuple[float, float, float], chunk: tuple[int, int, int] = CHUNK, packing: str = "zlib") -> None:
    """A whole group from planes in t, c, z order."""
    start_zarr(path, shape, dtype, voxel, chunk, packing)
    source, depth = iter(planes), min(chunk[0], shape[2])
    for t in range(shape[0]):
        for c in range(shape[1]):
            for z in range(0, shape[2], depth):
                write_slab(path, t, c, z, np.stack([next(source) for _ in range(min(depth, shape[2] - z))]), dtype, shape[2], chunk, packing)


def read_psf(path: str, multiple: int | None = None) -> np.ndarray:
    """A point-spread function: the first three-dimensional stack of a TIFF file, its far ends reflected up to a multiple."""
    return padded_psf(path, read_tiff(path).astype(float), multiple)


def padded_psf(path: str, psf: np.ndarray, multiple: int | None) -> np.ndarray:
    if psf.ndim != 3 or min(psf.shape) < 1:
        raise ValueError(f"{path} holds no three-dimensional function")
    if multiple:
        psf = np.pad(psf, [(0, -n % multiple) for n in psf.shape], mode="reflect" if min(psf.shape) > 1 else "edge")
    return psf


def write_h5(path: str, planes: Iterator[np.ndarray], shape: tuple[int, int, int, int, int], dtype: str, voxel: tuple[float, float, float]) -> None:
    """A BDV file, where its package is there; one volume at a time."""
    from . import bdv

    volumes = (np.stack([next(planes) for _ in range(shape[2])]) for _ in range(shape[0] * shape[1]))
    bdv.write(path, volumes, shape[2:], shape[0], shape[1], written_type(dtype), voxel, shape[2] == 1)


WRITERS = {"tiff": write_tiff, "omezarr": write_zarr, "h5": write_h5}


def _dense(pdf: pd.DataFrame, z: int, shape: tuple[int, int, int]) -> np.ndarray:
    out = np.zeros(shape)
    out[pdf["z"].to_numpy() - z, pdf["y"].to_numpy(), pdf["x"].to_numpy()] = pdf["v"].to_numpy()
    return out


def save_groups(voxels: DataFrame, by: list[str], kind: str, paths: dict[tuple, str], shapes: dict[tuple, tuple[int, int, int]], times: int, channels: int, dtype: str, voxel: tuple[float, float, float], packing: str = "zlib") -> DataFrame:
    """One file for each group ``by`` of voxels (t, c, z, y, x, v); returns a status row a group: failures are told, not raised.

    ``paths`` and ``shapes`` are by the group's key.  TIFF: planes are deflated each in a task of its own, and one task a file
    strings them together as they come, a few at a time.  OME-Zarr: a task for each slab of chunks.  BDV: a task for each group.
    """
    named = ", ".join(f"{k} int" for k in by)
    status = f"{named}, path string, error string"
    whole = lambda key: (times, channels, *shapes[key])

    def told(key: tuple, error: str | None) -> pd.DataFrame:
        return pd.DataFrame({**{k: [n] for k, n in zip(by, key, strict=True)}, "path": [paths[key]], "error": [error]})

    def guarded(key: tuple, work) -> pd.DataFrame:
        try:
            work()
            return told(key, None)
        except Exception as problem:  # one file's failure must not lose the others
            return told(key, repr(problem))

    if kind == "tiff":

        def page(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            *group, t, c, z = (int(k) for k in key)
            depth, height, width = shapes[tuple(group)]
            data = deflate(_dense(pdf, z, (1, height, width))[0], dtype)
            return pd.DataFrame({**{k: [n] for k, n in zip(by, group, strict=True)}, "number": [(t * channels + c) * depth + z], "data": [data]})

        def bound(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = ((tuple(int(k) for k in r[: len(by)]), int(r[-2]), r[-1]) for part in parts for r in part.itertuples(index=False))
            for key, group in groupby(rows, key=itemgetter(0)):
                depth, height, width = shapes[key]
                empty = deflate(np.zeros((height, width)), dtype)

                def pages(group=group, last=times * channels * depth, empty=empty) -> Iterator[bytes]:
                    at = 0
                    for _, number, data in group:
                        yield from repeat(empty, number - at)
                        yield data
                        at = number + 1
                    yield from repeat(empty, last - at)

                yield guarded(key, lambda key=key, pages=pages: write_pages(paths[key], pages(), whole(key), dtype, voxel))

        planes = voxels.groupBy(*by, "t", "c", "z").applyInPandas(page, f"{named}, number long, data binary")
        return planes.repartition(*by).sortWithinPartitions(*by, "number").mapInPandas(bound, status)
    if kind == "omezarr":
        for key, path in paths.items():
            start_zarr(path, whole(key), dtype, voxel, packing=packing)
        depths = {key: min(CHUNK[0], shape[0]) for key, shape in shapes.items()}

        def slab(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            *group, t, c, step = (int(k) for k in key)
            group = tuple(group)
            z, (depth, height, width) = step * depths[group], shapes[group]
            size = (min(depths[group], depth - z), height, width)
            return guarded(group, lambda: write_slab(paths[group], t, c, z, _dense(pdf, z, size), dtype, depth, packing=packing))

        depth = F.lit(CHUNK[0])
        for key, shape in shapes.items():
            same = F.lit(True)
            for k, n in zip(by, key, strict=True):
                same = same & (F.col(k) == n)
            depth = depth if shape[0] >= CHUNK[0] else F.when(same, shape[0]).otherwise(depth)
        slabs = voxels.withColumn("step", F.floor(F.col("z") / depth).cast("int")).groupBy(*by, "t", "c", "step").applyInPandas(slab, status)
        return slabs.groupBy(*by, "path").agg(F.max("error").alias("error"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        key = tuple(int(k) for k in key)
        groups = dict(tuple(pdf.groupby(["t", "c", "z"])))
        places = ((t, c, z) for t in range(times) for c in range(channels) for z in range(shapes[key][0]))
        planes = (_dense(groups.get(p, pdf[:0]), p[2], (1, *shapes[key][1:]))[0] for p in places)
        return guarded(key, lambda: WRITERS[kind](paths[key], planes, whole(key), dtype, voxel))

    return voxels.groupBy(*by).applyInPandas(run, status)


def save_tables(measures: DataFrame, paths: dict[tuple, str]) -> DataFrame:
    """One CSV file for each (image_id, roi_index, output_index) of measurements in long form; a status row each."""
    keys = ["image_id", "roi_index", "output_index"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        key = tuple(int(k) for k in key)
        cell = pdf["value"].astype(object).where(pdf["value"].notna(), pdf["text"])
        wide = pdf.assign(cell=cell).pivot(index=["time", "channel", "row"], columns="name", values="cell")
        names = pdf.sort_values("place")["name"].drop_duplicates().tolist()
        wide[names].reset_index().drop(columns="row").to_csv(paths[key], index=False)
        return pd.DataFrame({**{k: [n] for k, n in zip(keys, key, strict=True)}, "path": [paths[key]], "error": [None]})

    return measures.groupBy(*keys).applyInPandas(run, ", ".join([*[f"{k} int" for k in keys], "path string, error string"]))


def explode_lists(table: DataFrame, columns: list[str]) -> DataFrame:
    """List cells side by side as rows, with a leading row number; other cells repeat."""
    rest = [c for c in table.columns if c not in columns]
    return table.select(*rest, F.posexplode(F.arrays_zip(*columns)).alias("row", "cell")).select("row", *rest, *[F.col(f"cell.{c}").alias(c) for c in columns])


def write_csv(table: DataFrame, path: str) -> None:
    table.write.option("header", True).csv(path)


def jsonable(value: Any) -> Any:
    """Enums by name, ranges as their ends, paths as text, dataclasses as mappings."""
    if isinstance(value, Enum):
        return value.name
    if isinstance(value, range):
        return [value.start, value.stop]
    if isinstance(value, Path):
        return str(value)
    if is_dataclass(value) and not isinstance(value, type):
        return jsonable(asdict(value))
    if isinstance(value, dict):
        return {str(k): jsonable(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [jsonable(v) for v in value]
    if isinstance(value, np.generic):
        return value.item()
    return value.tolist() if isinstance(value, np.ndarray) else value


def sidecar(output: str, config: Any, origin: tuple[float | None, float, float], voxel: tuple[float, float, float], roi: int | None = None, projection: bool = False) -> dict:
    microns = [None if o is None else o * v for o, v in zip(origin, voxel, strict=True)]
    return {"schema_version": "1.0", "output": {"path": Path(output).name, "roi_index": roi, "projection": projection, "origin_zyx_px": list(origin), "origin_zyx_um": microns}, "config": jsonable(config)}


def write_sidecar(output: str, document: dict, name: str | None = None) -> str | None:
    """``<name>.lattice.json`` beside an output, by its own name if none is given; a failure is told by None and never raised."""
    path = Path(output).with_name(f"{name or stem(output)}.lattice.json")
    try:
        path.write_text(json.dumps(document, indent=2))
        return str(path)
    except OSError:
        return None


def sidecar_column(config: dict) -> Any:
    """The same document as JSON text, for a table of (path, roi_index, z, y, x)."""
    origin = F.array("z", "y", "x")
    output = F.struct(F.col("path"), F.col("roi_index"), origin.alias("origin_zyx_px"))
    return F.to_json(F.struct(F.lit("1.0").alias("schema_version"), output.alias("output"), F.lit(json.dumps(jsonable(config))).alias("config")))
