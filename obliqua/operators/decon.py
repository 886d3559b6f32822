"""Richardson-Lucy deconvolution in raw space, block by block.

A block takes a halo of half the point-spread function from its neighbours (see ``halo``), is deconvolved by FFT and
keeps its own voxels only.  Blocks bound the memory of a task whatever the volume's size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.volume import KEYS
from .halo import stencil_by_place


def richardson_lucy(volume: np.ndarray, psf: np.ndarray, iterations: int) -> np.ndarray:
    """The estimate after so many iterations; borders repeat the nearest voxel, negative values count as 0."""
    psf = psf / psf.sum()
    reach = [s // 2 for s in psf.shape]
    data = np.pad(np.maximum(volume.astype(float), 0), [(r, r) for r in reach], mode="edge")
    size = [d + p - 1 for d, p in zip(data.shape, psf.shape, strict=True)]
    axes = (0, 1, 2)
    kernel = np.fft.rfftn(psf, size, axes)
    turned = np.fft.rfftn(psf[::-1, ::-1, ::-1], size, axes)
    cut = tuple(slice((p - 1) // 2, (p - 1) // 2 + d) for p, d in zip(psf.shape, data.shape, strict=True))
    back = tuple(slice(p // 2, p // 2 + d) for p, d in zip(psf.shape, data.shape, strict=True))
    convolve = lambda a, k, s: np.fft.irfftn(np.fft.rfftn(a, size, axes) * k, size, axes)[s]
    estimate = np.full_like(data, max(float(data.mean()), 1e-12))
    for _ in range(iterations):
        blurred = convolve(estimate, kernel, cut)
        ratio = data / np.maximum(blurred, 1e-12)
        estimate = estimate * np.maximum(convolve(ratio, turned, back), 0)
    return estimate[tuple(slice(r, r + n) for r, n in zip(reach, volume.shape, strict=True))]


def check_psfs(psfs: dict[int, np.ndarray], channels: int) -> None:
    if len(psfs) != channels or any(p.ndim != 3 for p in psfs.values()):
        raise ValueError(f"{channels} channels need as many three-dimensional point-spread functions, not {len(psfs)}")


def plane_medians(voxels: DataFrame, plane: int) -> DataFrame:
    """(keys, median) of the one plane of each slice in ``voxels``, its zeros too; a plane of ``plane`` places is one row.

    Slices without a voxel there are not told; their median is 0.
    """
    middle = F.lit((plane - 1) / 2) - (F.lit(plane) - F.size("vs"))  # its place among the voxels with a value
    at = lambda k: F.when((k >= 0) & (k < F.size("vs")), F.get("vs", k.cast("int"))).otherwise(F.lit(0.0))
    median = (at(F.floor(middle)) + at(F.ceil(middle))) / 2
    return voxels.groupBy(*KEYS).agg(F.sort_array(F.collect_list("v")).alias("vs")).select(*KEYS, median.alias("median"))


def background_plane(background: float | str, depth: int) -> int | None:
    """The plane whose median is taken off: the last ("auto"), the one before ("second_last"), none for a number."""
    return {"auto": depth - 1, "second_last": depth - 2}[background] if isinstance(background, str) else None


def without_background(voxels: DataFrame, background: float | str, medians: DataFrame | None = None) -> DataFrame:
    """Values less a number, or less their slice's median of ``medians`` (a row a slice); none falls below 0.

    The medians are of whole planes, so they are made before any block is cut out of the voxels.
    """
    if isinstance(background, str):
        if medians is None:
            raise ValueError(f"background {background!r} needs the medians of its planes")
        made = voxels.join(medians, KEYS, "left").withColumn("v", F.col("v") - F.coalesce("median", F.lit(0.0)))
    elif background:
        made = voxels.withColumn("v", F.col("v") - background)
    else:
        return voxels
    return made.filter("v > 0").select(voxels.columns)


def deconvolve(voxels: DataFrame, psfs: dict[int, np.ndarray], shape: tuple[int, int, int], iterations: int = 10, block: tuple[int, int, int] = (64, 128, 128)) -> DataFrame:
    """Deconvolved voxels above 0; ``psfs`` holds one array for each channel (absolute number)."""
    halo = tuple(max(p.shape[k] // 2 for p in psfs.values()) for k in range(3))

    def work(values: np.ndarray, _: np.ndarray, key: tuple[int, int, int], outside: list[tuple[int, int]]):
        inside = tuple(slice(a, n - b) for (a, b), n in zip(outside, values.shape, strict=True))
        made = richardson_lucy(values[inside], psfs[key[2]], iterations)
        own = made[tuple(slice(h - a, n - h + b - a - b) for h, (a, b), n in zip(halo, outside, values.shape, strict=True))]
        return own, own > 1e-9

    return stencil_by_place(voxels, halo, work, shape, block)
