"""Acquisition geometry: shapes, maps and bounds, all on the driver and without pixels.

A volume is a stack of scan planes (z) that are tilted by ``angle`` against the
stage; the skewed lateral axis is y or x.  Two output frames exist: "shear"
keeps the coverslip level, "objective" turns the volume to the optical axis.
Everything is computed once in double precision and enters plans as literals.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, replace

import numpy as np

DEFAULT_ANGLE = 30.0
DEFAULT_DZ, DEFAULT_DY, DEFAULT_DX = 0.3, 0.1499219272808386, 0.1499219272808386
FRAMES, SKEWS = ("shear", "objective"), ("Y", "X")


@dataclass(frozen=True)
class Box:
    """A half-open block of voxels, axis by axis."""

    z: tuple[int, int]
    y: tuple[int, int]
    x: tuple[int, int]

    @property
    def shape(self) -> tuple[int, int, int]:
        return tuple(max(0, b - a) for a, b in (self.z, self.y, self.x))  # type: ignore[return-value]


@dataclass(frozen=True)
class Acquisition:
    """Size of a raw volume, its voxels in microns, and how it was scanned."""

    nz: int
    ny: int
    nx: int
    dz: float = DEFAULT_DZ
    dy: float = DEFAULT_DY
    dx: float = DEFAULT_DX
    angle: float = DEFAULT_ANGLE
    skew: str = "Y"
    frame: str = "shear"

    def __post_init__(self):
        if self.frame not in FRAMES:
            raise ValueError(f"unknown frame {self.frame!r}; one of {FRAMES}")
        if self.skew not in SKEWS:
            raise ValueError(f"unknown skew direction {self.skew!r}; one of {SKEWS}")
        if min(self.nz, self.ny, self.nx) < 1:
            raise ValueError("a volume has at least one voxel along each axis")
        if min(self.dz, self.dy, self.dx) < 0:
            raise ValueError("voxel sizes are not negative")

    sin = property(lambda self: math.sin(math.radians(self.angle)))
    cos = property(lambda self: math.cos(math.radians(self.angle)))
    tan = property(lambda self: math.tan(math.radians(self.angle)))
    lateral = property(lambda self: self.skew.lower(), doc="name of the skewed lateral axis")
    other = property(lambda self: "x" if self.skew == "Y" else "y", doc="name of the untouched axis")
    n_lateral = property(lambda self: self.ny if self.skew == "Y" else self.nx)
    n_other = property(lambda self: self.nx if self.skew == "Y" else self.ny)
    d_lateral = property(lambda self: self.dy if self.skew == "Y" else self.dx)
    step = property(lambda self: self.dz / self.d_lateral, doc="scan step in lateral voxels")
    rise = property(lambda self: self.sin * self.step, doc="output planes per scan plane")
    run = property(lambda self: self.cos * self.step, doc="lateral shift per scan plane")

    @property
    def new_dz(self) -> float:
        """Height of an output voxel in microns."""
        return self.d_lateral if self.frame == "shear" else self.sin * self.dz

    def shape_zyx(self, depth: int, lateral: int) -> tuple[int, int, int]:
        return (depth, lateral, self.nx) if self.skew == "Y" else (depth, self.ny, lateral)

    @property
    def output_shape(self) -> tuple[int, int, int]:
        """Size of the deskewed volume (z, y, x).

        The shear frame takes ceilings of the last voxel's place; the objective
        frame rounds the extents of the eight turned corners half to even.
        """
        if self.frame == "shear":
            depth = math.ceil((self.nz - 1) * self.rise) + 1
            return self.shape_zyx(depth, math.ceil((self.nz - 1) * self.run + (self.n_lateral - 1)) + 1)
        (a, b), (c, d) = self.turn_matrix()
        corners = [(a * z + b * lat, c * z + d * lat) for z in (0, self.nz) for lat in (0, self.n_lateral)]
        depth, lateral = (round(max(p[k] for p in corners) - min(p[k] for p in corners)) for k in (0, 1))
        return self.shape_zyx(depth, lateral)

    def turn_matrix(self) -> list[list[float]]:
        """(depth, lateral) from (scan, lateral) in the objective frame: a product of matrices that is not
        simplified, since the rounding of a half may hang on the last bit."""
        shear = np.array([[1.0, 0.0], [math.sin(math.radians(90 - self.angle)) * self.step, 1.0]])
        scale = np.array([[self.sin * self.dz / self.d_lateral, 0.0], [0.0, 1.0]])
        turn = np.array([[self.cos, -self.sin], [self.sin, self.cos]])
        return (turn @ scale @ shear).tolist()

    def _turn(self, z: float, lateral: float) -> tuple[float, float]:
        """Objective frame before translation: shear, scale and rotation in one."""
        return -self.sin * lateral, self.step * z + self.cos * lateral

    def forward(self, z: float, y: float, x: float) -> tuple[float, float, float]:
        """Output place (z, y, x) of a raw place."""
        lateral = y if self.skew == "Y" else x
        if self.frame == "shear":
            depth, moved = self.rise * z, self.run * z + lateral
        else:
            depth, moved = self._turn(z, lateral)
            depth += self.n_lateral * self.sin
        return (depth, moved, x) if self.skew == "Y" else (depth, y, moved)

    def inverse(self, z: float, y: float, x: float) -> tuple[float, float, float]:
        """Raw place (z, y, x) of an output place."""
        moved = y if self.skew == "Y" else x
        if self.frame == "shear":
            scan, lateral = z / self.rise, moved - z / self.tan
        else:
            lateral = (self.n_lateral * self.sin - z) / self.sin
            scan = (moved - self.cos * lateral) / self.step
        return (scan, lateral, x) if self.skew == "Y" else (scan, y, lateral)

    def affine_zyx(self, flipped: bool = False) -> np.ndarray:
        """4x4 display matrix from raw to output places; a flipped scan is turned back first."""
        columns = [np.array(self.forward(*unit)) for unit in ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1))]
        matrix = np.eye(4)
        matrix[:3, 3] = columns[0]
        for k in range(3):
            matrix[:3, k] = columns[k + 1] - columns[0]
        if flipped:
            turn = np.eye(4)
            turn[0, 0], turn[0, 3] = -1, self.nz - 1
            matrix = matrix @ turn
        return matrix

    def mip_shape(self) -> tuple[int, int]:
        """Size (y, x) of the projection computed straight from raw planes."""
        lateral = math.ceil((self.nz - 1) * self.step + (self.n_lateral - 1) * self.cos) + 1
        if self.frame == "shear":
            return self.output_shape[1], self.output_shape[2]
        return (lateral, self.nx) if self.skew == "Y" else (self.ny, lateral)

    def subblock(self, box: Box) -> Acquisition:
        nz, ny, nx = box.shape
        return replace(self, nz=nz, ny=ny, nx=nx)


def xyz_from_zyx(matrix: np.ndarray) -> np.ndarray:
    """The same affine with its axes in the opposite order."""
    turn = np.eye(4)[[2, 1, 0, 3]]
    return turn @ matrix @ turn


@dataclass(frozen=True)
class CropPlan:
    """Which raw block a region needs, and where its crop lies in the output."""

    raw: Box
    shape: tuple[int, int, int]
    excess: int
    origin: tuple[float, float, float]


def region_box(corners: list[tuple[float, float]], z_start: int, z_end: int) -> Box:
    """Bounding box of a region's (y, x) corners: rounded half to even, not below 0."""
    (top, left), (bottom, right) = (tuple(max(0.0, float(np.rint(f(c[k] for c in corners)))) for k in (0, 1)) for f in (min, max))
    return Box((z_start, z_end), (int(top), int(bottom)), (int(left), int(right)))


def crop_plan(acquisition: Acquisition, box: Box) -> CropPlan:
    """The raw block that holds an output box, by mapping the box's corners back.

    The shear frame adds a margin of one voxel for interpolation and at least two
    planes.  The objective frame rounds the block, and its crop starts where the
    clipped block does: at ``excess`` along the skewed axis.
    """
    a = acquisition
    limits = (a.nz, a.ny, a.nx)
    corners = [a.inverse(*c) for c in itertools.product(box.z, box.y, box.x)]
    low, high = ([f(c[k] for c in corners) for k in range(3)] for f in (min, max))
    if a.frame == "shear":
        spans = [(min(max(math.floor(lo) - 1, 0), n), min(max(math.ceil(hi) + 1, 0), n)) for lo, hi, n in zip(low, high, limits, strict=True)]
        if spans[0][1] - spans[0][0] < 2:
            end = min(spans[0][0] + 2, a.nz)
            spans[0] = (max(end - 2, 0), end)
        spans[1:] = [(lo, min(lo + 1, n)) if hi <= lo else (lo, hi) for (lo, hi), n in zip(spans[1:], limits[1:], strict=True)]
        return CropPlan(Box(*spans), box.shape, 0, (float(box.z[0]), float(box.y[0]), float(box.x[0])))
    spans = [tuple(min(max(int(np.rint(v)), 0), n) for v in (lo, hi)) for lo, hi, n in zip(low, high, limits, strict=True)]
    back = [a.forward(*c) for c in itertools.product(*spans)]
    start = [min(c[k] for c in back) for k in range(3)]
    axis = 1 if a.skew == "Y" else 2
    excess = max(round((box.y if axis == 1 else box.x)[0] - start[axis]), 0)
    start[axis] += excess
    return CropPlan(Box(*spans), box.shape, excess, tuple(start))  # type: ignore[arg-type]


def safe_raw_box(acquisition: Acquisition, box: Box) -> Box:
    """A raw block that surely holds every voxel that an output box is interpolated from."""
    a = acquisition
    depth = a.output_shape[0]
    zs = box.z if a.frame == "shear" else (depth - 1 - box.z[1], depth - box.z[0])
    places = []
    for z, y, x in itertools.product(zs, (box.y[0] - 1, box.y[1]), (box.x[0] - 1, box.x[1])):
        if a.frame == "shear":
            places.append(a.inverse(z, y, x))
        else:  # the kernel measures depth from the other side
            moved = y if a.skew == "Y" else x
            scan = (moved - z / a.tan) / a.step
            lateral = z / a.sin
            places.append((scan, lateral, x) if a.skew == "Y" else (scan, y, lateral))
    low, high = ([f(p[k] for p in places) for k in range(3)] for f in (min, max))
    wide = math.ceil(a.step * a.cos) + 2 if a.frame == "objective" else 2
    margin = (2, wide, wide)
    spans = [(max(0, math.floor(lo) - m), min(n, math.ceil(hi) + m + 1)) for lo, hi, n, m in zip(low, high, (a.nz, a.ny, a.nx), margin, strict=True)]
    return Box(*[(lo, max(lo, hi)) for lo, hi in spans])
