"""Geometry as columns, over a table of acquisitions: (nz, ny, nx, dz, dy, dx, angle, skew, frame).

The same sizes, maps and voxels as ``geometry.Acquisition`` gives for one, worked out by Spark for a catalogue of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEVICE_ITEM, SAFETY = 4, 1.5


def _angles() -> tuple[Column, Column]:
    turned = F.radians(F.col("angle"))
    return F.sin(turned), F.cos(turned)


def _lateral() -> tuple[Column, Column]:
    """The size of the skewed lateral axis, and of its voxels."""
    along_y = F.col("skew") == "Y"
    return F.when(along_y, F.col("ny")).otherwise(F.col("nx")), F.when(along_y, F.col("dy")).otherwise(F.col("dx"))


def with_geometry(acquisitions: DataFrame) -> DataFrame:
    """Adds out_z, out_y, out_x (the deskewed size) and new_dz (the height of its voxels); null where a value is."""
    sin, cos = _angles()
    n, d = _lateral()
    step = F.col("dz") / d
    last = F.col("nz") - 1
    shear = F.ceil(last * (sin * step)) + 1, F.ceil(last * (cos * step) + (n - 1)) + 1
    # the product of shear, scale and rotation, in the order that its rounding hangs on
    scale, lean = sin * F.col("dz") / d, F.sin(F.radians(90 - F.col("angle"))) * step
    turn = ((cos * scale + -sin * lean, -sin), (sin * scale + cos * lean, cos))
    objective = []
    for a, b in turn:
        ends = [a * z + b * lat for z in (F.lit(0), F.col("nz")) for lat in (F.lit(0), n)]
        objective.append(F.bround(F.greatest(*ends) - F.least(*ends)))
    in_shear = F.col("frame") == "shear"
    depth, lateral = (F.when(in_shear, s).otherwise(o).cast("int") for s, o in zip(shear, objective, strict=True))
    along_y = F.col("skew") == "Y"
    return acquisitions.withColumns({
        "out_z": depth, "out_y": F.when(along_y, lateral).otherwise(F.col("ny")).cast("int"), "out_x": F.when(along_y, F.col("nx")).otherwise(lateral).cast("int"),
        "new_dz": F.when(in_shear, d).otherwise(sin * F.col("dz")),
    })


def display_matrices(acquisitions: DataFrame, flipped: bool = False) -> DataFrame:
    """All columns, and a row for each cell (i, j, v) of the 4x4 matrix from raw places (z, y, x, 1) to deskewed ones; a flipped scan is turned back first."""
    sin, cos = _angles()
    n, d = _lateral()
    step = F.col("dz") / d
    zero, one = F.lit(0.0), F.lit(1.0)
    in_shear, along_y = F.col("frame") == "shear", F.col("skew") == "Y"
    depth = [F.when(in_shear, sin * step).otherwise(zero), F.when(in_shear, zero).otherwise(-sin), F.when(in_shear, zero).otherwise(n * sin)]
    moved = [F.when(in_shear, cos * step).otherwise(step), F.when(in_shear, one).otherwise(cos), zero]
    still = [zero, zero, zero]

    def row(values: list[Column], other: Column) -> list[Column]:
        """Cells by z, y, x and the constant, from those by scan, lateral axis and constant."""
        scan, lateral, shift = values
        cells = [scan, F.when(along_y, lateral).otherwise(other), F.when(along_y, other).otherwise(lateral), shift]
        return [-cells[0], *cells[1:3], cells[3] + cells[0] * (F.col("nz") - 1)] if flipped else cells

    to_y = [F.when(along_y, m).otherwise(s) for m, s in zip(row(moved, zero), row(still, one), strict=True)]
    to_x = [F.when(along_y, s).otherwise(m) for m, s in zip(row(moved, zero), row(still, one), strict=True)]
    rows = [row(depth, zero), to_y, to_x, [zero, zero, zero, one]]
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (v + 0.0).alias("v")) for i, r in enumerate(rows) for j, v in enumerate(r)])
    return acquisitions.select("*", F.inline(cells))


def volume_estimates(acquisitions: DataFrame, item: int, written: int) -> DataFrame:
    """All columns, and bytes for deskewing each whole volume, from pixels of ``item`` bytes to pixels of ``written``; what fits is a comparison away."""
    made = with_geometry(acquisitions)
    size = lambda *names: F.col(names[0]).cast("long") * F.col(names[1]) * F.col(names[2])
    inside, outside = size("nz", "ny", "nx"), size("out_z", "out_y", "out_x")
    return made.select(
        *acquisitions.columns, inside.alias("voxels_in"), outside.alias("voxels_out"), (F.greatest(inside, outside) * DEVICE_ITEM).alias("largest_buffer"),
        F.floor((inside + outside) * DEVICE_ITEM * F.lit(SAFETY)).alias("device_set"), (inside * item + outside * (DEVICE_ITEM + written)).alias("host_peak"),
    )
