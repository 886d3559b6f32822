"""Memory and worker estimates from shapes alone, as columns over a region table."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dtypes import ITEM_SIZES, output_type
from ..functions.geometry import Acquisition, Box, crop_plan

DEVICE_ITEM, RESERVE, SAFETY = 4, 512 << 20, 1.5


@dataclass(frozen=True)
class Limits:
    """What the machine has, in bytes; None where it cannot be told."""

    device_total: int | None = None
    device_buffer: int | None = None
    host_free: int | None = None
    cpus: int | None = None

    @property
    def device_budget(self) -> int | None:
        return None if self.device_total is None else max(0, self.device_total - RESERVE)


def slurm_bytes(text: str) -> int | None:
    """A scheduler's memory size: K, M, G or T, a bare number in MiB; 0 and what cannot be read are None."""
    text = text.strip().upper()
    power = {"K": 1, "M": 2, "G": 3, "T": 4}.get(text[-1:])
    try:
        size = int(float(text if power is None else text[:-1]) * 1024 ** (2 if power is None else power))
    except ValueError:
        return None
    return size if size > 0 else None


def slurm_bytes_column(text: Column) -> Column:
    clean = F.upper(F.trim(text))
    number = F.regexp_extract(clean, r"^([0-9]+(?:\.[0-9]+)?)[KMGT]?$", 1)
    unit = F.regexp_extract(clean, r"^[0-9.]+([KMGT])$", 1)
    factor = F.when(unit == "K", 1 << 10).when(unit == "G", 1 << 30).when(unit == "T", 1 << 40).otherwise(1 << 20)
    size = F.floor(number.try_cast("double") * factor).cast("long")
    return F.when(size > 0, size)


def format_bytes_column(size: Column) -> Column:
    """Like "1.50 GiB": the largest of B, KiB, MiB, GiB, TiB that is not above the size; unknown sizes say so."""
    amount = size.cast("double")
    out = F.when(size.isNull(), "unknown").when(amount < 1024, F.format_string("%d B", size.cast("long")))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        text = F.format_string(f"%.2f {unit}", amount / 1024.0**power)
        out = out.when(amount < 1024.0 ** (power + 1), text) if unit != "TiB" else out.otherwise(text)
    return out


def host_limit(available: int | None, environment: dict[str, str] | None = None) -> int | None:
    """The smaller of the scheduler's cap and the free memory; the cap for a node goes before that for a CPU."""
    env = os.environ if environment is None else environment
    cap = slurm_bytes(env["SLURM_MEM_PER_NODE"]) if env.get("SLURM_MEM_PER_NODE") else None
    if not env.get("SLURM_MEM_PER_NODE") and env.get("SLURM_MEM_PER_CPU") and env.get("SLURM_CPUS_PER_TASK"):
        one = slurm_bytes(env["SLURM_MEM_PER_CPU"])
        cap = one * int(env["SLURM_CPUS_PER_TASK"]) if one else None
    known = [x for x in (cap, available) if x is not None]
    return min(known) if known else None


SHAPES = "roi_index int, in_z int, in_y int, in_x int, mid_z int, mid_y int, mid_x int, out_z int, out_y int, out_x int"


def region_shapes(spark, a: Acquisition, boxes: dict[int, Box]) -> DataFrame:
    """Raw block, deskewed block and crop of each region, of a short list, worked out on the driver."""
    rows = []
    for index, box in boxes.items():
        raw = crop_plan(a, box).raw
        middle = a.subblock(raw).output_shape if min(raw.shape) > 0 else (0, 0, 0)
        rows.append((index, *raw.shape, *middle, *box.shape))
    return spark.createDataFrame(rows, SHAPES)


def region_estimate(shapes: DataFrame, item_size: int, safety: float = SAFETY) -> DataFrame:
    """Bytes of each region: on the host, on the device, its largest buffer and working sets."""
    product = lambda p: F.col(f"{p}_z").cast("long") * F.col(f"{p}_y") * F.col(f"{p}_x")
    sized = shapes.select("roi_index", (product("in") * item_size).alias("host_input"), (product("in") * DEVICE_ITEM).alias("device_input"), (product("mid") * DEVICE_ITEM).alias("device_middle"))
    return sized.select("*", F.greatest("device_input", "device_middle").alias("largest_buffer"), F.floor((F.col("device_input") + F.col("device_middle")) * safety).cast("long").alias("device_set"), F.floor(F.col("host_input") * safety).cast("long").alias("host_set"))


def workers(estimates: DataFrame, limits: Limits) -> DataFrame:
    """One row: peaks, totals and the recommended number of workers.

    1 without regions; 0 if a buffer is larger than the device allows; else as
    many as both memories, the regions and the CPUs allow, one at least.
    """
    top = estimates.agg(F.count("*").alias("n_rois"), F.coalesce(F.max("device_set"), F.lit(0)).alias("device_peak"), F.coalesce(F.max("host_set"), F.lit(0)).alias("host_peak"), F.coalesce(F.max("largest_buffer"), F.lit(0)).alias("buffer_peak"))
    caps = [F.col("n_rois")]
    if limits.cpus is not None:
        caps.append(F.lit(limits.cpus))
    for budget, peak in ((limits.device_budget, "device_peak"), (limits.host_free, "host_peak")):
        if budget is not None:
            caps.append(F.when(F.col(peak) > 0, F.floor(F.lit(budget) / F.col(peak))).otherwise(F.col("n_rois")))
    most = F.greatest(F.lit(1), F.least(*caps) if len(caps) > 1 else caps[0])
    broken = F.lit(False) if limits.device_buffer is None else F.col("buffer_peak") > limits.device_buffer
    return top.withColumn("workers", F.when(F.col("n_rois") == 0, 1).when(broken, 0).otherwise(most).cast("long"))


def volume_estimate(spark, a: Acquisition, dtype: str, limits: Limits, deconvolved: bool = False, safety: float = SAFETY) -> DataFrame:
    """One row for deskewing a whole volume: bytes and whether they fit; null where a limit is unknown."""
    voxels_in, voxels_out = a.nz * a.ny * a.nx, math.prod(a.output_shape)
    device = int((voxels_in + voxels_out) * DEVICE_ITEM * safety)
    host = voxels_in * ITEM_SIZES[dtype] + voxels_out * (DEVICE_ITEM + ITEM_SIZES[output_type(dtype, deconvolved)])
    buffer = max(voxels_in, voxels_out) * DEVICE_ITEM
    known = lambda limit, value: None if limit is None else value <= limit
    row = (voxels_in, voxels_out, buffer, device, host, None if limits.device_buffer is None else buffer > limits.device_buffer, known(limits.device_budget, device), known(limits.host_free, host))
    return spark.createDataFrame([row], "voxels_in long, voxels_out long, largest_buffer long, device_set long, host_peak long, exceeds_buffer boolean, fits_device boolean, fits_host boolean")


def chunks(rois: DataFrame, count: int, n_rois: int) -> DataFrame:
    """Regions dealt round in turn: (chunk, rois); regions number from 0 in order, empty chunks do not show."""
    from pyspark.sql import Window

    n = max(1, min(count, n_rois))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("roi_index")) - 1  # a short list
    return rois.select("roi_index", F.pmod(place, F.lit(n)).alias("chunk")).groupBy("chunk").agg(F.sort_array(F.collect_list("roi_index")).alias("rois"))
