"""Labels of connected parts across blocks, and parts grown from seeds.

Each block labels its own voxels; voxels on faces of blocks meet their neighbours in other blocks by a join on their places; the
pairs of labels that touch are a small graph whose parts are found by star steps; labels are then numbered in scan order.  A block bounds
the memory of a task, and nothing of a slice passes through one task but the list of its labels.
"""

from __future__ import annotations

import tempfile
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.volume import KEYS
from .blocks import _flat
from .halo import MOST, SIZE, block_packed, shifted, stencil

PLACE = ["z", "y", "x"]
AROUND = [d for d in product((-1, 0, 1), repeat=3) if d != (0, 0, 0)]
#: Bits of a place along one axis; a place as one number keeps the scan order.
BITS = 21


def label_array(mask: np.ndarray) -> np.ndarray:
    """Labels of the components of a mask whose voxels touch by faces, edges or corners, numbered in scan order."""
    shape = np.array(mask.shape)
    number = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        padded = np.pad(np.where(mask, number, mask.size + 1), 1, constant_values=mask.size + 1)
        least = np.where(mask, number, mask.size + 1)
        for a in range(3):
            for b in range(3):
                for c in range(3):
                    least = np.minimum(least, padded[a : a + shape[0], b : b + shape[1], c : c + shape[2]])
        least = np.where(mask, least, 0)
        flat = np.concatenate([[0], least.ravel()])
        least = np.where(mask, flat[least], 0)  # jump on along what is known
        if (least == number).all():
            break
        number = least
    found, out = np.unique(number[mask], return_inverse=True)
    labels = np.zeros(mask.shape, np.int64)
    labels[mask] = out + 1
    return labels


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage cut by a reliable checkpoint; a folder is set only where a session on one machine names none."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="obliqua-checkpoint-"))
    return df.checkpoint(eager=True)


def _pieces(voxels: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """Voxels with ``piece``, the place (as a number) of the first voxel of their part within their block, and whether they lie on a face of it."""
    schema = pa.schema([*[(k, pa.int32()) for k in (*KEYS, *PLACE)], ("v", pa.float64()), ("piece", pa.int64()), ("face", pa.bool_())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        code = key[3].as_py()
        block = [p * s for p, s in zip((code // MOST // MOST, code // MOST % MOST, code % MOST), size, strict=True)]
        place, v = [_flat(table, k).astype(np.int64) for k in ("zs", "ls", "os")], _flat(table, "vs")
        low = [int(p.min()) for p in place]
        at = tuple(p - a for p, a in zip(place, low, strict=True))
        mask = np.zeros([int(p.max()) + 1 for p in at], bool)
        mask[at] = True
        label = label_array(mask)[at]
        number = (place[0] << 2 * BITS) | (place[1] << BITS) | place[2]
        first = np.full(int(label.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, label, number)
        face = np.logical_or.reduce([(p == b) | (p == b + s - 1) for p, b, s in zip(place, block, size, strict=True)])
        heads = [np.full(len(v), k.as_py(), np.int32) for k in key[:3]]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip((*heads, *place, v, first[label], face), schema.types, strict=True)], schema=schema)

    return block_packed(voxels, (0, 0, 0), size).groupBy(*KEYS, "block").applyInArrow(run, "image_id int, t int, c int, z int, y int, x int, v double, piece long, face boolean")


def _touching(pieces: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """(keys, u, v): pieces of different blocks with neighbouring voxels; only voxels on faces are shuffled."""
    faces = pieces.filter("face").select(*KEYS, *PLACE, "piece")
    ahead = F.array(*[F.struct(*[F.lit(n).alias(f"d{k}") for k, n in zip(PLACE, d, strict=True)]) for d in AROUND if d > (0, 0, 0)])
    near = faces.select(*KEYS, F.col("piece").alias("u"), *PLACE, F.inline(ahead))
    other: Column = F.lit(False)
    for k, s in zip(PLACE, size, strict=True):
        other = other | (F.floor((F.col(k) + F.col(f"d{k}")) / s) != F.floor(F.col(k) / s))
    moved = near.filter(other).select(*KEYS, "u", *[(F.col(k) + F.col(f"d{k}")).alias(k) for k in PLACE])
    return moved.join(faces.withColumnRenamed("piece", "v"), [*KEYS, *PLACE]).select(*KEYS, "u", "v").distinct()


def roots(pairs: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(keys, u, root): the least node that each node of the pairs (keys, u, v) is connected with.

    Large and small stars in turn: first every node ties its greater neighbours to the least node around it, then its
    smaller ones; the number of rounds grows with the logarithm of the longest chain.
    """
    columns = [*KEYS, "u", "v"]

    def star(tied: DataFrame, small: bool) -> DataFrame:
        around = tied if small else tied.unionByName(tied.select(*KEYS, F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy(*KEYS, "u").agg(F.least(F.col("u"), F.min("v")).alias("least"))
        met = around.join(least, [*KEYS, "u"]).filter("v <> least" if small else "v > u")
        out = met.select(*KEYS, F.col("v").alias("u"), F.col("least").alias("v"))
        own = least.filter("u <> least").select(*KEYS, "u", F.col("least").alias("v"))
        return (out.unionByName(own) if small else out).distinct()

    now = kept(pairs.select(*KEYS, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    mark, before = None, ()
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            return now.select(*KEYS, "u", F.col("v").alias("root"))
        before, now = mark, kept(star(star(now, small=False), small=True))
    raise RuntimeError(f"labels have not settled after {most_rounds} rounds")


def label_blocks(voxels: DataFrame, size: tuple[int, int, int] = SIZE) -> DataFrame:
    """``label`` (long) for each voxel of a mask: parts that touch by faces, edges or corners, numbered from 1 in scan order in each slice.

    Places run from 0 to 2 ** 21; other columns are left out.
    """
    pieces = _pieces(voxels, size)
    tied = roots(_touching(pieces, size))
    names = pieces.select(*KEYS, "piece").distinct().join(tied.withColumnRenamed("u", "piece"), [*KEYS, "piece"], "left")
    order = Window.partitionBy(*KEYS).orderBy(F.coalesce("root", "piece"))  # a row for each piece of a slice
    numbered = names.select(*KEYS, "piece", F.dense_rank().over(order).cast("long").alias("label"))
    return pieces.join(numbered, [*KEYS, "piece"]).select(*KEYS, *PLACE, "v", "label")


STEPS = 8


def grow(seeds: DataFrame, mask: DataFrame, shape: tuple[int, int, int], size: tuple[int, int, int] = SIZE) -> DataFrame:
    """(keys, z, y, x, label): the seeds' labels carried over the mask, a step to all neighbours at a time; of labels that arrive together the greatest stays.

    Each round goes ``STEPS`` steps within a halo of as many voxels and ends when no voxel has got a label; parts without a seed get none.
    """

    def work(values: np.ndarray, held: np.ndarray):
        label = values - held  # a voxel of the mask holds 1 more than its label, as 0 stands for no voxel
        for _ in range(STEPS):
            wide = np.pad(label, 1)
            near = np.maximum.reduce([shifted(wide, d, (1, 1, 1)) for d in AROUND])
            label = np.where(held & (label == 0), near, label)
        own = tuple(slice(STEPS, n - STEPS) for n in values.shape)
        return label[own] + 1, held[own]

    state = mask.select(*KEYS, *PLACE).join(seeds.select(*KEYS, *PLACE, "label"), [*KEYS, *PLACE], "left").select(*KEYS, *PLACE, (F.coalesce("label", F.lit(0)) + 1).cast("double").alias("v"))
    state, before = kept(state), -1
    while (now := state.filter("v > 1").count()) != before:
        before, state = now, kept(stencil(state, (STEPS,) * 3, work, shape, size))
    return state.filter("v > 1").select(*KEYS, *PLACE, (F.col("v") - 1).cast("long").alias("label"))


def maxima(blurred: DataFrame, shape: tuple[int, int, int], size: tuple[int, int, int] = SIZE) -> DataFrame:
    """Voxels above 0 that no neighbour exceeds."""

    def work(values: np.ndarray, held: np.ndarray):
        own = shifted(values, (0, 0, 0), (1, 1, 1))
        top = np.maximum.reduce([shifted(values, d, (1, 1, 1)) for d in AROUND])
        return own, (own > 0) & (own >= top)

    return stencil(blurred, (1, 1, 1), work, shape, size)
