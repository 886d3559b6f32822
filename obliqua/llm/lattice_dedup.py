"""Embedding near-dedup by lattice hashing.

Each of several tables projects a unit vector at random to eight dimensions
and decodes it to the nearest point of the E8 lattice, its home cell; it also
visits the neighbouring cells that are next nearest.  Two vectors meet in a cell where one at
least is at home, and their cosine is computed there in double precision.

Equal vectors fall together first.  A cell with many vectors is split into
blocks, and pairs of blocks are dealt out, so that no task holds a whole cell.  A pair that
meets several times counts in the first table, in one fixed cell.  Tasks give sums of
links for each vector and a spanning forest of the links, never the pairs.

With the default parameters a pair at cosine 0.93 is met with a chance above
0.99 (the tests measure recall against brute force).

Defined cases: a vector that is null, empty, zero, or holds null or non-finite
components, and one without a label, links with nothing; vectors of different length never
link; rows that repeat count each other as links; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .components import components

TABLES, PROBES, SPREAD, BLOCK = 5, 5, 1.4, 256


@lru_cache(1)
def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps to neighbouring lattice points."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def nearest_d8(y: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: round, and where the sum is odd round the worst place the other way."""
    point = np.rint(y)
    off = y - point
    worst, rows = np.abs(off).argmax(1), np.arange(len(y))
    odd = point.sum(1).astype(np.int64) & 1
    point[rows, worst] += odd * np.where(off[rows, worst] >= 0, 1, -1)
    return point


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """E8 is D8 and its copy moved by a half in every place; the nearer of both wins."""
    whole, half = nearest_d8(y), nearest_d8(y - 0.5) + 0.5
    return np.where(((y - whole) ** 2).sum(1, keepdims=True) <= ((y - half) ** 2).sum(1, keepdims=True), whole, half)


@lru_cache(16)
def projection(size: int, table: int, spread: float) -> np.ndarray:
    return np.random.default_rng([size, table, 91]).standard_normal((size, 8)) / spread


def cells(unit: np.ndarray, table: int, probes: int, spread: float) -> np.ndarray:
    """Twice the home point and the visited points of each vector: (vectors, 1 + probes, 8) small integers."""
    y = unit @ projection(unit.shape[1], table, spread)
    home = nearest_e8(y)
    steps = minimal_vectors()
    near = np.argpartition(-((y - home) @ steps.T), probes, axis=1)[:, :probes]
    return np.rint(2 * np.concatenate([home[:, None], home[:, None] + steps[near]], 1)).astype(np.int64)


def cell_keys(points: np.ndarray, table: int, label: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit number for each (label, length, table, lattice point)."""
    factors = np.random.default_rng(17).integers(1, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = (points.astype(np.uint64) * factors).sum(-1, dtype=np.uint64)
    for extra in (label.astype(np.uint64)[:, None], np.uint64(table), np.uint64(size)):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + extra
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Valid vectors as unit vectors in double precision; two halves of a hash of the given values."""
    for batch in batches:
        unit, h1, h2 = [], [], []
        for label, vector in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            x = np.zeros(0)
            if label is not None and vector.is_valid and len(vector) and not vector.values.null_count:
                x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                top = np.abs(x).max()
                x = x / top if np.isfinite(x).all() and top > 0 else np.zeros(0)
            if len(x):
                digest = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
                a, b = struct.unpack("<qq", digest)
                unit.append((x / np.sqrt(x @ x)).tobytes())
            else:
                a = b = None
                unit.append(None)
            h1.append(a)
            h2.append(b)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(unit, pa.binary())], names=["vec_id", "label", "h1", "h2", "unit"])


def _codes(tables: int, probes: int, spread: float):
    """For each vector the keys of its cells, table by table, home first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column(2).to_pylist()
            labels = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.array([len(u) // 8 for u in units])
            keys = np.zeros((len(units), tables, 1 + probes), np.int64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = np.stack([np.frombuffer(units[i]) for i in rows])
                for t in range(tables):
                    keys[rows, t] = cell_keys(cells(x, t, probes, spread), t, labels[rows], int(size))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(units) + 1, dtype=np.int32) * (tables * (1 + probes))), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), lists], names=["rep", "unit", "w", "keys"])

    return run


def _pairs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places within each run [start, end)."""
    here = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends, strict=True)]) if len(starts) else np.zeros(0, np.int64)
    left = np.repeat(ends, ends - starts) - here - 1
    first = np.repeat(here, left)
    return first, first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(left) - left, left)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least node that it reaches by the edges."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _compare(threshold: float, tables: int, probes: int):
    """Links within groups of rows (sorted by cell and pair of blocks): (u, u, links) sums and (u, v, 0) forest edges."""
    width = 1 + probes

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        key, i, j, table, block, rep, w = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(7))
        keys = np.stack([np.frombuffer(x, np.int64) for x in batch.column(8).to_pylist()]).reshape(-1, tables, width)
        units = [np.frombuffer(x) for x in batch.column(7).to_pylist()]
        home = keys[np.arange(len(rep)), table, 0] == key
        cut = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
        large = ends - starts > 64
        a, b = _pairs(starts[~large], ends[~large])
        found = []
        meet = (home[a] | home[b]) & ((i[a] == j[a]) | (block[a] != block[b])) & (rep[a] != rep[b])
        a, b = a[meet], b[meet]
        for k in range(0, len(a), 20_000):
            x, y = np.stack([units[p] for p in a[k : k + 20_000]]), np.stack([units[p] for p in b[k : k + 20_000]])
            good = (x * y).sum(1) >= threshold
            found.append((a[k : k + 20_000][good], b[k : k + 20_000][good]))
        for s, e in zip(starts[large].tolist(), ends[large].tolist(), strict=True):
            x = np.stack(units[s:e])
            p, q = np.nonzero(np.triu(x @ x.T >= threshold, 1))
            p, q = p + s, q + s
            meet = (home[p] | home[q]) & ((i[p] == j[p]) | (block[p] != block[q])) & (rep[p] != rep[q])
            found.append((p[meet], q[meet]))
        a, b = np.concatenate([f[0] for f in found] or [np.zeros(0, int)]), np.concatenate([f[1] for f in found] or [np.zeros(0, int)])
        if not len(a):
            return None
        t = table[a]
        count = np.ones(len(a), bool)
        for k in range(0, len(a), 50_000):
            p, q, own = a[k : k + 50_000], b[k : k + 50_000], t[k : k + 50_000]
            # (pairs, tables): whether they meet in q's home cell, in p's
            at_q = (keys[p] == keys[q][:, :, :1]).any(2)
            at_p = (keys[q] == keys[p][:, :, :1]).any(2)
            earlier = np.arange(tables) < own[:, None]
            rows = np.arange(len(p))
            both = at_q[rows, own] & at_p[rows, own] & ~(home[p] & home[q])
            smaller_here = np.where(rep[p] < rep[q], home[p], home[q])
            count[k : k + 50_000] = ~((at_q | at_p) & earlier).any(1) & (~both | smaller_here)
        nodes, at = np.unique(np.concatenate([rep[a], rep[b]]), return_inverse=True)
        pa_, pb_ = at[: len(a)], at[len(a) :]
        sums = np.bincount(pa_[count], w[b][count], len(nodes)) + np.bincount(pb_[count], w[a][count], len(nodes))
        low = _forest(pa_, pb_, len(nodes))
        some, moved = np.flatnonzero(sums), np.flatnonzero(low != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([nodes[some], nodes[moved]])), pa.array(np.concatenate([nodes[some], nodes[low[moved]]])), pa.array(np.concatenate([sums[some].astype(np.int64), np.zeros(len(moved), np.int64)]))], names=["u", "v", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            for part in [batch.slice(k, 4000) for k in range(0, batch.num_rows, 4000)]:
                now = pa.Table.from_batches([part])
                now = now if rest is None else pa.concat_tables([rest, now])
                group = [now.column(k).to_numpy() for k in range(3)]
                last = np.flatnonzero((group[0] != group[0][-1]) | (group[1] != group[1][-1]) | (group[2] != group[2][-1]))
                whole = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
                rest = now.slice(whole)
                if whole and (out := work(now.slice(0, whole).combine_chunks().to_batches()[0])) is not None:
                    yield out
        if rest is not None and rest.num_rows and (out := work(rest.combine_chunks().to_batches()[0])) is not None:
            yield out

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, tables: int = TABLES, probes: int = PROBES, spread: float = SPREAD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    base = checkpointed(rows.mapInArrow(_units, "vec_id long, label long, h1 long, h2 long, unit binary"))
    same = ["label", "h1", "h2"]
    reps = base.filter("h1 is not null and vec_id is not null").groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.first("unit").alias("unit"))
    reps = checkpointed(reps)
    coded = checkpointed(reps.select("rep", "label", "unit", "w").mapInArrow(_codes(tables, probes, spread), "rep long, unit binary, w long, keys array<long>"))
    entries = coded.select("rep", F.posexplode("keys").alias("pos", "key")).select("rep", "key", F.floor(F.col("pos") / (1 + probes)).cast("int").alias("t"), (F.col("pos") % (1 + probes) == 0).alias("home"))
    met = entries.groupBy("key").agg(F.count("*").alias("n"), F.count_if("home").alias("at_home")).filter("n > 1 and at_home > 0").select("key", F.ceil(F.col("n") / block).cast("int").alias("nb"))
    placed = entries.join(met, "key").withColumn("block", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("nb")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "t", "block", "rep")
    # the cells' keys travel as bytes: eight for each cell
    packed = coded.mapInArrow(_packed, "rep long, unit binary, w long, codes binary")
    full = dealt.join(packed, "rep").select("key", "i", "j", "t", "block", "rep", "w", "unit", "codes")
    ordered = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = checkpointed(ordered.mapInArrow(_compare(threshold, tables, probes), "u long, v long, n long"))
    links = found.filter("u = v").groupBy("u").agg(F.sum("n").alias("n"))
    roots = components(found.filter("u <> v").select("u", "v"))
    by_rep = reps.select(*same, "rep", "w").join(links.withColumnRenamed("u", "rep"), "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    joined = base.select("vec_id", *same).join(by_rep, same, "left")
    component = F.coalesce("component", "rep", "vec_id")
    return joined.select("vec_id", F.coalesce(F.col("w") - 1 + F.coalesce("n", F.lit(0)), F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["rep", "unit", "w", "codes"])
