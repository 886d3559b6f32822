"""Best-fit packing by a grouping genetic algorithm on islands.

Documents longer than a sequence are cut into full pieces and a rest.  Pieces
are dealt at random into groups of about ``group_pieces``; within a group,
several islands breed packings of the same pieces from different seeds.  An
individual is the bin of each piece.  Crossover takes the well-filled bins of one
parent whole into the other, dissolves the bins there that hold a piece twice, and
best-fits the displaced pieces, longest first.  Between epochs each island's
elite travels to the next island of its group, as one row; at the end the best
elite of a group is its packing.  The pieces of each group's emptiest bin are packed again, across groups, until one group is left.

Only lengths travel between stages, and a group's size never depends on the
table's: rows are dealt by a number of their own, so that equal ones spread too.  Defined cases: null text is empty; an empty document is one id long;
equal documents or ids are packed each on its own; a null ``doc_id`` is kept;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, give_back, text_slices
from .tokens import WordEncoder

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
DEALT_SCHEMA = PIECE_SCHEMA + ", deal long"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long"
ELITE_SCHEMA = "grp long, island int, fitness double, bins binary"


def _pieces(tokenizer: str, end_id: int, capacity: int):
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # an encoder for the task alone: kept in the worker it would crowd the steps that follow
        own, tail = WordEncoder(tokenizer), np.array([end_id], "<u4").tobytes()
        deal = TaskContext.get().partitionId() << 40
        for batch in text_slices(batches):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), own.encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                ids += tail
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), deal))
                    deal += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "deal"])
        del own
        give_back()

    return run


class GroupingGA:
    """Packings of one group's lengths; all randomness comes from the seed."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: int):
        self.lengths, self.capacity = lengths.astype(np.int64), capacity
        self.order = np.argsort(-self.lengths, kind="stable")
        self.random = np.random.default_rng(seed)

    def best_fit(self, bins: np.ndarray, todo: np.ndarray) -> np.ndarray:
        """Puts the pieces of ``todo``, in its order, each into the fullest bin that has room.

        Bins wait in lists by their free space; an integer has a bit for each
        space that some bin has, so the tightest one is the lowest bit from the length up.
        """
        used = int(bins.max()) + 1 if len(bins) else 0
        filled = np.bincount(bins[bins >= 0], self.lengths[bins >= 0], minlength=used).astype(np.int64)
        spaces: dict[int, list[int]] = {}
        for b, s in enumerate((self.capacity - filled).tolist()):
            spaces.setdefault(s, []).append(b)
        mask = 0
        for s in spaces:
            mask |= 1 << s
        where = []
        for length in self.lengths[todo].tolist():
            tight = mask >> length
            if tight:
                space = length + (tight & -tight).bit_length() - 1
                waiting = spaces[space]
                b = waiting.pop()
                if not waiting:
                    mask ^= 1 << space
            else:
                space, b, used = self.capacity, used, used + 1
            where.append(b)
            left = space - length
            if mask >> left & 1:
                spaces[left].append(b)
            else:
                spaces[left] = [b]
                mask |= 1 << left
        bins[todo] = where
        return bins

    def fresh(self, noise: float) -> np.ndarray:
        """A best-fit packing of the pieces, longest first but for some noise in the order."""
        key = self.lengths * (1 + noise * self.random.random(len(self.lengths)))
        return self.best_fit(np.full(len(self.lengths), -1, np.int64), np.argsort(-key, kind="stable"))

    def fills(self, bins: np.ndarray) -> np.ndarray:
        return np.bincount(bins, self.lengths) / self.capacity

    def fitness(self, bins: np.ndarray) -> float:
        """Fewer bins first; among equals, fuller full bins (mean square of the fills)."""
        if not len(bins):
            return 0.0
        fills = self.fills(bins)
        return -float(len(fills)) + float(np.mean(fills**2))

    def cross(self, giver: np.ndarray, taker: np.ndarray) -> np.ndarray:
        """Whole well-filled bins of ``giver`` in ``taker``; what they displace is best-fitted anew."""
        fills = self.fills(giver)
        picked = (fills >= np.quantile(fills, 0.5)) & (self.random.random(len(fills)) < 0.5)
        given = picked[giver]
        broken = np.zeros(int(taker.max()) + 1, bool)
        broken[taker[given]] = True
        # a few of the emptiest bins open too, so that their pieces can fill others
        own = self.fills(taker)
        broken |= own <= np.quantile(own, 0.02)
        child = np.where(broken[taker], -1, taker)
        child[given] = giver[given] + len(broken)
        kept = child >= 0
        child[kept] = np.unique(child[kept], return_inverse=True)[1]
        free = self.order[child[self.order] < 0]
        return self.best_fit(child, free)

    def evolve(self, elites: list[np.ndarray], population: int, generations: int) -> np.ndarray:
        """The best individual after some generations of steady replacement of the worst."""
        if not len(self.lengths):
            return np.zeros(0, np.int64)
        least = -(-int(self.lengths.sum()) // self.capacity)
        people = list(elites)
        while len(people) < population:
            people.append(self.fresh(0.0 if not people else 0.1))
        scored = sorted(((self.fitness(p), i, p) for i, p in enumerate(people)), key=lambda x: (-x[0], x[1]))
        for step in range(generations):
            if -scored[0][0] <= least:  # as few bins as the lengths allow
                break
            a, b = self.random.choice(len(scored), 2, replace=False)
            child = self.cross(scored[min(a, b)][2], scored[max(a, b)][2])
            scored[-1] = (self.fitness(child), population + step, child)
            scored.sort(key=lambda x: (-x[0], x[1]))
        return scored[0][2]


def _in_order(pieces: pd.DataFrame) -> pd.DataFrame:
    """Every island sees the same order of pieces, however they arrive."""
    return pieces.sort_values(["length", "doc_id", "piece", "ids_crc32", "deal"], ascending=[False, True, True, True, True], kind="stable", ignore_index=True)


def pack_pieces(pieces: DataFrame, capacity: int = 4096, group_pieces: int = 4096, islands: int = 2, epochs: int = 2, population: int = 4, generations: int = 8) -> DataFrame:
    """``pieces`` with sequence_id and offset; they must be computed once and stay (a checkpoint).

    ``deal``, where there is such a column, spreads equal rows over the groups.
    """
    ga = {"capacity": capacity, "group_pieces": group_pieces, "islands": islands, "epochs": epochs, "population": population, "generations": generations}
    if "deal" not in pieces.columns:
        pieces = pieces.withColumn("deal", F.lit(0).cast("long"))
    out, rest = None, pieces
    for level in range(64):  # the emptiest bins hold a small share of the pieces, so a few rounds leave one group
        packed, groups = _pack_groups(rest, **ga)
        packed = packed.withColumn("sequence_id", F.col("sequence_id") + F.lit(level << 56))
        if groups > 1:
            packed = checkpointed(packed)
        again = groups > 1 and not packed.filter("not open").isEmpty()
        settled = (packed.filter("not open") if again else packed).drop("open", "deal")
        out = settled if out is None else out.unionByName(settled)
        if not again:
            break
        rest = packed.filter("open").select(*pieces.columns)
    return out


def _pack_groups(pieces: DataFrame, capacity: int, group_pieces: int, islands: int, epochs: int, population: int, generations: int) -> tuple[DataFrame, int]:
    """(the pieces with their places, whether in the emptiest bin of a group; number of groups)."""
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "deal", F.lit(7)), F.lit(groups)).cast("long"))
    on_islands = dealt.select("grp", "doc_id", "piece", "length", "ids_crc32", "deal", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"))

    def epoch(number: int):
        def run(key, items: pd.DataFrame, come: pd.DataFrame) -> pd.DataFrame:
            if not len(items):
                return pd.DataFrame({"grp": [], "island": [], "fitness": [], "bins": []})
            lengths = _in_order(items)["length"].to_numpy()
            island = GroupingGA(lengths, capacity, seed=hash((int(key[0]), int(key[1]), number)) & 0x7FFFFFFF)
            elites = [np.frombuffer(b, np.int32).astype(np.int64) for b in come.sort_values("fitness", ascending=False)["bins"]]
            best = island.evolve(elites, population, generations)
            return pd.DataFrame({"grp": [key[0]], "island": [key[1]], "fitness": [island.fitness(best)], "bins": [best.astype(np.int32).tobytes()]})

        return run

    elites = pieces.sparkSession.createDataFrame([], ELITE_SCHEMA)
    by = ["grp", "island"]
    for number in range(epochs):
        # the elite of the island before moves in beside the island's own
        moved = elites.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int"))
        elites = checkpointed(on_islands.groupBy(*by).cogroup(elites.unionByName(moved).groupBy(*by)).applyInPandas(epoch(number), ELITE_SCHEMA))
    best = elites.groupBy("grp").agg(F.max_by("bins", F.struct("fitness", -F.col("island"))).alias("bins"))

    settled = f"{PACKED_SCHEMA}, deal long, open boolean"

    def settle(key, items: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        if not len(items):
            return pd.DataFrame({c.split()[0]: [] for c in settled.split(", ")})
        items = _in_order(items)
        bins = np.frombuffer(chosen["bins"].iloc[0], np.int32).astype(np.int64)
        by_bin = np.argsort(bins, kind="stable")
        lengths = items["length"].to_numpy()[by_bin]
        before = np.cumsum(lengths) - lengths
        first = np.concatenate([[True], bins[by_bin][1:] != bins[by_bin][:-1]])
        offsets = np.empty(len(bins), np.int64)
        offsets[by_bin] = before - before[first][np.cumsum(first) - 1]
        emptiest = int(np.argmin(np.bincount(bins, items["length"].to_numpy())))
        return items.assign(sequence_id=(int(key[0]) << 24) + bins, offset=offsets, open=bins == emptiest).drop(columns="grp")

    return dealt.groupBy("grp").cogroup(best.groupBy("grp")).applyInPandas(settle, settled), groups


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, **ga) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece; see ``pack_pieces``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = checkpointed(rows.mapInArrow(_pieces(tokenizer, end_id, capacity), DEALT_SCHEMA))
    return pack_pieces(pieces, capacity, **ga)
