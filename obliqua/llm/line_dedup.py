"""Line dedup by a segment-partition edit join.

A line of ``least_equal`` bytes or more (those of ``least_bytes``, if not given; 1 takes every
line that is not blank) repeats if an equal line comes before it.  One of
``least_bytes`` bytes or more also repeats if its text is within ``edits`` edits (in UTF-8 bytes)
of another such line whose first occurrence comes before its own; where ``percent`` of the shorter
line's bytes are more than that, so many edits, 15 at most.  Lines come in the order of (doc_id, hash of the text, line number).
Repeats are removed; a document left without any text is dropped.

Equal lines: a line that its slice of texts has met before repeats for certain; only the
first places of each slice are shuffled, as hashes.  Near lines: each distinct line
of a slice is indexed by the keys of its segments (``line_segments``).  Keys travel in packed
blocks to the bucket of their range and are sorted there; lines that share one form a set.  Equal sets are joined into one, the
lines of each set are fetched (behind a filter of bounded size), and a set is walked in order of first places: each line is
compared, by a banded bit-parallel edit distance, with those before it until one is near.  So a line has one row a
set, whatever the number of its near lines.  The sets of a family of lines share most of them.  Sets that share a line follow the least line of any of
them, their lead, and those of one lead go to one task, where a pair is compared once; where they hold more pairs than all their lines have, they become one set.  What is more
than the pairs of ``LEAD_LINES`` lines goes to several tasks, each of which asks about some of the lines.  A set beyond ``PART`` lines is cut into parts.  Each part is walked together with the
first one; only lines that have met none before them there go on, gathered anew, to all other parts.  So the rows of a family of
near lines grow with its lines, not with pairs of parts.  A key that a sample of the lines shows to be in very many goes through several buckets.  Every route compares everything.

Defined cases: null text has no lines; blank lines and those under both bounds are never touched;
documents with a null ``doc_id`` are kept as they are; rows with the same ``doc_id`` and different texts are
different documents, rows that repeat as a whole are one document and all keep or lose the same lines; extra columns are kept;
an empty table stays empty.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, checkpointed, free_names, give_back, string_bytes, text_slices
from .edit_distance import near_pairs
from .line_segments import POST, allowed, picked, segment_keys
from .shingles import mix
from .tokens import forget

SLICE = 1 << 20
PART = 1 << 14  # lines of a set, or of a part of one, that are walked together
FLUSH = 1 << 19  # keys that a task sorts before it sends them
BUCKET_BYTES = 1 << 21  # bytes of text to a bucket, some 200,000 keys
MANY_BYTES = 1 << 32  # above, buckets and what is sent at a time are twice as large, as keys of one sending and bucket get few
HOT_LINES = 4_000_000  # a key in more lines than this is dealt to several buckets
SAMPLE_LINES = 1 << 20
LEAD_LINES = 1 << 11  # one task walks the pairs of so many lines
FAMILY = 16  # lines of a set that may follow another's lead
#: A line's number in the index has 48 bits: its length in bytes, or ``LONGEST``, and so many bits of its hash.
HASHED, LONGEST = 36, (1 << 12) - 1


def _numbers(h1: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of lines in the index; lines that share one are told apart by their texts."""
    return h1.view(np.uint64) & np.uint64((1 << HASHED) - 1) | np.minimum(sizes, LONGEST).astype(np.uint64) << np.uint64(HASHED)


def _some_lines(raw: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, number within it, start, end) of every line of ``least`` bytes or more, blank ones left out."""
    breaks = np.flatnonzero(raw == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    text = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((starts, text))
    starts, text = starts[order], text[order]
    ends = np.concatenate([starts[1:] - 1, [len(raw)]]) if len(starts) else starts
    last = np.concatenate([text[1:] != text[:-1], [True]]) if len(text) else np.zeros(0, bool)
    ends[last] = offsets[text[last] + 1]
    number = np.arange(len(text)) - np.searchsorted(text, np.arange(len(offsets) - 1))[text]
    keep = ends - starts >= max(1, least)
    begin = raw[starts[keep]]
    doubtful = np.flatnonzero(keep)[(begin == 32) | ((begin >= 9) & (begin <= 13))]
    keep[[i for i in doubtful.tolist() if not raw[starts[i] : ends[i]].tobytes().strip(b" \t\n\r\x0b\x0c")]] = False
    return text[keep], number[keep], starts[keep], ends[keep]


class _Slice:
    """The lines of a slice of texts and their hashes, two of 64 bits a line."""

    def __init__(self, batch: pa.RecordBatch, least: int):
        self.raw, offsets = string_bytes(batch.column(batch.schema.get_field_index("text")))
        self.text, self.number, self.starts, self.ends = _some_lines(self.raw, offsets, least)
        data, digest = memoryview(self.raw), xxhash.xxh3_128_digest
        both = np.frombuffer(b"".join([digest(data[a:b]) for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]), np.int64).reshape(-1, 2)
        self.h1, self.h2 = both[:, 0], both[:, 1]
        if len(self.text):
            self.doc, self.row = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)[self.text] for c in ("doc_id", "row"))
        else:
            self.doc = self.row = np.zeros(0, np.int64)

    def firsts(self, some: np.ndarray) -> np.ndarray:
        """Of the given lines, those that come first among their equals."""
        some = some[np.lexsort((self.number[some], self.row[some], self.doc[some], self.h2[some], self.h1[some]))]
        new = np.ones(len(some), bool)
        new[1:] = (self.h1[some][1:] != self.h1[some][:-1]) | (self.h2[some][1:] != self.h2[some][:-1])
        return some[new]


PLACE = "doc_id long, row long, line int"
PLACE_COLUMNS = ("doc_id", "row", "line")


def _places(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # a worker may have packed sequences before
        for batch in text_slices(batches, SLICE):
            s = _Slice(batch, least)
            again = np.ones(len(s.h1), bool)
            again[s.firsts(np.arange(len(s.h1)))] = False
            yield pa.RecordBatch.from_arrays([pa.array(s.doc), pa.array(s.row), pa.array(s.number, pa.int32()), pa.array(s.h1), pa.array(s.h2), pa.array(again)], names=[*PLACE_COLUMNS, "h1", "h2", "again"])

    return run


@functools.cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """Of this worker: a block takes less time than a new one."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(keys: np.ndarray, ids: np.ndarray, counts: np.ndarray, checks: np.ndarray) -> bytes:
    """Sorted keys, without their last 16 bits, as differences; and the ids: each as planes of bytes; then counts and checks."""
    keys = keys >> np.uint64(16)
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    planes = np.concatenate([steps.T, ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T])
    return _zstd()[0].compress(planes.tobytes() + counts.tobytes() + checks.tobytes())


def _unpack(block: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(_zstd()[1].decompress(block), np.uint8)
    planes, out = data[: 12 * n].reshape(12, n), []
    for part in (planes[:6], planes[6:]):
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :6] = part.T
        out.append(wide.view("<u8").ravel())
    return np.cumsum(out[0], dtype=np.uint64), out[1], data[12 * n : 13 * n], data[13 * n :]


def _new_lines(h1: np.ndarray, h2: np.ndarray, seen: tuple[np.ndarray, np.ndarray], most: int = 1_000_000) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """One place of each distinct line, by both its hashes, that the task has not met lately; and what it has met since.

    Of lines with one first hash a single one is remembered; another is sent again, and counts once in its bucket.
    """
    one = np.lexsort((h2, h1))
    one = one[np.concatenate([[True], (h1[one][1:] != h1[one][:-1]) | (h2[one][1:] != h2[one][:-1])])] if len(one) else one
    known, other = seen
    if len(known):
        at = np.minimum(np.searchsorted(known, h1[one]), len(known) - 1)
        one = one[(known[at] != h1[one]) | (other[at] != h2[one])]
    if len(known) >= most:
        return one, (h1[one], h2[one])
    at = np.searchsorted(known, h1[one])
    return one, (np.insert(known, at, h1[one]), np.insert(other, at, h2[one]))


BLOCK_SCHEMA = "bucket long, hot long, salt long, n int, block binary"
BLOCK_NAMES = ["bucket", "hot", "salt", "n", "block"]


def _blocks(edits: int, least: int, percent: int, buckets: int, hot: np.ndarray, salts: int, flush: int = FLUSH):
    """The keys of each line in packed blocks, one for each bucket; hot keys have buckets of their own, ``salts`` each."""

    def packed(keys: np.ndarray, ids: np.ndarray, counts: np.ndarray, checks: np.ndarray) -> Iterator[tuple]:
        bucket, hot_key, salt = ((keys >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64), None, 0
        if len(hot):
            at = np.minimum(np.searchsorted(hot, keys >> np.uint64(16)), len(hot) - 1)
            bucket = np.where(hot[at] == keys >> np.uint64(16), buckets + at * salts + (mix(ids) % np.uint64(salts)).astype(np.int64), bucket)
        order = np.lexsort((keys, bucket)) if len(hot) else np.argsort(keys)
        checks = checks[picked(order, counts % POST)]
        keys, ids, counts, bucket = keys[order], ids[order], counts[order], bucket[order]
        ends = np.concatenate([[0], np.cumsum((counts % POST).astype(np.int64))])
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)).tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            number = int(bucket[a])
            if number >= buckets:
                hot_key, salt = int(hot[(number - buckets) // salts]), (number - buckets) % salts
            yield number, hot_key, salt, b - a, _pack(keys[a:b], ids[a:b], counts[a:b], checks[ends[a] : ends[b]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: list[tuple[np.ndarray, ...]] = []
        size, seen = 0, (np.zeros(0, np.uint64), np.zeros(0, np.int64))

        def send() -> Iterator[pa.RecordBatch]:
            rows = list(packed(*(np.concatenate(x) for x in zip(*held, strict=True))))
            for a in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 64], strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=BLOCK_NAMES)

        for batch in text_slices(batches, SLICE):
            s = _Slice(batch, least)
            one, seen = _new_lines(s.h1.view(np.uint64), s.h2, seen)
            ids = _numbers(s.h1[one], (s.ends - s.starts)[one])
            if len(ids):
                keys, line, counts, checks = segment_keys(s.raw, s.starts[one], s.ends[one], edits, percent, least)
                held.append((keys, ids[line], counts, checks))
                size += len(keys)
                if size >= flush:
                    yield from send()
                    held, size = [], 0
        if held:
            yield from send()
            held = []
        give_back()

    return run


def _sampled_keys(edits: int, least: int, percent: int, share: float):
    """key, n: how many of a share of the distinct lines of each slice, chosen by hash, have a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, SLICE):
            s = _Slice(batch, least)
            ids, one = np.unique(_numbers(s.h1, s.ends - s.starts), return_index=True)
            one = one[mix(ids).astype(np.float64) < share * 2.0**64]
            keys, n = np.unique(segment_keys(s.raw, s.starts[one], s.ends[one], edits, percent, least)[0] >> np.uint64(16), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])

    return run


def hot_keys(docs: DataFrame, edits: int, least: int, percent: int, lines: int, most: int) -> np.ndarray:
    """Sorted keys that about ``most`` lines or more have, judged by ``SAMPLE_LINES`` lines or fewer.

    It only decides on the route of a key.  There are none if there are no more lines than that; else
    the bound of the sample bounds the list.
    """
    if lines <= most:
        return np.zeros(0, np.uint64)
    share = min(1.0, SAMPLE_LINES / lines)
    counts = docs.mapInArrow(_sampled_keys(edits, least, percent, share), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = counts.filter(F.col("n") >= max(4, int(most * share))).select("key").toPandas()
    return np.sort(found["key"].to_numpy(np.int64).view(np.uint64))


SET_SCHEMA = "unit long, part long, cut boolean, ids array<long>"


def _sets(most: int, edits: int, percent: int):
    """The sets of two lines or more that share a key, of all blocks of a bucket; equal ones once.

    Lines of a key come by their lengths.  Where one is longer than the one before it by more than that may be edited, a set ends: as bounds
    rise with the length, no line behind is near one before.  A key that is dealt to several buckets stays one set.
    """

    def run(table: pa.Table) -> pa.Table:
        salt, hot = table.column("salt")[0].as_py(), table.column("hot")[0].as_py()  # the same in all rows of a bucket
        blocks = [_unpack(block, n) for block, n in zip(table.column("block").to_pylist(), table.column("n").to_pylist(), strict=True)]
        keys, ids, counts, checks = (np.concatenate(x) for x in zip(*blocks, strict=True))
        order = np.argsort(keys)
        if hot is None:
            same = keys[order][1:] == keys[order][:-1]
            shared = np.zeros(len(keys), bool)
            shared[1:] |= same
            shared[:-1] |= same
            order = order[shared]
        keys, ids, own, sizes, checks = keys[order], ids[order], counts[order] >= POST, (counts % POST)[order].astype(np.int64), checks[picked(order, counts % POST)]
        # from here on a key has the byte of a substring's hash as well
        first = np.zeros(len(checks), bool)
        first[np.cumsum(sizes) - sizes] = True
        keys, ids, own = np.repeat(keys, sizes) << np.uint64(8) | checks, np.repeat(ids, sizes), np.repeat(own, sizes) & first
        order = np.lexsort((~own, ids, keys))
        keys, ids, own = keys[order], ids[order], own[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
        keys, ids, own = keys[new], ids[new], own[new]
        apart = keys[1:] != keys[:-1]
        if hot is None:
            size = (ids >> np.uint64(HASHED)).astype(np.int64)
            apart |= np.diff(size) > allowed(size[:-1], edits, percent)
        edges = np.flatnonzero(np.concatenate([[True], apart, [True]])) if len(keys) else np.zeros(1, np.int64)
        sizes = np.diff(edges)
        posts = np.add.reduceat(own, edges[:-1], dtype=np.int64) if len(keys) else np.zeros(0, np.int64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(ids))])
        names = mix(sums[edges[1:]] - sums[edges[:-1]] + sizes.astype(np.uint64)).view(np.int64)
        unit, part, cut, start, end = [], [], [], [], []
        whole = np.flatnonzero((sizes > 1) & (posts > 0) & (sizes <= most)) if hot is None else np.zeros(0, np.int64)
        whole = whole[np.unique(names[whole], return_index=True)[1]]
        unit.append(names[whole])
        part.append(np.zeros(len(whole), np.int64))
        cut.append(np.zeros(len(whole), bool))
        start.append(edges[whole])
        end.append(edges[whole + 1])
        for g in (np.flatnonzero((sizes > most) & (posts > 0)) if hot is None else range(len(sizes))):
            at = np.arange(edges[g], edges[g + 1], most)
            # parts of a hot key meet from several buckets by the key; a key that is not may have several sets
            unit.append(np.full(len(at), names[g] if hot is None else keys[edges[g]].astype(np.int64), np.int64))
            part.append(np.arange(len(at)) + (salt << 32))
            cut.append(np.ones(len(at), bool))
            start.append(at)
            end.append(np.minimum(at + most, edges[g + 1]))
        start, end = np.concatenate(start), np.concatenate(end)
        values = np.concatenate([ids[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)] or [ids[:0]]).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(end - start)]), pa.int32()), pa.array(values))
        del order, first, own, checks, keys, ids
        give_back()
        return pa.table([pa.array(np.concatenate(unit)), pa.array(np.concatenate(part)), pa.array(np.concatenate(cut)), lists], names=["unit", "part", "cut", "ids"])

    return run


FILTER_WORDS, MOST_WORDS = 1 << 17, 1 << 21


def filter_words(lines: int) -> int:
    """Words of a filter for so many lines: two bits or more a line, from one megabyte to 16."""
    words = FILTER_WORDS
    while 32 * words < lines and words < MOST_WORDS:
        words *= 2
    return words


def candidate_filter(ids: DataFrame, size: int = FILTER_WORDS) -> np.ndarray:
    """A bit for each line number in ``size`` words, set by a distributed aggregate.

    It only spares work: what it lets through is joined exactly later, so its
    bounded size bounds the broadcast and never the result.
    """
    picked = ids.select(F.pmod(F.shiftrightunsigned("id", 6), F.lit(size)).alias("word"), F.expr("shiftleft(1L, cast(id & 63 as int))").alias("bit"))
    words = picked.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(size, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


SENT = 1 << 17


def _texts(least: int, wanted):
    """The wanted lines where their slice has them first, unless the task has lately sent one from an earlier place.

    So a line that is all over the table leaves a task about once, with no sort of texts before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sent = wanted.value, {}
        for batch in text_slices(batches, SLICE):
            s = _Slice(batch, least)
            u = _numbers(s.h1, s.ends - s.starts)
            some = (words[(u >> np.uint64(6)).astype(np.int64) % len(words)] >> (u & np.uint64(63)).astype(np.int64)) & 1 == 1
            some = s.firsts(np.flatnonzero(some))
            if len(sent) > SENT:
                sent.clear()
            new = np.ones(len(some), bool)
            for i, (h1, h2, *place) in enumerate(zip(*(x[some].tolist() for x in (s.h1, s.h2, s.doc, s.row, s.number)), strict=True)):
                new[i] = place < sent.get((h1, h2), [np.inf])
                if new[i]:
                    sent[h1, h2] = place
            some = some[new]
            data = s.raw.tobytes()
            lines = pa.array([data[a:b] for a, b in zip(s.starts[some].tolist(), s.ends[some].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(u[some].view(np.int64)), pa.array(s.doc[some]), pa.array(s.row[some]), pa.array(s.number[some], pa.int32()), lines], names=["id", *PLACE_COLUMNS, "text"])

    return run


def _kinds(raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How often each line has a byte of each of 32 kinds; an edit moves two of the numbers by one at most, or one of them and the length."""
    counts = np.bincount(np.repeat(np.arange(len(sizes)) * 32, sizes) + (raw & 31), minlength=32 * len(sizes)).reshape(-1, 32)
    return np.minimum(counts, 32767).astype(np.int16)


def _walk(edits: int, percent: int, most_bytes: int = 16 << 20):
    """The first places of the lines that are near one before them in their set; rows, a line with its sets of one lead, come sorted by lead.

    A line that is known to be near one before it is not compared again, nor is a pair; sets with one lead, which share lines, come together
    as far as ``most_bytes`` of their lines go.  Only lines of side 0 are asked about; where ``a`` and ``b`` differ, they are only compared with those of side 1.
    """

    def walk(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """All sets of whole leads; those of a lead beyond ``most_bytes`` some at a time."""
        sets = rows.column(1).combine_chunks()
        held = np.repeat(np.arange(rows.num_rows), sets.value_lengths().to_numpy(zero_copy_only=False))
        unit, a, b, side = (x.to_numpy(zero_copy_only=False) for x in sets.flatten().flatten())
        order = np.lexsort((b, a, unit))
        held, unit, a, b, side = (x[order] for x in (held, unit, a, b, side))
        first = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        edges = [0, len(held)]
        if rows.nbytes >= 2 * most_bytes:
            sizes = pc.binary_length(rows.column(5)).combine_chunks().to_numpy(zero_copy_only=False)
            share = np.cumsum(sizes[held], dtype=np.int64)[first] // most_bytes
            edges = [0, *first[1:][np.diff(share) > 0].tolist(), len(held)]
        for at, to in zip(edges[:-1], edges[1:], strict=True):
            if (out := work(rows, *(x[at:to] for x in (held, unit, a, b, side)))) is not None:
                yield out

    def work(rows: pa.Table, held: np.ndarray, unit: np.ndarray, a: np.ndarray, b: np.ndarray, side: np.ndarray) -> pa.RecordBatch | None:
        doc, row, line = (rows.column(k).to_numpy()[held] for k in range(2, 5))
        order = np.lexsort((line, row, doc))
        new = np.ones(len(order), bool)
        new[1:] = (doc[order][1:] != doc[order][:-1]) | (row[order][1:] != row[order][:-1]) | (line[order][1:] != line[order][:-1])
        raw, begin = string_bytes(rows.column(5).take(pa.array(held[order[new]])).combine_chunks())
        begin, size = begin[:-1], np.diff(begin)
        doc, row, line = doc[order[new]], row[order[new]], line[order[new]]
        rank = np.empty(len(order), np.int64)  # of the distinct lines, in order of their places
        rank[order] = np.cumsum(new) - 1
        order = np.lexsort((rank, b, a, unit))
        unit, a, b, side, rank = (x[order] for x in (unit, a, b, side, rank))
        first = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        start = np.repeat(first, np.diff(np.append(first, len(unit))))
        kinds, across = _kinds(raw, size), a != b
        late, tested, several = np.zeros(len(size), bool), np.zeros(0, np.int64), len(first) > 1
        waiting, step, ahead = np.flatnonzero((np.arange(len(unit)) > start) & (side == 0)), 0, 1
        while len(waiting):
            x, y = np.repeat(waiting, ahead), (start[waiting, None] + step + np.arange(ahead)).ravel()
            some = y < x
            x, y = x[some], y[some]
            some = (~across[x] | (side[x] != side[y])) & (rank[x] != rank[y])
            pair = np.sort(rank[x[some]] << 32 | rank[y[some]])
            pair = pair[np.diff(pair, prepend=-1) > 0]
            if len(tested):
                pair = pair[tested[np.minimum(np.searchsorted(tested, pair), len(tested) - 1)] != pair]
            if several:  # one set meets no pair again
                tested = np.sort(np.concatenate([tested, pair]), kind="stable")
            x, y = pair >> 32, pair & 0xFFFFFFFF
            bound = allowed(np.minimum(size[x], size[y]), edits, percent)
            like = np.abs(size[x] - size[y]) <= bound
            x, y, bound = x[like], y[like], bound[like]
            for k in range(0, len(x), 1 << 16):
                p, q, most = x[k : k + (1 << 16)], y[k : k + (1 << 16)], bound[k : k + (1 << 16)]
                few = np.abs(kinds[p] - kinds[q]).sum(1) + np.abs(size[p] - size[q]) <= 2 * most
                p, q, most = p[few], q[few], most[few]
                late[p[near_pairs(raw, begin, size, p, q, most)]] = True
            step += ahead
            ahead = 1 if step < 3 else min(2 * ahead, max(1, (1 << 20) // len(waiting)))
            waiting = waiting[~late[rank[waiting]] & (start[waiting] + step < waiting)]
        return pa.RecordBatch.from_arrays([pa.array(doc[late]), pa.array(row[late]), pa.array(line[late], pa.int32())], names=list(PLACE_COLUMNS)) if late.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < most_bytes:
                continue
            now = pa.Table.from_batches(held).combine_chunks()
            lead = now.column(0).to_numpy()
            last = np.flatnonzero(lead != lead[-1])
            whole = int(last[-1]) + 1 if len(last) else 0  # the last lead may go on in the next batch
            if whole:
                yield from walk(now.slice(0, whole).combine_chunks())
            rest = now.slice(whole).combine_chunks()
            held, size = rest.to_batches(), rest.nbytes if whole else 0
        if held:
            yield from walk(pa.Table.from_batches(held).combine_chunks())
        give_back()

    return run


UNIT_COLUMNS = ("lead", "unit", "a", "b", "side", "id")


def _led_sets(sets: DataFrame) -> DataFrame:
    """unit, ids, m, lead of sets that come once: the least line of those sets that share a line with it, where they have ``FAMILY`` lines or more."""
    own = sets.select("unit", "ids", F.size("ids").cast("long").alias("m"), F.get("ids", F.lit(0)).alias("least"))
    members = own.filter(F.col("m") >= FAMILY).select("unit", "least", F.explode("ids").alias("id"))
    shared = members.join(members.groupBy("id").agg(F.min("least").alias("lead")), "id").groupBy("unit").agg(F.min("lead").alias("lead"))
    return own.join(shared, "unit", "left").select("unit", "ids", "m", F.coalesce("lead", "least").alias("lead"))


def _whole_sets(led: DataFrame, lead_lines: int) -> DataFrame:
    """Rows of sets that are compared as a whole, the sets of a lead by one task, or by several if they have many pairs."""
    pairs, zero = float(lead_lines) ** 2, F.lit(0).cast("long")  # twice the pairs of so many lines
    own = F.col("m").cast("double") * F.col("m")
    many = led.groupBy("lead").agg(F.sum(own).alias("all")).filter(F.col("all") > pairs / 16)
    lines = led.filter(F.col("m") >= FAMILY).select("lead", F.explode("ids").alias("id")).groupBy("lead").agg(F.count_distinct("id").cast("double").alias("n"))
    many = many.join(lines, "lead", "left").select("lead", "all", (F.col("n") * F.col("n")).alias("union"))
    one, large = F.coalesce(F.col("union") <= F.col("all"), F.lit(False)), own > pairs  # such a set is divided by itself
    dealt = led.join(many, "lead", "left").select(
        F.when(one, F.xxhash64("lead", F.lit(1))).when(large, F.xxhash64("unit", F.lit(2))).otherwise(F.xxhash64("lead", F.pmod("unit", F.ceil(F.coalesce("all", F.lit(1.0)) / pairs)), F.lit(3))).alias("lead"),
        F.when(one, F.col("lead")).otherwise(F.col("unit")).alias("unit"),
        F.ceil(F.when(one, F.col("union")).when(large, own).otherwise(F.lit(1.0)) / pairs).alias("tasks"),
        "ids",
    )
    lines = dealt.select("lead", "unit", "tasks", F.explode("ids").alias("id"))
    lines = lines.select("lead", "unit", "tasks", "id", F.explode(F.sequence(zero, F.greatest(F.lit(1), "tasks") - 1)).alias("task"))
    side = F.when(F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), "tasks")) == F.col("task"), 0).otherwise(1)
    return lines.select(F.when(F.col("tasks") > 1, F.xxhash64("lead", "task")).otherwise(F.col("lead")).alias("lead"), "unit", zero.alias("a"), zero.alias("b"), side.alias("side"), "id")


def _beside_the_first(parts: DataFrame) -> DataFrame:
    """Rows of each part of a set together with the set's first part."""
    first = parts.groupBy("unit").agg(F.min_by("ids", "part").alias("first"))
    both = parts.join(first, "unit").select("unit", F.col("part").alias("a"), F.col("part").alias("b"), F.explode(F.array_union("first", "ids")).alias("id"))
    return both.select(F.xxhash64("unit", "a").alias("lead"), "unit", "a", "b", F.lit(0).alias("side"), "id")


def _left_to_compare(parts: DataFrame, texts: DataFrame, near: DataFrame, part: int) -> DataFrame:
    """Rows of the lines that have met none before them beside their set's first part, in groups of some ``part``, with every part of the set.

    A set of two parts has nothing left.
    """
    several = parts.groupBy("unit").agg(F.count("*").alias("n")).filter("n > 2").select("unit")
    left = parts.join(several, "unit", "left_semi").select("unit", F.explode("ids").alias("id")).join(texts.select("id", *[f"place.{c}" for c in PLACE_COLUMNS]), "id")
    left = checkpointed(left.join(near, list(PLACE_COLUMNS), "left_anti").select("unit", "id").distinct())
    groups = left.groupBy("unit").agg(F.ceil(F.count("*") / part).alias("groups"))
    asked = left.join(groups, "unit").select("unit", F.pmod(F.xxhash64("id"), F.col("groups")).alias("a"), F.lit(0).alias("side"), "id")
    every = parts.join(groups, "unit").select("unit", (-1 - F.col("part")).alias("b"), "ids", "groups")  # names of parts below 0, of groups from 0 on
    with_groups = every.select("unit", "b", "ids", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("a"))
    there = with_groups.select("unit", "a", "b", F.lit(1).alias("side"), F.explode("ids").alias("id"))
    names = every.select("unit", "b")
    asked = asked.join(names, "unit").select("unit", "a", "b", "side", "id")
    return asked.unionByName(there).select(F.xxhash64("unit", "a", "b").alias("lead"), *UNIT_COLUMNS[1:])


def _sets_of_lines(units: DataFrame) -> DataFrame:
    """lead, id, sets: a line with all its sets of one lead, so that its text goes to their task once; dealt by id."""
    return units.repartition("id").groupBy("id", "lead").agg(F.collect_set(F.struct("unit", "a", "b", "side")).alias("sets"))


def near_lines(docs: DataFrame, scratch: Scratch, lines: int, edits: int, least: int, percent: int = 0, part: int = PART, hot_lines: int = HOT_LINES, lead_lines: int = LEAD_LINES) -> DataFrame:
    """The first place of each distinct line that is within its bound of one with an earlier first place.

    There are at most ``lines`` lines.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    hot = hot_keys(docs, edits, least, percent, lines, hot_lines)
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wide = 1 if total < MANY_BYTES else 2
    buckets = max(parallel, min(1 << 20, total // (wide * BUCKET_BYTES)))
    blocks = docs.mapInArrow(_blocks(edits, least, percent, buckets, hot, max(16, lines // hot_lines), wide * FLUSH), BLOCK_SCHEMA)
    found = blocks.repartition(max(parallel, buckets // 4), "bucket").groupBy("bucket").applyInArrow(_sets(part, edits, percent), SET_SCHEMA)
    sets = scratch.keep(found, "line_sets")
    wanted = spark.sparkContext.broadcast(candidate_filter(sets.select(F.explode("ids").alias("id")), filter_words(lines)))
    # dealt by id alone, so that the join below needs no second shuffle of the texts
    sent = docs.mapInArrow(_texts(least, wanted), f"id long, {PLACE}, text binary").repartition("id")
    texts = sent.groupBy("id", "text").agg(F.min(F.struct(*PLACE_COLUMNS)).alias("place"))
    some_cut = not sets.filter("cut").isEmpty()
    parts = sets.filter("cut").dropDuplicates(["unit", "part"])  # keys may share a set
    if some_cut:  # their lines are fetched more than once
        texts = scratch.keep(texts, "line_texts")

    def walked(units: DataFrame) -> DataFrame:
        rows = _sets_of_lines(units).join(texts, "id").select("lead", "sets", *[f"place.{c}" for c in PLACE_COLUMNS], "text")
        return rows.repartition("lead").sortWithinPartitions("lead").mapInArrow(_walk(edits, percent), PLACE)

    once = scratch.keep(sets.filter("not cut").dropDuplicates(["unit"]).select("unit", "ids"), "line_units")
    led = scratch.keep(_led_sets(once), "line_leads")
    scratch.drop("line_units")
    units = _whole_sets(led, lead_lines)
    if some_cut:
        units = units.unionByName(_beside_the_first(parts))
    near = checkpointed(walked(units).distinct())
    scratch.drop("line_leads")
    if some_cut:
        more = walked(_left_to_compare(parts, texts, near, part))
        near = checkpointed(near.unionByName(more).distinct())
        scratch.drop("line_texts")
    wanted.unpersist()
    scratch.drop("line_sets")
    return near


def repeated_lines(docs: DataFrame, edits: int = 2, least_bytes: int = 20, least_equal: int | None = None, percent: int = 0) -> DataFrame:
    """doc_id, row, line, near: every line that repeats, by its row's id and hash; ``near`` where no equal line comes first."""
    docs = keyed_rows(docs).filter("doc_id is not null and text is not null")
    with Scratch(docs.sparkSession) as scratch:
        places = scratch.keep(docs.mapInArrow(_places(least_bytes if least_equal is None else least_equal), f"{PLACE}, h1 long, h2 long, again boolean"), "line_places")
        firsts = places.filter("not again")
        number = places.count()
        first = F.min(F.struct(*PLACE_COLUMNS)).over(Window.partitionBy("h1", "h2"))  # a row a slice, however common the line
        more = firsts.withColumn("first", first).filter(F.struct(*PLACE_COLUMNS) != F.col("first"))
        equal = checkpointed(places.filter("again").select(*PLACE_COLUMNS).unionByName(more.select(*PLACE_COLUMNS)).groupBy("doc_id", "row").agg(F.collect_set("line").alias("equal")))
        scratch.drop("line_places")
        near = near_lines(docs, scratch, number, edits, least_bytes, percent).groupBy("doc_id", "row").agg(F.collect_set("line").alias("near"))
        return checkpointed(equal.join(near, ["doc_id", "row"], "full"))


def keyed_rows(docs: DataFrame) -> DataFrame:
    """doc_id, row, text: ``row`` tells texts with one id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


def decisions(docs: DataFrame, edits: int = 2, least_bytes: int = 20, least_equal: int | None = None, percent: int = 0) -> DataFrame:
    """doc_id, n_lines, n_dropped, n_near, dropped (line numbers from 0) of every row of ``docs``."""
    none = F.array().cast("array<int>")
    repeats = repeated_lines(docs, edits, least_bytes, least_equal, percent).select("doc_id", "row", F.coalesce("equal", none).alias("equal"), F.coalesce("near", none).alias("near"))
    repeats = repeats.select("doc_id", "row", F.array_except("near", "equal").alias("near"), F.array_sort(F.array_union("equal", "near")).alias("dropped"))
    size = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    lines = keyed_rows(docs).select("doc_id", "row", F.coalesce(size, F.lit(0)).cast("long").alias("n_lines"))
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return lines.join(repeats, ["doc_id", "row"], "left").select("doc_id", "n_lines", count(F.coalesce("dropped", none)).alias("n_dropped"), count(F.coalesce("near", none)).alias("n_near"), F.coalesce("dropped", none).alias("dropped"))


def remove_repeated_lines(docs: DataFrame, edits: int = 2, least_bytes: int = 20, least_equal: int | None = None, percent: int = 0) -> DataFrame:
    """The columns of ``docs`` with repeated lines cut out of ``text``; documents that lose all their text go."""
    repeats = repeated_lines(docs, edits, least_bytes, least_equal, percent)
    none = F.array().cast("array<int>")
    doc, row, out_of = free_names(docs.columns, "__doc", "__row", "__dropped")
    gone = repeats.select(F.col("doc_id").alias(doc), F.col("row").alias(row), F.array_union(F.coalesce("equal", none), F.coalesce("near", none)).alias(out_of))
    schema = T.StructType(docs.schema.fields)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts, keep = [], []
            for text, dropped in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if dropped:
                    out = set(dropped)
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in out)
                keep.append(not dropped or bool(text.strip()))
                texts.append(text)
            columns = [pa.array(texts, c.type) if k == place else c for k, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in columns], names=batch.schema.names[:-1])

    same = (docs["doc_id"].cast("long") == gone[doc]) & (F.xxhash64(docs["text"].cast("string")) == gone[row])
    return docs.join(gone, same, "left").select(*[docs[c] for c in docs.columns], gone[out_of]).mapInArrow(run, schema)
