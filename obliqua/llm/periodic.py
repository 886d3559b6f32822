"""Periodic runs of words, found by comparing each text with itself at every lag.

A run is a stretch of words with smallest period q, at least ``least_words`` long and ``times`` periods long, that
no neighbouring word extends.  The word ids of a text are compared with themselves shifted by every lag up to
n / ``times``, many lags in one array operation; stretches of equality of a sufficient length at lag q are runs
of period q.  A stretch that has a smaller period has it over the same words (the periods' greatest common divisor is
one too), so of equal stretches the one with the smallest lag is kept.

A text of up to ``split_bytes`` is compared by one task.  Of a longer one, ranges of lags of about ``unit`` comparisons
become rows of their own, dealt out to all machines, and their runs are gathered by text: the work grows with the square of a text's
length, the time with that over the number of machines.

Defined cases: null text has no words; empty and blank texts have no runs; null or repeated ``doc_id`` keep their
rows; an empty table gives none; words are bytes between the six blanks of ASCII, so other spaces are parts of words; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, checkpointed, text_slices

Prepare = Callable[[int | None, list[bytes]], list[bytes]] | None

#: Comparisons in one array operation.
BLOCK = 1 << 20
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
ARROW = pa.schema([("doc_id", pa.int64())] + [(k, pa.int64()) for k in ("n_runs", "start", "length", "period", "exponent_milli")] + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def word_ids(words: list[bytes]) -> np.ndarray:
    """Numbers of the words in order of their first place; equal words, equal numbers."""
    known: dict[bytes, int] = {}
    ids = [known.setdefault(w, len(known)) for w in words]
    return np.array(ids, np.uint16 if len(known) < 0xFFFF else np.int32)


def stretches(ids: np.ndarray, first: int, last: int, least_words: int = 6, times: int = 4) -> np.ndarray:
    """(start, length, lag) of each long enough stretch that repeats itself at a lag from ``first`` to ``last``."""
    n, found = len(ids), []
    last = min(last, n // times)
    # one number beyond the end that no word has, so that stretches end with the text
    padded = np.concatenate([ids, np.full(max(last, 0) + 1, np.iinfo(ids.dtype).max, ids.dtype)])
    at = max(first, 1)
    while at <= last:
        width = n - at + 1  # the last column looks beyond the text, so no stretch goes on into the next row
        rows = max(1, min(last - at + 1, BLOCK // width))
        shifted = np.lib.stride_tricks.as_strided(padded[at:], (rows, width), (padded.itemsize, padded.itemsize), writeable=False)
        lags = np.arange(at, at + rows)
        need = int(np.maximum(least_words - lags, (times - 1) * lags).min())  # the shortest stretch of equality that can count
        step, marks = 1, (shifted == padded[:width]).ravel()
        while 2 * step <= min(need, 4):
            marks = marks[:-step] & marks[step:]
            step *= 2
        places = np.flatnonzero(marks)
        if len(places):
            breaks = np.flatnonzero(np.diff(places) != 1)
            begin = places[np.concatenate([[0], breaks + 1])]
            size = places[np.concatenate([breaks, [len(places) - 1]])] - begin + step
            lag = at + begin // width
            keep = size + lag >= np.maximum(least_words, times * lag)
            if keep.any():
                found.append(np.stack([begin % width, size + lag, lag], 1)[keep])
        at += rows
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def primitive(found: np.ndarray) -> np.ndarray:
    """The runs by start and period: of equal stretches that with the smallest lag."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    found = found[fresh]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs_of(ids: np.ndarray, least_words: int = 6, times: int = 4) -> np.ndarray:
    """(start, length, period) of every run, by start, then period."""
    return primitive(stretches(ids, 1, len(ids) // times, least_words, times))


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether a word lies in a run after the run's first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


def summary(words: list[bytes], runs: np.ndarray) -> tuple:
    """The columns after ``doc_id`` of one text."""
    best: tuple = (None, None, None, None)
    listed = runs.tolist()
    if listed:
        # 2 ** 64 keeps the order of all fractions of numbers below 2 ** 31 in whole numbers
        start, length, period = min(listed, key=lambda r: (-((r[1] << 64) // r[2]), r[0], r[2]))
        best = (start, length, period, 1000 * length // period)
    told = "".join(f"{s},{n},{q}\n" for s, n, q in listed).encode()
    kept = [w for w, gone in zip(words, dropped(len(words), runs).tolist(), strict=True) if not gone] if listed else words
    return (len(listed), *best, hashlib.sha256(told).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


def _texts(batch: pa.RecordBatch, prepare: Prepare) -> list[list[bytes]]:
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column("text").to_pylist()]
    return words if prepare is None else [prepare(doc, w) for doc, w in zip(batch.column("doc_id").to_pylist(), words, strict=True)]


def _whole(least_words: int, times: int, prepare: Prepare):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows = [(doc, *summary(words, runs_of(word_ids(words), least_words, times))) for doc, words in zip(batch.column("doc_id").to_pylist(), _texts(batch, prepare), strict=True)]
            if rows:
                yield _batch(rows)

    return run


UNIT_SCHEMA = "row long, first long, last long, ids binary"
RUN_SCHEMA = "row long, start long, length long, period long"


def _units(unit: int, times: int, prepare: Prepare):
    """A row for each range of lags of a text, with all its word ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            for row, words in zip(batch.column("row").to_pylist(), _texts(batch, prepare), strict=True):
                ids = word_ids(words).astype("<i4").tobytes()
                lags = max(1, unit // max(1, len(words)))
                for first in range(1, len(words) // times + 1, lags):
                    yield pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int64()), "first": pa.array([first], pa.int64()), "last": pa.array([first + lags - 1], pa.int64()), "ids": pa.array([ids], pa.binary())})

    return run


def _lags(least_words: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, first, last, ids in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                found = stretches(np.frombuffer(ids, "<i4"), first, last, least_words, times)
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(found), pa.int64()), *[pa.array(found[:, k], pa.int64()) for k in range(3)]], names=["row", "start", "length", "period"])

    return run


def _gathered(prepare: Prepare):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows = []
            for doc, words, runs in zip(batch.column("doc_id").to_pylist(), _texts(batch, prepare), batch.column("runs").to_pylist(), strict=True):
                found = np.array([(r["start"], r["length"], r["period"]) for r in runs or []], np.int64).reshape(-1, 3)
                rows.append((doc, *summary(words, primitive(found))))
            if rows:
                yield _batch(rows)

    return run


@contextmanager
def _one_row_batches(spark):
    """Rows of lag ranges hold a whole text's ids each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def periodic_runs(docs: DataFrame, least_words: int = 6, times: int = 4, split_bytes: int = 1 << 16, unit: int = 1 << 31, prepare: Prepare = None) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent, and the digests of all runs and of the text without repetitions.

    ``prepare`` (doc_id, words) -> words may change the words before; it must give the same words each time.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = F.coalesce(F.octet_length("text") > split_bytes, F.lit(False))
    short = rows.filter(~long).mapInArrow(_whole(least_words, times, prepare), SCHEMA)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with Scratch(spark) as scratch:
        # numbers are drawn once and stored, so that a lost task cannot change them
        kept = scratch.keep(rows.filter(long).withColumn("row", F.monotonically_increasing_id()), "long-texts")
        if kept.isEmpty():
            return short
        with _one_row_batches(spark):
            units = kept.mapInArrow(_units(unit, times, prepare), UNIT_SCHEMA)
            found = scratch.keep(units.repartition(parts, "row", "first").mapInArrow(_lags(least_words, times), RUN_SCHEMA), "runs")
        gathered = found.groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
        whole = kept.join(gathered, "row", "left").select("doc_id", "text", "runs").mapInArrow(_gathered(prepare), SCHEMA)
        return short.unionByName(checkpointed(whole))


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, or for ids whose decimal form has a crc32 divisible by 10 the words with a passage repeated to their end.

    With h that checksum and g = h // 10, words from number a = g % n on repeat the p words from there, p = 1 + (n - a) // (3 + g % 8).
    Texts without words and rows without an id stay.
    """
    if doc_id is None or not words or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g, n = h // 10, len(words)
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    passage = words[start : start + period]
    return words[:start] + (passage * (-(-(n - start) // period)))[: n - start]
