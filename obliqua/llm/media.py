"""Media columns: texts kept as FLAC files in a binary column, and PCM blocks read from them.

``to_media`` makes the column, ``pcm_blocks`` decodes it to rows with sample offsets, and
``media_features`` reads it back as the same blocks and describes each payload.  Nothing is shuffled.

Defined cases: null text is empty; a payload is the text's UTF-8 with spaces up
to a positive multiple of 192 bytes; equal texts give equal files; a damaged
file raises ``FlacError``; other columns are ignored by ``media_features``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import string_bytes, text_slices
from .flac import BLOCK, FlacError, decode_many, encode_many, read_metadata

UNIT = 192
MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
BLOCK_SCHEMA = "doc_id long, block int, first_sample long, n_samples int, pcm binary"
FEATURE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payloads(batch: pa.RecordBatch) -> tuple[list[bytes], list[int]]:
    raw, offsets = string_bytes(batch.column(batch.schema.get_field_index("text")))
    data, texts = raw.tobytes(), []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        texts.append(data[a:b].ljust(max(1, -(-(b - a) // UNIT)) * UNIT, b" "))
    return texts, np.diff(offsets).tolist()


def feature(payload: bytes) -> str:
    """Integers that describe the samples: eight counts by level, sign changes, total variation, energy."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    levels = np.bincount((x + 128) >> 5, minlength=8)
    step = np.diff(x)
    turns = int((np.sign(step[1:]) * np.sign(step[:-1]) < 0).sum())
    return ",".join(map(str, [*levels.tolist(), turns, int(np.abs(step).sum()), int((x * x).sum())]))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, 2 << 20):
        texts, sizes = payloads(batch)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(encode_many(texts), pa.binary())], names=["doc_id", "n_bytes", "media"])


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: a FLAC file for each text."""
    return _rows(docs).mapInArrow(_store, MEDIA_SCHEMA)


def _small(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(batch.schema.get_field_index("media"))])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def _blocks(file: bytes, samples: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(first sample, unsigned bytes) of each block of a decoded file; FlacError where its seek table tells other offsets."""
    pcm = (samples + 128).astype(np.uint8).tobytes()
    starts = list(range(0, len(pcm), BLOCK))
    points = read_metadata(file).points
    if points and [p[0] for p in points] != starts:
        raise FlacError("the seek table does not tell the blocks")
    return ((at, pcm[at : at + BLOCK]) for at in starts)


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, block, first_sample, n_samples, pcm (unsigned bytes): the stored files decoded, a row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _small(whole):
                files = batch.column(1).to_pylist()
                rows = [(doc, i, at, len(pcm), pcm) for doc, file, samples in zip(batch.column(0).to_pylist(), files, decode_many(files), strict=True) for i, (at, pcm) in enumerate(_blocks(file, samples))]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "block", "first_sample", "n_samples", "pcm"])

    return media.filter("media is not null").select("doc_id", "media").mapInArrow(run, BLOCK_SCHEMA)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _small(whole):
            files = batch.column(2).to_pylist()
            back = [b"".join(pcm for _, pcm in _blocks(file, samples)) for file, samples in zip(files, decode_many(files), strict=True)]
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array([len(p) for p in back], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in back]),
                pa.array([zlib.crc32(p[-16:]) for p in back], pa.int64()),
                pa.array([len(m) for m in files], pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in files]),
                pa.array([feature(p) for p in back]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FEATURE_SCHEMA.split(", ")])


def media_features(media: DataFrame) -> DataFrame:
    """What the stored files say when they are read back; see ``FEATURE_SCHEMA``."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, FEATURE_SCHEMA)
