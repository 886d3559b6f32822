"""Wavelet matrix over token ids, as one self-contained byte image.

Bit planes run from the highest bit of an id to the lowest; each plane holds
that bit of every id in the order the planes above have sorted the ids into
(zeros before ones, each stable).  Rank directories with one count for each 512
positions make access, counting and occurrence lookup cost a few steps a plane.

The planes hold places in the shard's own ascending alphabet, which needs fewer
planes than the vocabulary.

Image (little-endian): magic ``OWM1``; u32 planes, u64 ids, u64 documents;
then, each behind its u64 byte length: document ids (i64), presence flags of
document ids (u8), document ends (u64), the alphabet (u32), zeros of each plane
(u64), and for each plane its bits and its directory (u32), all zstd frames;
last u32 crc32 of what precedes it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import zstandard

MAGIC, HEAD, BLOCK = b"OWM1", struct.Struct("<4sIQQ"), 512


def _pop(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words)


class WaveletMatrix:
    """Succinct sequence of unsigned ids; see the module's text."""

    def __init__(self, planes: list[np.ndarray], zeros: list[int], size: int, alphabet: np.ndarray, directories: list[np.ndarray] | None = None):
        self.planes, self.zeros, self.size, self.alphabet = planes, zeros, size, alphabet
        self.directories = directories or [self._directory(p) for p in planes]

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        padded = np.zeros(-(-len(plane) // 64) * 64 + 64, np.uint8)
        padded[: len(plane)] = plane
        each = _pop(padded.view(np.uint64)).reshape(-1, 8).sum(1, dtype=np.uint64)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(each)]).astype(np.uint32)

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        if len(ids) and int(ids.max()) < 1 << 20:  # mark what occurs; sorting would take longer
            present = np.zeros(int(ids.max()) + 1, bool)
            present[ids] = True
            alphabet = np.flatnonzero(present).astype(np.uint32)
            sequence = (np.cumsum(present, dtype=np.uint32) - np.uint32(1))[ids]
        else:
            alphabet, sequence = np.unique(ids.astype(np.uint32), return_inverse=True)
        bits = max(1, (len(alphabet) - 1).bit_length())
        sequence = sequence.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for bit in range(bits - 1, -1, -1):
            ones = (sequence & sequence.dtype.type(1 << bit)) != 0
            planes.append(np.packbits(ones, bitorder="little"))
            left = np.flatnonzero(~ones)
            zeros.append(len(left))
            sequence = np.concatenate([sequence.take(left), sequence.take(np.flatnonzero(ones))])
        return cls(planes, zeros, len(ids), alphabet)

    def to_array(self) -> np.ndarray:
        """All ids in order: the planes undone from the lowest bit up."""
        bits = len(self.planes)
        kind = np.uint16 if bits <= 16 else np.uint32
        now = np.zeros(self.size, kind)
        for bit in range(bits):
            flags = np.unpackbits(self.planes[bits - 1 - bit], count=self.size, bitorder="little").view(bool)
            zeros = self.zeros[bits - 1 - bit]
            now[zeros:] |= kind(1 << bit)
            above = np.empty(self.size, kind)
            above[np.flatnonzero(~flags)] = now[:zeros]  # by places: masks take twice as long
            above[np.flatnonzero(flags)] = now[zeros:]
            now = above
        return self.alphabet[now]

    def _rank1(self, level: int, at: int) -> int:
        """Ones of a plane before a position."""
        block = at // BLOCK
        start, plane = block * (BLOCK // 8), self.planes[level]
        whole = plane[start : at // 8]
        rest = int(plane[at // 8]) & ((1 << at % 8) - 1) if at % 8 else 0
        return int(self.directories[level][block]) + int(_pop(whole).sum()) + rest.bit_count()

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) zero or one of a plane."""
        counts = self.directories[level].astype(np.int64)
        if not bit:
            counts = np.arange(len(counts), dtype=np.int64) * BLOCK - counts
        block = int(np.searchsorted(counts, k, "right")) - 1
        part = np.unpackbits(self.planes[level][block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(part == bit)[k - counts[block]])

    def access(self, at: int) -> int:
        value = 0
        for level in range(len(self.planes)):
            ones = self._rank1(level, at)
            bit = self._rank1(level, at + 1) - ones
            at = self.zeros[level] + ones if bit else at - ones
            value = value << 1 | bit
        return int(self.alphabet[value])

    def _place(self, value: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, value))
        return at if at < len(self.alphabet) and self.alphabet[at] == value else None

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        value = self._place(value)
        if value is None:
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self._rank1(level, start), self._rank1(level, end)
            if value >> (len(self.planes) - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id within positions [start, end)."""
        a, b = self._range(value, start, self.size if end is None else end)
        return b - a

    def locate(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id; IndexError past the last."""
        a, b = self._range(value, 0, self.size)
        value = self._place(value) or 0
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at


def pack_shard(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray) -> bytes:
    """The image of one shard: its ids and where each document ends."""
    matrix, press = WaveletMatrix.build(ids), zstandard.ZstdCompressor(level=1)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], np.int64)
    parts = [numbers, known, np.asarray(ends, np.uint64), matrix.alphabet, np.asarray(matrix.zeros, np.uint64)]
    for plane, directory in zip(matrix.planes, matrix.directories, strict=True):
        parts += [plane, directory]
    out = [HEAD.pack(MAGIC, len(matrix.planes), len(ids), len(doc_ids))]
    for part in parts:
        frame = press.compress(part.tobytes())
        out += [struct.pack("<Q", len(frame)), frame]
    body = b"".join(out)
    return body + struct.pack("<I", zlib.crc32(body))


def open_shard(image: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """(matrix, document ids, document ends) of an image; ValueError where it is damaged."""
    if len(image) < HEAD.size + 4 or zlib.crc32(memoryview(image)[:-4]) != struct.unpack("<I", image[-4:])[0]:
        raise ValueError("damaged shard: checksum")
    magic, bits, size, documents = HEAD.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not a shard")
    unpress, at = zstandard.ZstdDecompressor(), HEAD.size

    def part(kind) -> np.ndarray:
        nonlocal at
        (length,) = struct.unpack_from("<Q", image, at)
        at += 8 + length
        return np.frombuffer(unpress.decompress(image[at - length : at]), kind)

    numbers, known, ends, alphabet, zeros = part(np.int64), part(np.uint8), part(np.uint64), part(np.uint32), part(np.uint64)
    planes, directories = [], []
    for _ in range(bits):
        planes.append(part(np.uint8))
        directories.append(part(np.uint32))
    doc_ids = [int(n) if k else None for n, k in zip(numbers, known, strict=True)]
    assert len(doc_ids) == documents
    return WaveletMatrix(planes, [int(z) for z in zeros], size, alphabet, directories), doc_ids, ends.astype(np.int64)
