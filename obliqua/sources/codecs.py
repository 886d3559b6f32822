"""Packings of pixel bytes that image files use: Blosc frames and the zstd forms of CZI.

A Blosc frame is cut into blocks; a block's bytes may be shuffled (all first bytes of its items, then all
second ones, …) and cut into as many streams as an item has bytes.  Frames of zstd, zlib, lz4 and
snappy are read; zstd and zlib are written.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa

# Fixed values of Blosc frames: bits of the flags, codecs by number, and the fewest items of a block that is cut into streams.
SHUFFLED, COPIED, BIT_SHUFFLED, WHOLE_BLOCKS = 1, 2, 4, 16
CODECS = {0: "blosclz", 1: "lz4", 2: "snappy", 3: "zlib", 4: "zstd"}
LEAST_ITEMS, MOST_STREAMS, HEADER = 128, 16, 16


def zstd_unpack(data: bytes, size: int) -> bytes:
    """``size`` bytes of a zstd frame."""
    made = pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)
    if len(made) != size:
        raise ValueError(f"{len(made)} bytes of zstd for {size}")
    return made


def _unpack(codec: str, data: bytes, size: int) -> bytes:
    if codec == "zlib":
        return zlib.decompress(data)
    if codec == "zstd":
        return zstd_unpack(data, size)
    if codec in ("lz4", "snappy"):
        return pa.decompress(data, decompressed_size=size, codec="lz4_raw" if codec == "lz4" else codec, asbytes=True)
    raise ValueError(f"Blosc chunks packed by {codec} are not read")


def unshuffle(data: np.ndarray, item: int) -> np.ndarray:
    """Bytes of items from all first bytes, all second ones and so on; a rest that is no item stays."""
    whole = len(data) // item * item
    return np.concatenate([data[:whole].reshape(item, -1).T.ravel(), data[whole:]])


def shuffle(data: np.ndarray, item: int) -> np.ndarray:
    whole = len(data) // item * item
    return np.concatenate([data[:whole].reshape(-1, item).T.ravel(), data[whole:]])


def bit_unshuffle(data: np.ndarray, item: int) -> np.ndarray:
    """Items from their first bits, second bits and so on, over whole groups of eight items; a rest stays."""
    items = len(data) // item // 8 * 8
    whole = items * item
    bits = np.unpackbits(data[:whole], bitorder="little").reshape(item * 8, items)
    return np.concatenate([np.packbits(bits.T.reshape(-1), bitorder="little"), data[whole:]])


def blosc_unpack(frame: bytes) -> bytes:
    """The bytes of a Blosc (version 1) frame."""
    if len(frame) < HEADER:
        raise ValueError("a Blosc frame is cut off")
    _, _, flags, item, size, block, packed = struct.unpack_from("<BBBBIII", frame)
    if packed != len(frame):
        raise ValueError(f"a Blosc frame of {packed} bytes has {len(frame)}")
    if flags & COPIED:
        return frame[HEADER : HEADER + size]
    if size == 0:
        return b""
    codec, out = CODECS.get(flags >> 5, "an unknown codec"), []
    starts = struct.unpack_from(f"<{-(-size // block)}I", frame, HEADER)
    for k, at in enumerate(starts):
        length = min(block, size - k * block)
        cut = not flags & WHOLE_BLOCKS and item <= MOST_STREAMS and block // item >= LEAST_ITEMS and length == block
        streams, parts = item if cut else 1, []
        for _ in range(streams):
            (held,) = struct.unpack_from("<i", frame, at)
            at += 4
            each = length // streams
            data = frame[at : at + held]
            parts.append(data if held == each else _unpack(codec, data, each))
            at += held
        raw = np.frombuffer(b"".join(parts), np.uint8)
        if flags & SHUFFLED and item > 1:
            raw = unshuffle(raw, item)
        elif flags & BIT_SHUFFLED:
            raw = bit_unshuffle(raw, item)
        out.append(raw.tobytes())
    return b"".join(out)


def blosc_pack(data: bytes, item: int, codec: str = "zstd", block: int = 1 << 18, level: int = 3) -> bytes:
    """A Blosc frame of shuffled blocks, each one stream."""
    if codec not in ("zstd", "zlib"):
        raise ValueError(f"Blosc chunks are not written by {codec}")
    block = max(item, min(block // item * item, len(data)))
    flags = (SHUFFLED if item > 1 else 0) | WHOLE_BLOCKS | {v: k for k, v in CODECS.items()}[codec] << 5
    blocks = []
    for at in range(0, len(data), block):
        raw = np.frombuffer(data[at : at + block], np.uint8)
        mixed = (shuffle(raw, item) if item > 1 else raw).tobytes()
        made = zlib.compress(mixed, level) if codec == "zlib" else pa.Codec("zstd", level).compress(mixed, asbytes=True)
        blocks.append(mixed if len(made) >= len(mixed) else made)
    at, starts = HEADER + 4 * len(blocks), []
    for one in blocks:
        starts.append(at)
        at += 4 + len(one)
    head = struct.pack("<BBBBIII", 2, 1, flags, item, len(data), block, at)
    return b"".join([head, struct.pack(f"<{len(starts)}I", *starts), *[struct.pack("<i", len(b)) + b for b in blocks]])


def chunk_unpack(how: dict | None, data: bytes) -> bytes:
    """The bytes of a Zarr chunk by its array's compressor; ValueError for one that is not read."""
    name = how["id"] if how else None
    if name is None:
        return data
    if name in ("zlib", "gzip"):
        return zlib.decompress(data, 47)
    if name == "blosc":
        return blosc_unpack(data)
    if name == "zstd":
        import io

        with pa.input_stream(io.BytesIO(data), compression="zstd") as stream:
            return stream.read()
    raise ValueError(f"chunks packed by {name} are not read")


READ_CHUNKS = (None, "zlib", "gzip", "blosc", "zstd")


def czi_zstd(data: bytes, size: int, marked: bool) -> bytes:
    """Pixels of a zstd sub-block; with a mark (the later form) a short head tells whether the low bytes of all pixels come before the high ones."""
    if not marked:
        return zstd_unpack(data, size)
    head, at, packed = data[0], 1, False
    if head > 127:
        raise ValueError("a zstd head of several length bytes is not read")
    while at < head:
        kind = data[at]
        if kind != 1:
            raise ValueError(f"zstd head part {kind} is not read")
        packed = bool(data[at + 1] & 1)
        at += 2
    made = zstd_unpack(data[head:], size)
    return unshuffle(np.frombuffer(made, np.uint8), 2).tobytes() if packed else made
