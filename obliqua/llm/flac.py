"""FLAC streams of 8-bit mono samples, many frames at once with array operations.

Encoding takes, frame by frame, the best of a constant, verbatim samples, the
fixed predictors of order 0 to 4 and a quantised linear predictor, with one
Rice parameter.  Decoding reads any mono stream of up to 16 bits: every kind of
subframe, partitioned Rice residuals with escapes, and wasted bits; it checks
the CRC-8 of headers, the CRC-16 of frames and the MD5 of all samples.  Frames
advance together, sample by sample; the seek table tells where they begin.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

BLOCK, RATE, AT_ONCE = 1152, 8000, 8192
# Fixed values of the format: block sizes by code, and the fixed predictors.
BLOCK_CODES = {192: 1, 576: 2, 1152: 3, 2304: 4, 4608: 5, 256: 8, 512: 9, 1024: 10, 2048: 11, 4096: 12, 8192: 13, 16384: 14, 32768: 15}
CODE_BLOCKS = {c: b for b, c in BLOCK_CODES.items()}
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
DEPTHS = {1: 8, 2: 12, 4: 16}


class FlacError(ValueError):
    """A stream that is damaged or of a kind that is not read here."""


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        table = np.where(table >> (bits - 1) & 1, table << 1 ^ polynomial, table << 1) & ((1 << bits) - 1)
    return table.astype(np.uint32)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    value = 0
    for b in data:
        value = int(CRC8[value ^ b])
    return value


def crc16_many(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each span of bytes, all spans a byte at a time, the longest first."""
    order = np.argsort(starts - ends, kind="stable")
    at, left = starts[order], (ends - starts)[order]
    value = np.zeros(len(at), np.uint32)
    active = np.searchsorted(-left, -np.arange(int(left.max()) if len(left) else 0), "left")
    for i, n in enumerate(active.tolist()):
        v = value[:n]
        value[:n] = (v << np.uint32(8) & np.uint32(0xFFFF)) ^ CRC16[(v >> np.uint32(8)) ^ raw[at[:n] + i]]
    out = np.empty(len(at), np.uint32)
    out[order] = value
    return out


@lru_cache(100_000)
def frame_header(number: int, block: int) -> bytes:
    """Header of a frame of a stream with fixed block size: mono, 8 bits, 8 kHz."""
    code = BLOCK_CODES.get(block, 7)
    if number < 0x80:
        coded = bytes([number])
    else:  # the number is spelt as UTF-8 would spell it
        tail, rest = [], number
        while rest >= 1 << (6 - len(tail)):
            tail.insert(0, 0x80 | rest & 0x3F)
            rest >>= 6
        coded = bytes([(0xFF << (7 - len(tail))) & 0xFF | rest, *tail])
    head = bytes([0xFF, 0xF8, code << 4 | 4, 0x02]) + coded + (struct.pack(">H", block - 1) if code == 7 else b"")
    return head + bytes([crc8(head)])


def _zigzag(r: np.ndarray) -> np.ndarray:
    return np.where(r >= 0, 2 * r, -2 * r - 1)


def _linear(x: np.ndarray, order: int = 4, shift: int = 10) -> np.ndarray:
    """Quantised predictor coefficients of each row, by Levinson's recursion on all rows at once."""
    auto = np.stack([(x[:, : x.shape[1] - k] * x[:, k:]).sum(1) for k in range(order + 1)], 1).astype(float)
    auto[:, 0] = auto[:, 0] * (1 + 1e-6) + 1e-6
    a, error = np.zeros((len(x), order)), auto[:, 0].copy()
    for i in range(order):
        reach = auto[:, i + 1] - (a[:, :i] * auto[:, i:0:-1]).sum(1)
        k = np.clip(reach / error, -0.9999, 0.9999)
        before = a[:, :i].copy()
        a[:, :i] = before - k[:, None] * before[:, ::-1]
        a[:, i] = k
        error = error * (1 - k * k)
    return np.clip(np.rint(a * (1 << shift)), -(1 << 13), (1 << 13) - 1).astype(np.int64)


class _Bits:
    """Values of up to 16 bits put at bit positions of one buffer; positions never overlap."""

    def __init__(self, size: int):
        self.raw = np.zeros(size + 4, np.int64)

    def put(self, end: np.ndarray, value: np.ndarray, width) -> None:
        """Each value so that it ends right before bit ``end``."""
        start = end - width
        byte = start >> 3
        placed = value << (24 - (start & 7) - width)
        for k in range(3):
            part = placed >> (16 - 8 * k) & 0xFF
            if 8 * len(part) < len(self.raw):
                np.add.at(self.raw, byte + k, part)
            else:
                self.raw += np.bincount(byte + k, part, len(self.raw)).astype(np.int64)


def _encode_rows(x: np.ndarray, numbers: list[int]) -> list[bytes]:
    """Frames of equally long blocks of signed samples."""
    n = x.shape[1]
    x = x.astype(np.int64)
    best_cost = np.full(len(x), np.inf)
    kind = np.zeros(len(x), np.int64)  # predictor order; 5 the linear one
    residual = np.zeros_like(x)
    coefficients = _linear(x)
    for way in range(6):
        order = min(way, 4)
        r = np.zeros_like(x)
        if way < 5:
            r[:, order:] = np.diff(x, order, axis=1) if order else x
        else:
            predicted = sum(coefficients[:, j : j + 1] * x[:, order - 1 - j : n - 1 - j] for j in range(order)) >> 10
            r[:, order:] = x[:, order:] - predicted
        cost = _zigzag(r[:, order:]).sum(1) * (n / (n - order)) + 40.0 * order + 300 * (way == 5)
        better = cost < best_cost
        best_cost[better], kind[better], residual[better] = cost[better], way, r[better]
    order = np.minimum(kind, 4)
    u = _zigzag(residual)
    used = np.arange(n) >= order[:, None]
    sizes = np.stack([(((u >> k) + 1 + k) * used).sum(1) for k in range(9)], 1)
    k = sizes.argmin(1)
    constant = (x == x[:, :1]).all(1)
    coded = 8 + 8 * order + 10 + sizes[np.arange(len(x)), k] + np.where(kind == 5, 9 + 14 * order, 0)
    verbatim = ~constant & (coded >= 8 + 8 * n)
    bits = np.where(constant, 16, np.where(verbatim, 8 + 8 * n, coded))
    heads = [frame_header(number, n) for number in numbers]
    head = np.array([len(h) for h in heads])
    sizes_of = head + -(-bits // 8) + 2
    starts = np.cumsum(sizes_of) - sizes_of
    out, at = _Bits(int(sizes_of.sum())), 8 * (starts + head)
    put = out.put
    label = np.where(constant, 0, np.where(verbatim, 1, np.where(kind == 5, 32 + 3, 8 + order)))
    put(at + 8, label << 1, 8)
    low = x & 0xFF
    put(at[constant] + 16, low[constant, 0], 8)
    if verbatim.any():
        put((at[verbatim, None] + 8 + 8 * np.arange(1, n + 1)).ravel(), low[verbatim].ravel(), 8)
    rice = np.flatnonzero(~constant & ~verbatim)
    for j in range(4):  # warm-up samples
        rows = rice[order[rice] > j]
        put(at[rows] + 8 + 8 * (j + 1), low[rows, j], 8)
    place = at + 8 + 8 * order
    linear = rice[kind[rice] == 5]
    put(place[linear] + 9, np.full(len(linear), (14 - 1) << 5 | 10), 9)
    for j in range(4):
        put(place[linear] + 9 + 14 * (j + 1), coefficients[linear, j] & 0x3FFF, 14)
    place = place + np.where(kind == 5, 9 + 14 * 4, 0)
    put(place[rice] + 10, k[rice], 10)  # Rice with 4-bit parameters, one partition
    if len(rice):
        widths = ((u[rice] >> k[rice, None]) + 1 + k[rice, None]) * used[rice]
        ends = place[rice, None] + 10 + np.cumsum(widths, 1)
        values = (u[rice] & ((1 << k[rice, None]) - 1)) | (1 << k[rice, None])
        put(ends[used[rice]], values[used[rice]], np.broadcast_to(k[rice, None] + 1, values.shape)[used[rice]])
    raw = out.raw.astype(np.uint8)
    flat = np.frombuffer(b"".join(heads), np.uint8)
    raw[np.repeat(starts - (np.cumsum(head) - head), head) + np.arange(len(flat))] = flat
    ends = starts + sizes_of
    check = crc16_many(raw, starts, ends - 2)
    raw[ends - 2], raw[ends - 1] = check >> 8, check & 0xFF
    image = raw.tobytes()
    return [image[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A FLAC file for each payload; its bytes less 128 are the samples. Payloads are not empty."""
    blocks: dict[int, list[tuple[int, int]]] = {}
    for p, payload in enumerate(payloads):
        for f in range(-(-len(payload) // BLOCK)):
            blocks.setdefault(min(BLOCK, len(payload) - f * BLOCK), []).append((p, f))
    frames: list[list[bytes]] = [[b""] * -(-len(x) // BLOCK) for x in payloads]
    for n, places in blocks.items():
        for i in range(0, len(places), AT_ONCE // 4):
            part = places[i : i + AT_ONCE // 4]
            x = np.frombuffer(b"".join(payloads[p][f * BLOCK : f * BLOCK + n] for p, f in part), np.uint8).reshape(-1, n).astype(np.int16) - 128
            for (p, f), frame in zip(part, _encode_rows(x, [f for _, f in part]), strict=True):
                frames[p][f] = frame
    out = []
    for payload, own in zip(payloads, frames, strict=True):
        sizes = [len(x) for x in own]
        block = min(BLOCK, len(payload))
        signed = (np.frombuffer(payload, np.uint8) ^ np.uint8(128)).tobytes()
        info = struct.pack(">HH", block, block) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + (RATE << 44 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        points, at = [], 0
        for f, frame in enumerate(own):
            points.append(struct.pack(">QQH", f * BLOCK, at, min(BLOCK, len(payload) - f * BLOCK)))
            at += len(frame)
        # a metadata block has 24 bits for its size: seek points of longer streams fill several
        most = 900_000
        tables = [points[i : i + most] for i in range(0, len(points), most)]
        seek = b"".join(bytes([3 | 0x80 * (i == len(tables) - 1)]) + (18 * len(t)).to_bytes(3, "big") + b"".join(t) for i, t in enumerate(tables))
        out.append(b"fLaC\x00\x00\x00\x22" + info + seek + b"".join(own))
    return out


@dataclass
class Stream:
    """What the metadata of a file says, and where its frames are."""

    samples: int
    bits: int
    block: int
    md5: bytes
    first: int
    points: list[tuple[int, int, int]]


def read_metadata(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise FlacError("not a FLAC file")
    at, info, points, last = 4, None, [], False
    while not last:
        if at + 4 > len(data):
            raise FlacError("metadata cut short")
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind == 0:
            info = body
        elif kind == 3:
            if len(body) % 18:
                raise FlacError("seek table cut short")
            points += [p for p in struct.iter_unpack(">QQH", body) if p[0] != 0xFFFFFFFFFFFFFFFF]
        at += 4 + size
    if info is None or len(info) != 34:
        raise FlacError("no stream information")
    packed = int.from_bytes(info[10:18], "big")
    if len(data) < at:
        raise FlacError("metadata cut short")
    if packed >> 41 & 7:
        raise FlacError("only mono streams are read")
    return Stream(packed & (1 << 36) - 1, (packed >> 36 & 31) + 1, int.from_bytes(info[2:4], "big"), info[18:34], at, points)


def _header(raw: np.ndarray, at: int, stream_bits: int) -> tuple[int, int, int]:
    """(header's bytes, block size, bits of a sample) of the frame at a byte."""
    data = raw[at : at + 16].tobytes()
    if len(data) < 6 or data[0] != 0xFF or data[1] & 0xFE != 0xF8:
        raise FlacError(f"no frame at byte {at}")
    lead = data[4]
    size = 5 if lead < 0x80 else 4 + (8 - (lead ^ 0xFF).bit_length())
    code, rate = data[2] >> 4, data[2] & 15
    if code == 6:
        block, size = data[size] + 1, size + 1
    elif code == 7:
        block, size = int.from_bytes(data[size : size + 2], "big") + 1, size + 2
    elif code in CODE_BLOCKS:
        block = CODE_BLOCKS[code]
    elif 3 <= code <= 5:
        block = 576 << (code - 2)
    else:
        raise FlacError("reserved block size")
    size += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if data[3] >> 4:
        raise FlacError("only mono frames are read")
    if crc8(data[:size]) != data[size]:
        raise FlacError(f"header checksum of the frame at byte {at}")
    return size + 1, block, DEPTHS.get(data[3] >> 1 & 7, stream_bits)


class _Reader:
    """A bit pointer for each frame into one buffer."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        padded = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint32)
        n = len(raw) + 4
        self.words = padded[:n] << np.uint32(24) | padded[1 : n + 1] << np.uint32(16) | padded[2 : n + 2] << np.uint32(8) | padded[3 : n + 3]
        self.at = at.astype(np.int64)

    def window(self, rows) -> np.ndarray:
        """The next 25 bits at least, from the top of 32."""
        at = self.at[rows]
        return self.words[np.minimum(at >> 3, len(self.words) - 1)] << (at & 7).astype(np.uint32)

    def take(self, rows, width) -> np.ndarray:
        """Unsigned values of up to 24 bits; ``width`` may differ from row to row."""
        width = np.broadcast_to(np.asarray(width, np.int64), np.shape(self.at[rows]))
        value = np.where(width > 0, self.window(rows).astype(np.int64) >> np.maximum(32 - width, 0), 0)
        self.at[rows] += width
        return value

    def signed(self, rows, width) -> np.ndarray:
        value = self.take(rows, width)
        half = np.int64(1) << np.maximum(np.asarray(width, np.int64) - 1, 0)
        return np.where((value >= half) & (np.asarray(width) > 0), value - 2 * half, value)

    def unary(self, rows: np.ndarray) -> np.ndarray:
        """Zeros before the next one, which is passed."""
        total = np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            top = (self.window(rows[todo]) >> np.uint32(8)).astype(np.int64)  # 24 valid bits
            zeros = 24 - np.frexp(top.astype(np.float64))[1]
            total[todo] += zeros
            self.at[rows[todo]] += zeros + (zeros < 24)
            if (self.at[rows[todo]] > 8 * (len(self.words) + 4)).any():
                raise FlacError("residual runs past the stream")
            todo = todo[zeros == 24]
        return total


def _decode_frames(raw: np.ndarray, starts: np.ndarray, stream_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(samples by frame and place, block sizes, bytes right after each frame)."""
    heads = [_header(raw, int(a), stream_bits) for a in starts]
    sizes, depth = np.array([h[1] for h in heads]), np.array([h[2] for h in heads])
    reader, every = _Reader(raw, 8 * (starts + np.array([h[0] for h in heads]))), np.arange(len(starts))
    label = reader.take(every, 8)
    if (label >> 7).any():
        raise FlacError("bad subframe")
    wasted = np.zeros(len(starts), np.int64)
    flagged = every[(label & 1) == 1]
    wasted[flagged] = reader.unary(flagged) + 1
    kind, depth = label >> 1, depth - wasted
    order = np.where((kind >= 8) & (kind <= 12), kind - 8, np.where(kind >= 32, kind - 31, 0))
    if ((kind > 1) & (kind < 8) | (kind > 12) & (kind < 32)).any():
        raise FlacError("reserved subframe")
    out = np.zeros((int(sizes.max()) + 32, len(starts)), np.int64)  # 32 rows of history before the samples
    samples = out[32:]
    rows = every[kind == 0]
    samples[:, rows] = reader.signed(rows, depth[rows])
    verbatim = every[kind == 1]
    for t in range(int(sizes[verbatim].max()) if len(verbatim) else 0):
        rows = verbatim[sizes[verbatim] > t]
        samples[t, rows] = reader.signed(rows, depth[rows])
    coded = every[kind >= 8]
    for t in range(int(order[coded].max()) if len(coded) else 0):
        rows = coded[order[coded] > t]
        samples[t, rows] = reader.signed(rows, depth[rows])
    most = int(order.max()) if len(order) else 0
    coefficient, shift = np.zeros((max(most, 1), len(starts)), np.int64), np.zeros(len(starts), np.int64)
    for o in range(min(4, most) + 1):
        for j in range(o):
            coefficient[j, kind == 8 + o] = FIXED[o][j]
    linear = every[kind >= 32]
    precision = reader.take(linear, 4) + 1
    shift[linear] = reader.signed(linear, 5)
    for j in range(int(order[linear].max()) if len(linear) else 0):
        part = order[linear] > j
        coefficient[j, linear[part]] = reader.signed(linear[part], precision[part])
    if len(coded):
        # frames in order of their size, so that those still running are the first ones
        coded = coded[np.argsort(-sizes[coded], kind="stable")]
        method = reader.take(coded, 2)
        if (method > 1).any():
            raise FlacError("reserved residual coding")
        parts, wide = reader.take(coded, 4), 4 + method
        span = sizes[coded] >> parts
        parameter, raw_bits = np.zeros(len(coded), np.int64), np.full(len(coded), -1, np.int64)
        running = np.searchsorted(-sizes[coded], -np.arange(int(sizes[coded[0]])), "left")
        for t, n in enumerate(running.tolist()):
            now = coded[:n]
            opens = np.flatnonzero((t == order[now]) & (span[:n] > 0) | (t > order[now]) & (t % span[:n] == 0))
            if len(opens):
                parameter[opens] = reader.take(now[opens], wide[opens])
                escaped = parameter[opens] == (1 << wide[opens]) - 1
                raw_bits[opens] = -1
                if escaped.any():
                    raw_bits[opens[escaped]] = reader.take(now[opens[escaped]], 5)
            live = np.flatnonzero(t >= order[now]) if t < most else np.arange(n)
            if not len(live):
                continue
            frames = now[live]
            rice = raw_bits[live] < 0
            value = np.zeros(len(live), np.int64)
            if rice.all():
                high = reader.unary(frames)
                u = high << parameter[live] | reader.take(frames, parameter[live])
                value = u >> 1 ^ -(u & 1)
            else:
                high = reader.unary(frames[rice])
                u = high << parameter[live][rice] | reader.take(frames[rice], parameter[live][rice])
                value[rice] = u >> 1 ^ -(u & 1)
                value[~rice] = reader.signed(frames[~rice], raw_bits[live][~rice])
            predicted = np.zeros(len(live), np.int64)
            for j in range(most):
                predicted += coefficient[j, frames] * out[31 + t - j, frames]
            samples[t, frames] = value + (predicted >> shift[frames])
    samples <<= wasted
    ends = -(-reader.at // 8) + 2
    if (ends > len(raw)).any():
        raise FlacError("frame cut short")
    check = raw[ends - 2].astype(np.uint32) << np.uint32(8) | raw[ends - 1]
    if (crc16_many(raw, starts, ends - 2) != check).any():
        raise FlacError("frame checksum")
    return samples.T, sizes, ends


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """The signed samples of each file; FlacError where a checksum or the MD5 does not fit."""
    streams = [read_metadata(x) for x in files]
    pieces: list[list[np.ndarray]] = [[] for _ in files]
    work: list[tuple[int, int]] = []
    for i, s in enumerate(streams):
        if sum(p[2] for p in s.points) == s.samples and s.points and s.bits == streams[0].bits:
            work += [(i, s.first + p[1]) for p in s.points]
        else:  # without a full seek table one frame leads to the next
            raw, at, got = np.frombuffer(files[i], np.uint8), s.first, 0
            while got < s.samples:
                samples, sizes, ends = _decode_frames(raw, np.array([at]), s.bits)
                pieces[i].append(samples[0, : sizes[0]])
                at, got = int(ends[0]), got + int(sizes[0])
    base = np.cumsum([0, *(len(x) for x in files)])
    for k in range(0, len(work), AT_ONCE):
        part = work[k : k + AT_ONCE]
        low, high = part[0][0], part[-1][0]
        raw = np.frombuffer(b"".join(files[low : high + 1]), np.uint8)
        samples, sizes, _ = _decode_frames(raw, np.array([base[i] - base[low] + at for i, at in part]), streams[0].bits)
        for (i, _), x, n in zip(part, samples, sizes.tolist(), strict=True):
            pieces[i].append(x[:n])
    out = []
    for s, own in zip(streams, pieces, strict=True):
        samples = np.concatenate(own) if own else np.zeros(0, np.int64)
        kind = np.int8 if s.bits <= 8 else np.dtype("<i2")
        if len(samples) != s.samples or s.md5 != bytes(16) and hashlib.md5(samples.astype(kind).tobytes()).digest() != s.md5:
            raise FlacError("the samples are not those that were encoded")
        out.append(samples)
    return out


def read_samples(file: bytes, start: int, stop: int) -> np.ndarray:
    """Samples [start, stop) from the frames that hold them, found by the seek table."""
    stream = read_metadata(file)
    wanted = [p for p in stream.points if p[0] < stop and p[0] + p[2] > start]
    if not wanted:
        return decode_many([file])[0][start:stop]
    samples, sizes, _ = _decode_frames(np.frombuffer(file, np.uint8), np.array([stream.first + p[1] for p in wanted]), stream.bits)
    joined = np.concatenate([x[:n] for x, n in zip(samples, sizes.tolist(), strict=True)])
    return joined[start - wanted[0][0] : stop - wanted[0][0]]
