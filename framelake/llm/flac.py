"""Lossless FLAC streams of 8-bit samples in media columns, and their decoding.

``encode`` stores each payload as one mono FLAC stream with a seek point for
every frame; ``decode`` parses streams, undoes Rice coding and linear prediction
(constant, verbatim, fixed and LPC subframes, partitioned residuals, escape
codes, wasted bits), verifies each frame's CRC-8 and CRC-16 and the stream's MD5,
and returns PCM with the sample and byte offset of each block. Frames are coded
in step, a chunk at a time, also within a stream: one array operation handles the
same bit field or sample of all frames of the chunk, so no Python code runs for
each sample, and the arrays don't grow with the stream.

Defined cases: a null payload counts as empty; a stream of no samples has no
frames; null media decode to null; a stream that is cut or fails a checksum
raises ValueError. Repeated rows and null doc_ids pass through. Beside its arrays
for a chunk a worker holds a payload or stream whole, a few times; a seek table
has room for 932,067 frames (1 GB of samples), and longer streams have none and
are decoded frame by frame, which takes about ten times their bytes. An empty
table gives no rows. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import written
from framelake.llm.tokens import text_bytes

BLOCK = 1152
RATE = 8000
ORDER = 4
PRECISION = 12
#: Predictors that a frame may have, plainest first: (order, bits of a coefficient).
TRIED = [(1, 4), (2, 4), (ORDER, 6), (ORDER, PRECISION)]
#: A plainer predictor is taken if it takes at most one bit in so many more than the best: repeated words then have
#: the same codes more often, also across frames, and packing finds them.
HARDLY = 100
#: Samples coded together; the arrays of a chunk take about ninety times as many bytes.
CHUNK_BYTES = 2 << 20
#: How tables of media are packed, as Rice codes of text leave some redundancy.
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}
#: Fixed values of the format: block sizes by code, and predictors of order 0 to 4.
BLOCK_SIZES = [0, 192, 576, 1152, 2304, 4608, 0, 0, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768]
SAMPLE_BITS = [8, 8, 12, 0, 16, 20, 24, 32]
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _crc_table(poly: int, width: int, bits: int) -> np.ndarray:
    """The checksum register after ``bits`` bits, for every value of them."""
    top, mask = 1 << (width - 1), (1 << width) - 1
    crc = np.arange(1 << bits, dtype=np.int64) << (width - bits)
    for _ in range(bits):
        crc = np.where(crc & top, (crc << 1) ^ poly, crc << 1) & mask
    return crc.astype(np.uint16)


CRC8 = _crc_table(0x07, 8, 8)
#: The checksum has 16 bits, so a table of all 16-bit values takes two bytes a step.
CRC16 = _crc_table(0x8005, 16, 16)
_LEADING = np.array([16 - int(x).bit_length() for x in range(1 << 16)], dtype=np.uint8)


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each data[start:end], in step. Zeros in front don't change it."""
    out = np.zeros(len(starts), dtype=np.uint16)
    order = np.argsort(ends - starts, kind="stable")
    for part in np.array_split(order, max(1, len(order) // 512)):
        steps = (int((ends - starts)[part].max(initial=0)) + 1) // 2
        at = ends[part][None, :] - 2 * np.arange(steps, 0, -1)[:, None]
        at = np.stack([at, at + 1])
        two = np.where(at >= starts[part], data[np.maximum(at, 0)], 0).astype(np.uint16)
        words = two[0] << 8 | two[1]
        crc = np.zeros(len(part), dtype=np.uint16)
        for word in words:
            crc = CRC16[crc ^ word]
        out[part] = crc
    return out


# --- encoding -------------------------------------------------------------


def _predictors(x: np.ndarray) -> list[np.ndarray]:
    """Coefficients (order, frames) for orders 1 to ORDER, by autocorrelation and Levinson's recursion."""
    f, n = x.shape[0], x.shape[1]
    real = x.astype(np.float64)
    r = np.stack([np.einsum("ij,ij->i", real[:, : n - k], real[:, k:]) for k in range(ORDER + 1)])
    a, err = np.zeros((ORDER, f)), r[0] * (1 + 1e-9) + 1e-9
    found = []
    for i in range(ORDER):
        k = (r[i + 1] - sum(a[j] * r[i - j] for j in range(i))) / err
        b = a.copy()
        b[i] = k
        for j in range(i):
            b[j] = a[j] - k * a[i - 1 - j]
        a, err = b, np.maximum(err * (1 - k * k), 1e-9)
        found.append(a[: i + 1])
    return found


def _quantised(a: np.ndarray, precision: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of so many bits (frames, order), and shifts."""
    most = np.maximum(np.abs(a).max(axis=0), 1e-6)
    shift = np.clip(precision - 2 - np.floor(np.log2(most)).astype(np.int64), 0, 15)
    limit = 1 << (precision - 1)
    return np.clip(np.rint(a * 2.0**shift), -limit, limit - 1).astype(np.int64).T, shift


class _Subframes(NamedTuple):
    """Frames by linear prediction: coefficients (frames, ORDER), Rice codes from ``order`` on, and bits in all."""

    order: np.ndarray
    precision: np.ndarray
    shift: np.ndarray
    coefs: np.ndarray
    k: np.ndarray
    z: np.ndarray
    cost: np.ndarray


def _predicted(x: np.ndarray) -> _Subframes:
    """Each frame by the plainest predictor of TRIED that takes hardly more bits than the best."""
    f, n = x.shape
    found, tried = _predictors(x), []
    x = x.astype(np.int32)
    for order, precision in TRIED:
        own, shift = (v.astype(np.int32) for v in _quantised(found[order - 1], precision))
        guess = sum(own[:, j, None] * x[:, order - 1 - j : n - 1 - j] for j in range(order)) >> shift[:, None]
        z, coefs = np.zeros((f, n), np.int32), np.zeros((f, ORDER), np.int64)
        z[:, order:], coefs[:, :order] = _zigzag(x[:, order:] - guess), own
        k = np.clip(np.floor(np.log2(np.maximum(z.sum(axis=1) / (n - order) * 0.75, 1))), 0, 14).astype(np.int32)
        cost = (z >> k[:, None]).sum(axis=1) + (k + 1) * (n - order) + 8 * order + 9 + order * precision + 10
        tried.append(_Subframes(np.full(f, order), np.full(f, precision), shift, coefs, k, z, cost))
    costs = np.stack([t.cost for t in tried])
    least = costs.min(axis=0)
    taken = (costs <= least + least // HARDLY).argmax(axis=0)
    return _Subframes(*(np.stack(v)[taken, np.arange(f)] for v in zip(*tried)))


def _zigzag(r: np.ndarray) -> np.ndarray:
    return r << 1 ^ r >> 8 * r.itemsize - 1


def _utf8_number(n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The bytes of frame numbers (below 2**31, as the format has it) as (value, bits) columns; absent bytes have 0 bits."""
    if (n >= 1 << 31).any():
        raise ValueError("a stream has at most 2**31 frames")
    n = n.astype(np.int64)
    # A number of k bytes has 5 k + 1 bits, but 7 if k is 1: k ones and a zero lead, six bits follow in each further byte.
    extra = sum((n >= limit).astype(np.int64) for limit in (0x80, 0x800, 0x10000, 0x200000, 0x4000000))
    lead = np.where(extra == 0, 0, 0x100 - (1 << (7 - np.minimum(extra, 6)))) & 0xFF
    columns = [(lead | n >> 6 * extra, np.full(len(n), 8))]
    for j in range(5):
        there = extra > j
        columns.append((np.where(there, 0x80 | (n >> 6 * np.maximum(extra - 1 - j, 0)) & 63, 0), np.where(there, 8, 0)))
    return columns


def _frames(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of frames of one block size: values and bits, each (frames, codes)."""
    f, n = x.shape
    whole = lambda v: np.full(f, v)
    head = [(whole(0xFF), whole(8)), (whole(0xF8), whole(8))]
    head += [(whole((3 if n == BLOCK else 7) << 4 | 4), whole(8)), (whole(0x02), whole(8)), *_utf8_number(number)]
    if n != BLOCK:
        head += [(whole((n - 1) >> 8), whole(8)), (whole((n - 1) & 255), whole(8))]
    crc = np.zeros(f, dtype=np.uint16)
    for v, bits in head:
        crc = np.where(bits > 0, CRC8[crc ^ v.astype(np.uint16)], crc)
    head.append((crc, whole(8)))
    p = _predicted(x)
    kind = np.where((x == x[:, :1]).all(axis=1), 0, np.where(p.cost < 8 * n, 2, 1))
    head.append((np.choose(kind, [0x00, 0x02, (0x20 | (p.order - 1)) << 1]), whole(8)))
    lpc = kind == 2
    used = [lpc & (j < p.order) for j in range(ORDER)]
    head += [(x[:, j] & 255, np.where(used[j] | (kind == 0) & (j == 0), 8, 0)) for j in range(ORDER)]
    head += [(p.precision - 1, np.where(lpc, 4, 0)), (p.shift, np.where(lpc, 5, 0))]
    head += [(p.coefs[:, j] & ((1 << p.precision) - 1), np.where(used[j], p.precision, 0)) for j in range(ORDER)]
    head += [(p.k, np.where(lpc, 10, 0))]
    # A constant frame has no codes here, a verbatim one all samples, others all but the first ``order``.
    values, bits = np.zeros((f, n), np.int64), np.zeros((f, n), np.int64)
    raw = kind == 1
    values[raw], bits[raw] = x[raw] & 255, 8
    k, z = p.k[lpc, None], p.z[lpc].astype(np.int64)
    values[lpc], bits[lpc] = z & ((1 << k) - 1) | 1 << k, (z >> k) + 1 + k
    for j in range(ORDER):
        bits[lpc & (j < p.order), j] = 0
    return np.concatenate([np.stack([v for v, _ in head], 1), values], 1), np.concatenate([np.stack([b for _, b in head], 1), bits], 1)


def _packed(values: np.ndarray, ends: np.ndarray, n_bytes: int) -> np.ndarray:
    """Bytes in which each value's last bit is at its end; values don't overlap."""
    last = ends - 1
    word, value = last >> 5, values.astype(np.uint64) << (31 - (last & 31)).astype(np.uint64)
    n = (n_bytes + 3) // 4 + 1
    sums = np.bincount(word, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    over = np.flatnonzero(value >> np.uint64(32))
    sums += np.bincount(word[over] - 1, (value[over] >> np.uint64(32)).astype(np.float64), n)
    return sums.astype(np.uint32).astype(">u4").view(np.uint8)[:n_bytes]


def encode_batch(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """One FLAC stream for each data[offsets[i]:offsets[i+1]] of unsigned bytes."""
    sizes = np.diff(offsets)
    counts = -(-sizes // BLOCK)
    stream = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(stream)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = offsets[:-1][stream] + number * BLOCK
    length = np.minimum(offsets[1:][stream] - begin, BLOCK)
    out: list[bytes] = [b""] * len(stream)
    for own in _chunks(length):
        n = int(length[own[0]])
        if n <= ORDER:
            raise ValueError("blocks of so few samples aren't written; pad the payload")
        samples = data[begin[own][:, None] + np.arange(n)].astype(np.int64) - 128
        values, bits = _frames(samples, number[own])
        ends = np.cumsum(bits, axis=1)
        frame_bytes = -(-ends[:, -1] // 8)
        starts = np.cumsum(frame_bytes) - frame_bytes
        ends += 8 * starts[:, None]
        used = bits > 0
        packed = _packed(values[used], ends[used], int(frame_bytes.sum()))
        crc = crc16(packed, starts, starts + frame_bytes)
        raw = packed.tobytes()
        for i, s, b, c in zip(own.tolist(), starts.tolist(), frame_bytes.tolist(), crc.tolist()):
            out[i] = raw[s : s + b] + struct.pack(">H", c)
    streams, at = [], 0
    for i, n_frames in enumerate(counts.tolist()):
        frames, at = out[at : at + n_frames], at + n_frames
        # Flipping the top bit is taking 128 away, in two's complement.
        streams.append(_stream(frames, (data[offsets[i] : offsets[i + 1]] ^ np.uint8(128)).tobytes()))
    return streams


def _chunks(length: np.ndarray) -> Iterator[np.ndarray]:
    """Frames of one length that are coded together."""
    for n in np.unique(length).tolist():
        own, step = np.flatnonzero(length == n), max(1, CHUNK_BYTES // n)
        for i in range(0, len(own), step):
            yield own[i : i + step]


def _stream(frames: list[bytes], samples: bytes) -> bytes:
    lengths = [len(x) for x in frames]
    info = struct.pack(">HH", BLOCK, BLOCK) + min(lengths, default=0).to_bytes(3, "big") + max(lengths, default=0).to_bytes(3, "big")
    info += (RATE << 44 | 7 << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(samples).digest()
    points, at = [], 0
    for i, n in enumerate(lengths):
        points.append(struct.pack(">QQH", i * BLOCK, at, min(BLOCK, len(samples) - i * BLOCK)))
        at += n
    seek = b"".join(points)
    if len(seek) >= 1 << 24:
        return b"".join([b"fLaC\x80\x00\x00\x22", info, *frames])
    return b"".join([b"fLaC\x00\x00\x00\x22", info, b"\x83", len(seek).to_bytes(3, "big"), seek, *frames])


# --- decoding -------------------------------------------------------------


class _Bits:
    """Bit fields at many positions of one buffer at once."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate([data, np.zeros(16, np.uint8)])
        n = len(self.data) - 7
        self.words = np.ndarray((n,), ">u8", self.data.tobytes(), strides=(1,)).astype(np.uint64)

    def window(self, at: np.ndarray) -> np.ndarray:
        """The next 57 bits or more, from the top of 64."""
        where = at >> 3
        if len(where) and where.max() >= len(self.words):
            raise ValueError("the stream is cut")
        return self.words[where] << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, n) -> np.ndarray:
        return (self.window(at) >> np.uint64(1) >> np.asarray(63 - n).astype(np.uint64)).astype(np.int64)

    def signed(self, at: np.ndarray, n) -> np.ndarray:
        return self.window(at).view(np.int64) >> np.asarray(64 - n)

    def zeros(self, at: np.ndarray) -> np.ndarray:
        """The number of 0 bits before the next 1."""
        count = _LEADING[self.window(at) >> np.uint64(48)].astype(np.int64)
        open_ = np.flatnonzero(count == 16)
        while len(open_):
            more = _LEADING[self.window(at[open_] + count[open_]) >> np.uint64(48)].astype(np.int64)
            count[open_] += more
            open_ = open_[more == 16]
        return count


def _residuals(bits: _Bits, at: np.ndarray, order: int, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals (samples, frames) of frames of one order, largest block first, and the positions after them."""
    method, parts = bits.take(at, 2), bits.take(at + 2, 4)
    if (method > 1).any():
        raise ValueError("unknown residual coding")
    at = at + 6
    wide, per_part = 4 + method, size >> parts
    most = int(size.max())
    out = np.zeros((most, len(size)), dtype=np.int64)
    raw = np.full(len(size), -1)
    k = np.zeros(len(size), dtype=np.int64)
    active = len(size) - np.searchsorted(size[::-1], np.arange(most), side="right")
    edges = np.zeros(most + 1, dtype=bool)
    for width in np.unique(per_part):
        edges[:: max(int(width), 1)] = True
    edges[order] = True
    escapes = False
    for i in range(order, most):
        m = active[i]
        if edges[i]:
            fresh = np.flatnonzero((i % per_part[:m] == 0) | (i == order))
            k[fresh] = bits.take(at[fresh], wide[fresh])
            at[fresh] += wide[fresh]
            escaped = fresh[k[fresh] == (1 << wide[fresh]) - 1]
            raw[fresh] = -1
            raw[escaped] = bits.take(at[escaped], 5)
            at[escaped] += 5
            k[escaped] = 0
            escapes = bool((raw >= 0).any())
            skip = (63 - k).astype(np.uint64)
            shift = k.astype(np.uint64)
        p = at[:m]
        window = bits.words[p >> 3] << (p & 7).view(np.uint64)
        q = _LEADING[window >> np.uint64(48)].astype(np.uint64)
        if (q == 16).any() or escapes:
            q = bits.zeros(p).astype(np.uint64)
            if escapes:
                q[raw[:m] >= 0] = 0
            rest = bits.window(p + q.view(np.int64) + 1) >> np.uint64(1) >> skip[:m]
        else:
            rest = window << (q + np.uint64(1)) >> np.uint64(1) >> skip[:m]
        out[i, :m] = q << shift[:m] | rest
        at[:m] += (q + np.uint64(1)).view(np.int64) + k[:m]
        if escapes:
            own = np.flatnonzero(raw[:m] >= 0)
            at[own] -= 1 + k[own]
            some = own[raw[own] > 0]
            out[i, own] = 0
            out[i, some] = _zigzag(bits.signed(at[some], raw[some]))
            at[own] += raw[own]
    return (out >> 1) ^ -(out & 1), at


def _decode_frames(bits: _Bits, start: np.ndarray, n_bits: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Samples of the frame at each byte, block numbers and the bytes after the frames; checks both checksums."""
    data, at = bits.data, start * 8
    if (bits.take(at, 15) != 0x7FFC).any():
        raise ValueError("no frame where one should start")
    codes = bits.take(at + 16, 16)
    size_code, rate_code, channels, depth = codes >> 12, codes >> 8 & 15, codes >> 4 & 15, codes >> 1 & 7
    if channels.any():
        raise ValueError("only mono streams are decoded")
    first = data[start + 4].astype(np.int64)
    extra = np.maximum(_LEADING[(first << 8) ^ 0xFFFF].astype(np.int64), 1) - 1
    number = np.where(first < 0x80, first, first & (0x3F >> np.maximum(extra, 1)))
    for j in range(int(extra.max(initial=0))):
        number = np.where(extra > j, number << 6 | data[start + 5 + j] & 63, number)
    at = at + 40 + 8 * extra
    sizes = np.array(BLOCK_SIZES)[size_code]
    for code, width in ((6, 8), (7, 16)):
        sizes = np.where(size_code == code, bits.take(at, width) + 1, sizes)
        at = at + np.where(size_code == code, width, 0)
    at = at + np.select([rate_code == 12, (rate_code == 13) | (rate_code == 14)], [8, 16], 0)
    crc, length = np.zeros(len(at), np.uint16), (at >> 3) - start
    for j in range(int(length.max(initial=0))):
        crc = np.where(j < length, CRC8[crc ^ data[start + j]], crc)
    if (crc != data[at >> 3]).any():
        raise ValueError("a frame header's checksum is wrong")
    at = at + 8
    n_bits = np.where(depth == 0, n_bits, np.array(SAMPLE_BITS)[depth])
    kind, wasted = bits.take(at + 1, 6), bits.take(at + 7, 1)
    at = at + 8
    lost = np.where(wasted == 1, bits.zeros(at) + 1, 0)
    at, n_bits = at + lost, n_bits - lost
    lpc = kind >= 32
    order = np.select([lpc, (kind >= 8) & (kind <= 12)], [(kind & 31) + 1, kind & 7], -1)
    if ((order < 0) & (kind > 1)).any():
        raise ValueError("unknown subframe")
    samples: list[np.ndarray] = [np.zeros(0, np.int64)] * len(at)
    for what in np.unique(order):
        own = np.flatnonzero(order == what)
        own = own[np.argsort(-sizes[own], kind="stable")]
        size, width, p = sizes[own], n_bits[own], at[own].copy()
        most = int(size.max())
        if what < 0:
            every = np.arange(most)[:, None]
            step = np.where(kind[own] == 0, 0, width)
            where = np.minimum(p + every * step, 8 * len(data) - 64)
            out = bits.signed(where, width)
            p = p + np.where(kind[own] == 0, width, width * size)
        else:
            warm = np.stack([bits.signed(p + j * width, width) for j in range(what)]) if what else np.zeros((0, len(own)), np.int64)
            p += what * width
            own_lpc = lpc[own]
            coefs, shift = np.repeat(np.array(FIXED[what] if what <= 4 else [0] * what, np.int64)[:, None], len(own), 1), np.zeros(len(own), np.int64)
            precision = np.where(own_lpc, bits.take(p, 4) + 1, 0)
            shift = np.where(own_lpc, bits.signed(p + 4, 5), 0)
            if (shift < 0).any():
                raise ValueError("negative shift")
            p += np.where(own_lpc, 9, 0)
            for j in range(what):
                coefs[j] = np.where(own_lpc, bits.signed(p, np.maximum(precision, 1)), coefs[j])
                p += precision
            out, p = _residuals(bits, p, int(what), size)
            out[:what] = warm
            backwards = coefs[::-1]
            if what:
                for i in range(int(what), most):
                    out[i] += (out[i - what : i] * backwards).sum(axis=0) >> shift
        out = (out << lost[own]).T
        for i, j in enumerate(own):
            samples[j] = out[i, : sizes[j]]
        at[own] = p
    end = (at + 7) >> 3
    if (end + 2 > len(data) - 16).any():
        raise ValueError("the stream is cut")
    if (crc16(data, start, end) != (data[end].astype(np.uint16) << 8 | data[end + 1])).any():
        raise ValueError("a frame's checksum is wrong")
    return samples, number, end + 2


def _metadata(media: bytes) -> tuple[int, int, bytes, list[int], int]:
    """Bits a sample, samples, MD5, offsets of the frames in the seek table and of the first frame."""
    if media[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, last, points, info = 4, False, [], b""
    while not last:
        head, n = media[at], int.from_bytes(media[at + 1 : at + 4], "big")
        body, last, at = media[at + 4 : at + 4 + n], bool(head & 128), at + 4 + n
        if len(body) < n or not n and not last and at >= len(media):
            raise ValueError("the stream is cut")
        if head & 127 == 0:
            info = body
        elif head & 127 == 3:
            points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != 0xFFFFFFFFFFFFFFFF]
    packed = int.from_bytes(info[10:18], "big")
    block = int.from_bytes(info[2:4], "big")
    total = packed & ((1 << 36) - 1)
    every = [p[1] for p in points] if [p[0] for p in points] == list(range(0, total, block)) else []
    return (packed >> 36 & 31) + 1, total, info[18:34], every, at


def _kinds(depth: int) -> tuple[str, str]:
    """The type that samples are stored in, and the next wider one, in which they are handed on."""
    return ("<i1", "<i2") if depth <= 8 else ("<i2", "<i4") if depth <= 16 else ("<i4", "<i8")


def _spans(meta: list[tuple], sizes: list[int]) -> Iterator[list[tuple[int, int, int]]]:
    """Frames with seek points, (stream, first byte, end), in lists of about CHUNK_BYTES samples."""
    group, samples = [], 0
    for i, (_, total, _, points, at) in enumerate(meta):
        each = -(-total // max(1, len(points)))
        for p, end in zip(points, [*(at + p for p in points[1:]), sizes[i]]):
            group.append((i, at + p, end))
            samples += each
            if samples >= CHUNK_BYTES:
                yield group
                group, samples = [], 0
    if group:
        yield group


def _cut(media: list[bytes], spans: list[tuple[int, int, int]]) -> tuple[_Bits, dict[int, int]]:
    """The bytes of these spans in one buffer, and where in it each stream's first byte would be."""
    pieces, base, size = [], {}, 0
    for i, own in groupby(spans, key=itemgetter(0)):
        own = list(own)
        piece = media[i][own[0][1] : own[-1][2]]
        base[i], size = size - own[0][1], size + len(piece)
        pieces.append(piece)
    return _Bits(np.frombuffer(b"".join(pieces), np.uint8)), base


def decode_batch(media: list[bytes]) -> list[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """(samples, blocks) of each stream; a block is (first sample, samples, byte offset).

    With a seek point for every frame, frames are decoded in step, a chunk at a
    time; else the first frames of all such streams, then the second ones, and so on.
    Samples have two, four or eight bytes, by the stream's depth.
    """
    meta = [_metadata(m) for m in media]
    got: list[list] = [[] for _ in media]

    def step(bits: _Bits, base: dict[int, int], frames: list[tuple[int, int]]) -> list[tuple[int, int]]:
        start = np.array([base[i] + a for i, a in frames], dtype=np.int64)
        samples, _, ends = _decode_frames(bits, start, np.array([meta[i][0] for i, _ in frames]))
        for (i, a), x in zip(frames, samples):
            got[i].append((a, x.astype(_kinds(meta[i][0])[1])))
        return [(i, int(e) - base[i]) for (i, _), e in zip(frames, ends)]

    for spans in _spans(meta, [len(m) for m in media]):
        step(*_cut(media, spans), [(i, a) for i, a, _ in spans])
    due = [(i, m[4]) for i, m in enumerate(meta) if m[1] and not m[3]]
    if due:
        bits, base = _cut(media, [(i, a, len(media[i])) for i, a in due])
        done = dict.fromkeys(base, 0)
        while due:
            after = step(bits, base, due)
            for i, _ in due:
                done[i] += len(got[i][-1][1])
            due = [(i, e) for i, e in after if done[i] < meta[i][1]]
    out = []
    for i, (depth, total, md5, _, _) in enumerate(meta):
        frames, got[i] = got[i], []
        samples = np.concatenate([x for _, x in frames]) if frames else np.zeros(0, _kinds(depth)[1])
        if len(samples) != total:
            raise ValueError("samples are missing")
        if depth in (8, 16, 32) and any(md5) and hashlib.md5(samples.astype(_kinds(depth)[0])).digest() != md5:
            raise ValueError("the samples' checksum is wrong")
        firsts = np.cumsum([0, *(len(x) for _, x in frames)]).tolist()
        out.append((samples, [(f, len(x), int(s)) for f, (s, x) in zip(firsts, frames)]))
    return out


def features(samples: np.ndarray) -> tuple[int, int, int]:
    """The largest magnitude, how often the signal turns, and its energy; wide numbers are made a chunk at a time."""
    turns = energy = 0
    for a in range(0, len(samples), CHUNK_BYTES):
        part = samples[a : a + CHUNK_BYTES + 2].astype(np.int64)
        falls = np.diff(part) < 0
        turns += int((falls[1:] != falls[:-1]).sum())
        energy += int((part[:CHUNK_BYTES] ** 2).sum())
    return max(int(samples.max(initial=0)), -int(samples.min(initial=0))), turns, energy


# --- columns --------------------------------------------------------------


def _runs(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    ends, at = np.cumsum(lengths), 0
    while at < len(lengths):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, side="right")))
        yield at, end
        at = end


def encode(df: DataFrame, payload_col: str, id_col: str = "doc_id") -> DataFrame:
    """(id, media): each binary payload as a FLAC stream of 8-bit samples (byte - 128)."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(payload_col), F.lit(b"")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in _runs(np.diff(offsets)):
                part = data[offsets[a] : offsets[b]]
                media = pa.array(encode_batch(part, offsets[a : b + 1] - offsets[a]), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), media], ["doc_id", "media"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, media binary")


DECODED = "media binary, pcm binary, blocks array<struct<first_sample:bigint,n_samples:int,byte_offset:bigint>>, peak int, crossings bigint, energy bigint"


def decode(media: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """Streams of up to 8 bits a sample: PCM as unsigned bytes, its blocks, and features of the signal.

    Blocks are seekable: the samples from ``first_sample`` are in the frame at
    ``byte_offset`` of the stream.
    """
    rows = media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"))
    fields = pa.struct([("first_sample", pa.int64()), ("n_samples", pa.int32()), ("byte_offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored = batch.column(1).to_pylist()
            for a, b in _runs(np.array([len(x or b"") for x in stored])):
                out: dict[str, list] = {k: [] for k in ("pcm", "blocks", "peak", "crossings", "energy")}
                found = iter(decode_batch([x for x in stored[a:b] if x is not None]))
                for x in stored[a:b]:
                    if x is None:
                        for values in out.values():
                            values.append(None)
                        continue
                    samples, blocks = next(found)
                    out["pcm"].append((samples.astype(np.uint8) + np.uint8(128)).tobytes())
                    out["blocks"].append([dict(zip(("first_sample", "n_samples", "byte_offset"), t)) for t in blocks])
                    for name, value in zip(("peak", "crossings", "energy"), features(samples)):
                        out[name].append(value)
                kinds = [pa.binary(), pa.list_(fields), pa.int32(), pa.int64(), pa.int64()]
                columns = [pa.array(v, t) for v, t in zip(out.values(), kinds)]
                columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *columns]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "media", *out])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {DECODED}")


def pcm_blocks(decoded: DataFrame) -> DataFrame:
    """One row for each block: (doc_id, block, first_sample, n_samples, byte_offset, pcm)."""
    rows = decoded.select("doc_id", "pcm", F.posexplode("blocks").alias("block", "b"))
    pcm = F.substring(F.col("pcm"), (F.col("b.first_sample") + 1).cast("int"), F.col("b.n_samples"))
    return rows.select("doc_id", "block", "b.*", pcm.alias("pcm"))


def write_pcm_blocks(decoded: DataFrame, path: str) -> None:
    pcm_blocks(decoded).write.parquet(path)


def padded(text: Column, unit: int = 192) -> Column:
    """UTF-8 bytes of a text (null: empty), with blanks up to a positive multiple of ``unit``."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    target = F.greatest(F.lit(unit), F.ceil(n / unit) * unit).cast("int")
    return F.concat(raw, F.encode(F.repeat(F.lit(" "), target - n), "UTF-8"))


def digest(docs: DataFrame) -> DataFrame:
    """Stores every text of documents as FLAC, reads the streams back and describes them."""
    payload = docs.select("doc_id", padded(F.col("text")).alias("payload"), F.octet_length(F.coalesce("text", F.lit(""))).alias("n"))
    key = F.struct(F.col("doc_id"), F.col("n").cast("long").alias("n_bytes"))
    stored = written(encode(payload.select(key.alias("key"), "payload"), "payload", "key"), "flac-media", **PACKED)
    d = decode(stored)
    shown = F.format_string("blocks=%d;peak=%d;turns=%d;energy=%d", F.size("blocks"), "peak", "crossings", "energy")
    return d.select(
        "doc_id.doc_id",
        "doc_id.n_bytes",
        F.octet_length("pcm").cast("long").alias("payload_bytes"),
        F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.substring("pcm", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        shown.alias("feature"),
        F.size("blocks").cast("long").alias("n_blocks"),
    )
