"""Splitting whole batches of UTF-8 texts into words with array operations.

A word is a maximal run of bytes of a class. All classes used here contain
either every or no byte above 127, so a byte-level split equals the split of
the characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of one chunk; the arrays of a chunk take about forty times as much.
CHUNK_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: A second base, for hashes of 128 bits.
OTHER_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_NGRAM = np.uint64(0xD1342543DE82EF95)
_NGRAM_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def _class(members) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = _class(set(range(256)) - {0x20, *range(0x09, 0x0E)})
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower case
ALPHANUMERIC = _class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _powers(base: np.uint64, n: int, known: dict = {}) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; kept for the life of the worker."""
    have = known.get(int(base))
    if have is None or len(have) <= n:
        steps = np.full(max(n + 1, CHUNK_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = known[int(base)] = np.multiply.accumulate(steps)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _segment_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64, inverse: np.uint64) -> np.ndarray:
    """A polynomial hash of values[start:end] for every pair, by prefix sums."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * _powers(base, n)[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(inverse, n)[starts])


@dataclass
class Words:
    """Words of some texts: byte ranges, and the words of text i at first[i]:first[i+1]."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, base: np.uint64 = _BASE) -> np.ndarray:
        """A 64-bit hash of each word."""
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        return _segment_hash(self.data.astype(np.uint64) + np.uint64(1), self.starts, self.ends, base, inverse)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start words of the windows of k words inside one text, and the text of each."""
        counts = np.maximum(self.counts - (k - 1), 0)
        text = np.repeat(np.arange(len(counts)), counts)
        before = np.cumsum(counts) - counts
        starts = np.arange(len(text)) - before[text] + self.first[:-1][text]
        return starts, text


def window_hashes(word_hashes: np.ndarray, starts: np.ndarray, k) -> np.ndarray:
    """A 64-bit hash of the k words from each start; k may be an array."""
    return _segment_hash(word_hashes, starts, starts + k, _NGRAM, _NGRAM_INVERSE)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n+1 offsets; a null text is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts of about ``limit`` bytes."""
    data, offsets = text_bytes(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def split_words(data: np.ndarray, offsets: np.ndarray, members: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    if lower:
        data = _LOWER[data]
    inside = members[data]
    n = len(data)
    edges = np.zeros(n + 1, dtype=bool)
    edges[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edges[1:n]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:] | edges[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))
