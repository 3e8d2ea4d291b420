"""Exact repeats across documents by fixed-block anchors.

Every document is cut into non-overlapping blocks of BLOCK words, and the hashes
of these blocks are the index; every rolling window of BLOCK words, at any
position, probes it. A window of WINDOW >= 2 * BLOCK - 1 words holds a whole
block, so two documents that share such a window meet at the hash of a block of
one of them. A hit is extended to both sides as far as a window can reach; which
of these longer windows really repeat, and in which document first, is settled
by their own hashes. Consecutive windows that repeat make one maximal repeat.

Probes travel packed: one binary value for all probes of a batch that go to the
same part of the hash range, with 40 bits of hash and the gaps between
positions. So a probe costs about seven bytes, and no documents are paired. What
is found travels back packed too, in one row for each part of the hash range and
bucket of documents. False meetings of 40-bit hashes only make more windows to
settle; those are compared by 128 bits.

Hot hashes are combined before they are shuffled. A hash that LOCAL entries of a
batch and two of its documents have is a hit there and then, and three of these
entries stand for it elsewhere. Of the equal windows of a bucket of documents
only those of the smallest doc_id travel: the others repeat it, whatever the rest
of the table holds.

Defined cases: a null text has no words; a document shorter than WINDOW loses
nothing; a window counts if it also starts in a document with a smaller doc_id,
never for repeats within one document or between rows that share a doc_id;
repeated rows give repeated results; rows that share a doc_id but not the text
are versions of one document, and what goes at a place in one goes there in all;
a null doc_id is compared with nothing; an
empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import partitions, scratch, written
from framelake.llm.tokens import OTHER_BASE, chunks, split_words, window_hashes

WINDOW = 50
BLOCK = 25
#: Bytes kept of a probe's hash, and of a settled window's two hashes.
PROBE_BYTES = 5
WINDOW_BYTES = 16
#: A hash with so many entries in a batch, of two or more documents, is settled there.
LOCAL = 16
#: The top bits that choose a part; the hash bytes kept come from below them.
PART_BITS = 16
#: The hash range has a part for each shuffle partition, and documents a few buckets for each part.
BUCKETS_PER_PART = 2

PACKED = "part int, docs binary, counts binary, gaps binary, hashes binary"


def _gaps(positions: np.ndarray, fresh: np.ndarray) -> bytes:
    """Ascending positions within each document as variable-length gaps (7 bits a byte)."""
    gap = positions.astype(np.int64)
    gap[1:] -= np.where(fresh[1:], 0, positions[:-1])
    size = np.ones(len(gap), np.int64)
    for bits in (7, 14, 21, 28):
        size += gap >= 1 << bits
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for j in range(int(size.max(initial=0))):
        own = size > j
        more = (size[own] > j + 1).astype(np.int64) << 7
        out[ends[own] - size[own] + j] = (gap[own] >> (7 * j)) & 127 | more
    return out.tobytes()


def _positions(packed: bytes, counts: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8).astype(np.int64)
    last = np.flatnonzero(raw < 128)
    start = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    step = np.arange(len(raw)) - np.repeat(start, last - start + 1)
    gaps = np.add.reduceat((raw & 127) << (7 * step), start) if len(last) else last
    total = np.cumsum(gaps)
    begin = np.cumsum(counts) - counts
    before = np.where(begin > 0, total[begin - 1], 0)
    return total - np.repeat(before, counts)


def _pack(doc: np.ndarray, position: np.ndarray, hashes: np.ndarray, parts: int, n_bytes: int) -> Iterator[tuple]:
    """Entries, ordered by row and position, to one row for each part of the hash range; a hash is a number or a row of them."""
    first = hashes if hashes.ndim == 1 else hashes[:, 0]
    part = ((first >> np.uint64(64 - PART_BITS)) * np.uint64(parts) >> np.uint64(PART_BITS)).astype(np.uint16)
    order = np.argsort(part, kind="stable")
    part, doc, position, hashes = part[order], doc[order], position[order], hashes[order]
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else part
    raw = np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(len(hashes), -1)[:, :n_bytes] if len(hashes) else hashes
    for a, b in zip(edges, [*edges[1:], len(part)]):
        d, p = doc[a:b], position[a:b]
        # Rows that share a doc_id follow one another, so positions may fall within it; gaps can't.
        fresh = np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] < p[:-1])])
        begin = np.flatnonzero(fresh)
        counts = np.diff([*begin, b - a]).astype("<u4")
        yield int(part[a]), d[begin].astype("<i8").tobytes(), counts.tobytes(), _gaps(p, fresh), raw[a:b].tobytes()


def _unpack(rows: pa.Table, n_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = -(-n_bytes // 8)
    doc, position, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for docs, counts, gaps, raw in zip(*(rows.column(k).to_pylist() for k in ("docs", "counts", "gaps", "hashes"))):
        n = np.frombuffer(counts, "<u4").astype(np.int64)
        doc.append(np.repeat(np.frombuffer(docs, "<i8"), n))
        position.append(_positions(gaps, n))
        wide = np.zeros((int(n.sum()), 8 * width), np.uint8)
        wide[:, :n_bytes] = np.frombuffer(raw, np.uint8).reshape(-1, n_bytes)
        hashes.append(wide.reshape(-1).view("<u8"))
    hashes = np.concatenate(hashes)
    return np.concatenate(doc), np.concatenate(position), hashes if width == 1 else hashes.reshape(-1, width)


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], limit: int = 256) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


_PACKED_NAMES = ["part", "docs", "counts", "gaps", "hashes"]
_PACKED_KINDS = [pa.int32(), *[pa.binary()] * 4]
_HIT_NAMES, _HIT_KINDS = ["bucket", "docs", "counts", "gaps"], [pa.int64(), *[pa.binary()] * 3]
_HITS = "bucket long, docs binary, counts binary, gaps binary"
#: Bytes of text whose probes are packed together; more make fewer and fuller rows.
BATCH_BYTES = 8 << 20


def _settled(doc: np.ndarray, position: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries of a batch travel, and the places of those that are hits whatever other batches hold."""
    order = np.argsort(hashes, kind="stable")
    travels, none = np.ones(len(order), bool), order[:0]
    h = hashes[order]
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else none
    n = np.diff(np.append(edge, len(h)))
    own = order[np.repeat(n >= LOCAL, n)]
    n = n[n >= LOCAL]
    if not len(n):
        return travels, none
    start = np.cumsum(n) - n
    several = np.maximum.reduceat(doc[own], start) != np.minimum.reduceat(doc[own], start)
    own, n = own[np.repeat(several, n)], n[several]
    if not len(n):
        return travels, none
    start, group = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    # A smallest and a largest doc_id of each hash stand for it, and the start of a block if there is one.
    by_doc = own[np.lexsort((doc[own], group))]
    by_block = own[np.lexsort((position[own] % BLOCK != 0, group))]
    travels[own] = False
    travels[np.concatenate([by_doc[start], by_doc[start + n - 1], by_block[start]])] = True
    return travels, own


def _probes(parts: int, buckets: int) -> Callable:
    def packed(held: list[tuple]) -> Iterator[tuple]:
        doc, position, hashes = (np.concatenate(x) for x in zip(*held))
        travels, hit = _settled(doc, position, hashes)
        yield from _pack(doc[travels], position[travels], hashes[travels], parts, PROBE_BYTES)
        yield from _known(doc[hit], position[hit], buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held, size = [], 0
            for b in batches:
                ids = b.column(0).to_numpy(zero_copy_only=False)
                for first, end, data, offsets in chunks(b.column(1)):
                    words = split_words(data, offsets)
                    hashes = words.hashes()
                    starts, text = words.windows(BLOCK)
                    # A document shorter than a window has no part in any repeat.
                    long = (words.counts >= WINDOW)[text]
                    starts, text = starts[long], text[long]
                    found = window_hashes(hashes, starts, BLOCK)
                    held.append((ids[first:end][text], starts - words.first[:-1][text], found))
                    size += len(data)
                    if size >= BATCH_BYTES:
                        yield from packed(held)
                        held, size = [], 0
            if held:
                yield from packed(held)

        yield from _batches(rows(), _PACKED_NAMES, _PACKED_KINDS)

    return run


def _bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (doc ^ doc >> 17) % buckets


def _bucket_column(buckets: int) -> Column:
    # Rows without a doc_id are compared with nothing, so any bucket will do.
    doc = F.coalesce("doc_id", F.monotonically_increasing_id())
    return F.pmod(doc.bitwiseXOR(F.shiftright(doc, 17)), F.lit(buckets)).cast("long")


def _bucket_rows(doc: np.ndarray, position: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Entries in any order to one row for each bucket of documents."""
    bucket = _bucket(doc, buckets)
    order = np.lexsort((position, doc, bucket))
    bucket, doc, position = bucket[order], doc[order], position[order]
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(doc) else bucket
    for a, b in zip(edges, [*edges[1:], len(doc)]):
        fresh = np.concatenate([[True], doc[a + 1 : b] != doc[a : b - 1]])
        begin = np.flatnonzero(fresh)
        yield int(bucket[a]), doc[a:b][begin].astype("<i8").tobytes(), np.diff([*begin, b - a]).astype("<u4").tobytes(), _gaps(position[a:b], fresh)


_HIT_SCHEMA = pa.schema(list(zip(_HIT_NAMES, _HIT_KINDS)))


def _to_buckets(doc: np.ndarray, position: np.ndarray, buckets: int) -> pa.Table:
    return pa.Table.from_batches(_batches(_bucket_rows(doc, position, buckets), _HIT_NAMES, _HIT_KINDS, 4096), _HIT_SCHEMA)


def _known(doc: np.ndarray, position: np.ndarray, buckets: int) -> Iterator[tuple]:
    """What is found before the shuffle, in place of entries; negative parts are buckets."""
    for bucket, docs, counts, gaps in _bucket_rows(doc, position, buckets):
        yield -1 - bucket, docs, counts, gaps, b""


def _if_known(rows: pa.Table) -> pa.Table | None:
    part = rows.column("part")[0].as_py()
    if part >= 0:
        return None
    bucket = pa.array(np.full(len(rows), -1 - part, np.int64))
    return pa.Table.from_arrays([bucket, *(rows.column(c) for c in _HIT_NAMES[1:])], schema=_HIT_SCHEMA)


class _Found:
    """The positions of a bucket's documents, from all parts."""

    def __init__(self, rows: pa.Table):
        doc, position = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for docs, counts, gaps in zip(*(rows.column(k).to_pylist() for k in ("docs", "counts", "gaps"))):
            n = np.frombuffer(counts, "<u4").astype(np.int64)
            doc.append(np.repeat(np.frombuffer(docs, "<i8"), n))
            position.append(_positions(gaps, n))
        doc, position = np.concatenate(doc), np.concatenate(position)
        order = np.argsort(doc, kind="stable")
        self.doc, self.position = doc[order], position[order]

    def marks(self, doc: int | None, n: int) -> np.ndarray | None:
        if doc is None:
            return None
        a, b = np.searchsorted(self.doc, doc), np.searchsorted(self.doc, doc, side="right")
        if a == b:
            return None
        out = np.zeros(n, dtype=bool)
        own = self.position[a:b]
        out[own[own < n]] = True
        return out


def _meetings(rows: pa.Table, n_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents and positions ordered by hash, the start of each hash and its number of entries."""
    doc, position, hashes = _unpack(rows, n_bytes)
    order, edge, n = _by_hash(hashes)
    return doc[order], position[order], edge, n


def _by_hash(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of hashes, and the start and the size of each run of equal ones."""
    order = np.argsort(hashes, kind="stable") if hashes.ndim == 1 else np.lexsort(hashes.T)
    h = hashes[order].reshape(len(order), -1)
    edge = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]).any(axis=1)]))
    return order, edge, np.diff(np.append(edge, len(h)))


def _hits(buckets: int) -> Callable:
    def run(rows: pa.Table) -> pa.Table:
        """Where a block of one document meets a rolling window of another."""
        if (known := _if_known(rows)) is not None:
            return known
        d, p, edge, n = _meetings(rows, PROBE_BYTES)
        indexed = np.maximum.reduceat((p % BLOCK == 0).astype(np.int8), edge)
        several = np.maximum.reduceat(d, edge) != np.minimum.reduceat(d, edge)
        hit = np.repeat((indexed > 0) & several, n)
        return _to_buckets(d[hit], p[hit], buckets)

    return run


def _repeated(buckets: int) -> Callable:
    def run(rows: pa.Table) -> pa.Table:
        """Windows that also start in a document with a smaller doc_id."""
        if (known := _if_known(rows)) is not None:
            return known
        d, p, edge, n = _meetings(rows, WINDOW_BYTES)
        hit = d > np.repeat(np.minimum.reduceat(d, edge), n)
        return _to_buckets(d[hit], p[hit], buckets)

    return run


def _spread(marks: np.ndarray, before: int, after: int) -> np.ndarray:
    """Marks every i from p - before to p + after for a mark p."""
    steps = np.zeros(len(marks) + before + after + 2, np.int64)
    at = np.flatnonzero(marks)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + before + after + 1, -1)
    return np.cumsum(steps)[before : before + len(marks)] > 0


def _candidates(parts: int, buckets: int) -> Callable:
    def packed(held: list[tuple]) -> Iterator[tuple]:
        doc, position, hashes = (np.concatenate(x) for x in zip(*held))
        if len(doc):
            order, edge, n = _by_hash(hashes)
            later = doc[order] > np.repeat(np.minimum.reduceat(doc[order], edge), n)
            travels = np.ones(len(doc), bool)
            travels[order[later]] = False
            yield from _pack(doc[travels], position[travels], hashes[travels], parts, WINDOW_BYTES)
            yield from _known(doc[~travels], position[~travels], buckets)

    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        """The windows that hold a whole hit block, packed by their hashes."""
        found, held = _Found(hits), []
        ids = docs.column("doc_id").to_pylist()
        if len(found.doc):
            for first, end, data, offsets in chunks(docs.column("text")):
                words = split_words(data, offsets)
                hashes, others, counts = words.hashes(), words.hashes(OTHER_BASE), words.counts.tolist()
                for i in range(end - first):
                    marks = found.marks(ids[first + i], counts[i])
                    if marks is not None:
                        start = np.flatnonzero(_spread(marks, WINDOW - BLOCK, 0)[: max(0, counts[i] - WINDOW + 1)])
                        own = [window_hashes(x[words.first[i] : words.first[i + 1]], start, WINDOW) for x in (hashes, others)]
                        held.append((np.full(len(start), ids[first + i]), start, np.stack(own, axis=1)))
        rows = packed(held) if held else iter(())
        return pa.Table.from_batches(_batches(rows, _PACKED_NAMES, _PACKED_KINDS), pa.schema(list(zip(_PACKED_NAMES, _PACKED_KINDS))))

    return run


_SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64())])
_CUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("repeats", pa.list_(_SPAN))])


def _maximal(marks: np.ndarray) -> list[dict]:
    """Runs of consecutive windows as their first and last words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return [{"first": a, "last": min(z + WINDOW - 2, len(marks) - 1)} for a, z in zip(edge[::2].tolist(), edge[1::2].tolist())]


def _cut(docs: pa.Table, repeats: pa.Table) -> pa.Table:
    found, out = _Found(repeats), []
    ids = docs.column("doc_id").combine_chunks()
    keys = ids.to_pylist()
    for first, end, data, offsets in chunks(docs.column("text")):
        words = split_words(data, offsets)
        gone, spans = np.zeros(len(words.starts), dtype=bool), [[]] * (end - first)
        for i in range(end - first):
            a, z = words.first[i], words.first[i + 1]
            marks = found.marks(keys[first + i], z - a)
            if marks is not None:
                gone[a:z], spans[i] = _spread(marks, 0, WINDOW - 1), _maximal(marks)
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[words.first[1:]] - total[words.first[:-1]]
        # Copy the kept words, each with a blank before it, then drop a document's first blank.
        starts, ends = words.starts[~gone], words.ends[~gone]
        size = ends - starts + 1
        stop = np.cumsum(size)
        source = np.arange(int(stop[-1]) if len(stop) else 0) - np.repeat(stop - size, size) + np.repeat(starts - 1, size)
        text = data[np.maximum(source, 0)] if len(source) else data[:0]
        text[stop - size] = 0x20
        text = text.tobytes()
        last = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(words.counts - removed)])].tolist()
        kept = pa.array([text[a + 1 : z].decode() for a, z in zip(last[:-1], last[1:])], pa.string())
        out.append(pa.RecordBatch.from_arrays([ids.slice(first, end - first), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), kept, pa.array(spans, pa.list_(_SPAN))], schema=_CUT))
    return pa.Table.from_batches(out, _CUT)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, repeats) for every row; repeats are the first and last words of maximal runs of what goes."""
    parts = partitions(docs.sparkSession)
    buckets = BUCKETS_PER_PART * parts + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    probes = rows.where("doc_id is not null").mapInArrow(_probes(parts, buckets), PACKED)
    grouped = rows.withColumn("bucket", _bucket_column(buckets)).groupBy("bucket")
    with scratch(docs.sparkSession):
        hits = written(probes.groupBy("part").applyInArrow(_hits(buckets), _HITS), "block-hits")
        windows = grouped.cogroup(hits.groupBy("bucket")).applyInArrow(_candidates(parts, buckets), PACKED)
        repeats = written(windows.groupBy("part").applyInArrow(_repeated(buckets), _HITS), "repeats", kept=True)
    kinds = "doc_id long, n_words long, n_removed long, kept_text string, repeats array<struct<first:long,last:long>>"
    return grouped.cogroup(repeats.groupBy("bucket")).applyInArrow(_cut, kinds)


def digest(docs: DataFrame) -> DataFrame:
    return cut_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
