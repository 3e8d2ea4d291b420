from __future__ import annotations

import hashlib
import struct
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

from framelake.llm import flac
from framelake.llm.common import shared_dir


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))


def encoded(payloads: list[bytes]) -> list[bytes]:
    return flac.encode_batch(np.frombuffer(b"".join(payloads), np.uint8), np.cumsum([0, *map(len, payloads)]))


def back(media: bytes) -> bytes:
    return (flac.decode_batch([media])[0][0] + 128).astype(np.uint8).tobytes()


def cases() -> list[bytes]:
    rng = np.random.default_rng(5)
    noise = rng.integers(0, 256, 1152 * 3 + 192, dtype=np.uint8).tobytes()
    return [payload(None), payload("abc"), payload("é" * 4000), b"x" * 1152, bytes(range(256)) * 9, noise, bytes([0, 255]) * 576]


def test_round_trip_and_seek_offsets():
    for raw, media in zip(cases(), encoded(cases())):
        (samples, blocks), = flac.decode_batch([media])
        assert (samples + 128).astype(np.uint8).tobytes() == raw
        assert sum(n for _, n, _ in blocks) == len(raw)
        assert [f for f, _, _ in blocks] == list(range(0, len(raw), flac.BLOCK))
        assert all(media[at : at + 2] == b"\xff\xf8" for _, _, at in blocks)


def test_streams_without_seek_table_decode_frame_by_frame():
    raw = payload("some words " * 700)
    media = encoded([raw])[0]
    n = int.from_bytes(media[43:46], "big")
    bare = bytearray(media[:42] + media[46 + n :])
    bare[4] |= 0x80
    assert back(bytes(bare)) == raw


def test_chunks_within_a_stream_give_the_same_bytes(monkeypatch):
    raws = [payload("some words of a long text " * 9000), *cases(), payload("a" * 300_000)]
    whole = encoded(raws)
    monkeypatch.setattr(flac, "CHUNK_BYTES", 7000)
    assert encoded(raws) == whole
    for raw, (samples, blocks), media in zip(raws, flac.decode_batch(whole), whole, strict=True):
        assert (samples + 128).astype(np.uint8).tobytes() == raw
        assert blocks == [(i, min(flac.BLOCK, len(raw) - i), at) for (_, _, at), i in zip(blocks, range(0, len(raw), flac.BLOCK), strict=True)]
        x = samples.astype(np.int64)
        steps = np.diff(x)
        turns = int(((steps[1:] < 0) != (steps[:-1] < 0)).sum())
        assert flac.features(samples) == (int(np.abs(x).max(initial=0)), turns, int((x * x).sum()))


LONG = """
import hashlib, resource, sys
import numpy as np
from framelake.llm import flac
n = 64 << 20
rng = np.random.default_rng(1)
data = np.resize(rng.integers(97, 123, 1 << 20, dtype=np.uint8), n)
media = flac.encode_batch(data, np.array([0, n]))
digest = hashlib.sha256(data).digest()
del data
(samples, blocks), = flac.decode_batch(media)
flac.features(samples)
assert hashlib.sha256((samples.astype(np.uint8) + np.uint8(128))).digest() == digest and len(blocks) == -(-n // flac.BLOCK)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
"""


def test_a_text_of_64_mb_takes_less_than_1_gb():
    done = subprocess.run([sys.executable, "-c", LONG], capture_output=True, text=True, timeout=600, check=True)
    assert int(done.stdout) < 1024


def test_checksums():
    media = encoded([payload("some words " * 700)])[0]
    for at in (50, len(media) - 1, len(media) // 2):
        bad = bytearray(media)
        bad[-1 if at == len(media) - 1 else at] ^= 4
        if at > flac._metadata(media)[4]:
            with pytest.raises(ValueError):
                flac.decode_batch([bytes(bad)])
    with pytest.raises(ValueError):
        flac.decode_batch([media[:-40]])


def predictors(media: bytes) -> set[tuple[int, int]]:
    """(order, bits of a coefficient) of the frames of a stream; (0, 0) for those without prediction."""
    _, _, _, points, at = flac._metadata(media)
    found = set()
    for p in points:
        frame = media[at + p :]
        head = 6 + 2 * (frame[2] >> 4 == 7)  # frames numbered below 128
        order = (frame[head] >> 1 & 31) + 1 if frame[head] >= 0x40 else 0
        found.add((order, (frame[head + 1 + order] >> 4) + 1 if order else 0))
    return found


def test_streams_of_repeated_words_pack_well():
    rng = np.random.default_rng(3)
    words = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(2, 11, 400)]
    texts = [payload(" ".join(words[int(i)] for i in np.minimum(rng.zipf(1.3, 400) - 1, 399))) for _ in range(200)]
    media = encoded(texts)
    assert [back(m) for m in media] == texts
    size = sum(map(len, texts))
    packed = pa.Codec("zstd", compression_level=9).compress(b"".join(media)).size
    assert sum(map(len, media)) < 0.93 * size
    assert packed < 0.5 * size
    assert all(order for m in media for order, _ in predictors(m))


def test_frames_take_the_fine_predictor_where_it_pays():
    t = np.arange(1152 * 4)
    smooth = np.rint(128 + 60 * np.sin(t / 9) + 50 * np.sin(t / 23)).astype(np.uint8).tobytes()
    (media,) = encoded([smooth])
    assert back(media) == smooth
    assert predictors(media) == {(flac.ORDER, flac.PRECISION)}


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value: int, n: int):
        self.bits += format(value & ((1 << n) - 1), f"0{n}b") if n else ""

    def rice(self, value: int, k: int):
        z = 2 * value if value >= 0 else -2 * value - 1
        self.bits += "0" * (z >> k) + "1"
        self.put(z, k)

    def bytes(self) -> bytes:
        s = self.bits + "0" * (-len(self.bits) % 8)
        return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8))


def crc(data: bytes, poly: int, width: int) -> int:
    c = 0
    for b in data:
        c ^= b << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> (width - 1) & 1 else c << 1) & ((1 << width) - 1)
    return c


def stream(samples: list[int], subframe) -> bytes:
    """One frame written bit by bit, as a check that shares no code with the encoder."""
    w = Writer()
    for value, n in ((0x3FFE, 14), (0, 2), (7, 4), (4, 4), (0, 4), (1, 3), (0, 1), (0, 8), (len(samples) - 1, 16)):
        w.put(value, n)
    w.put(crc(w.bytes(), 7, 8), 8)
    subframe(w, samples)
    frame = w.bytes()
    frame += struct.pack(">H", crc(frame, 0x8005, 16))
    md5 = hashlib.md5(np.array(samples, np.int8).tobytes()).digest()
    info = struct.pack(">HH", len(samples), len(samples)) + bytes(6) + (8000 << 44 | 7 << 36 | len(samples)).to_bytes(8, "big") + md5
    return b"fLaC\x80\x00\x00\x22" + info + frame


def fixed_with_partitions(w: Writer, x: list[int]):
    w.put(0, 1), w.put(8 + 2, 6), w.put(0, 1)
    w.put(x[0], 8), w.put(x[1], 8)
    res = [x[i] - 2 * x[i - 1] + x[i - 2] for i in range(2, len(x))]
    w.put(0, 2), w.put(2, 4)
    n = len(x) // 4
    for p in range(4):
        part = res[max(p * n - 2, 0) : (p + 1) * n - 2]
        if p == 2:  # an escape code: raw samples
            w.put(15, 4), w.put(10, 5)
            for r in part:
                w.put(r, 10)
        else:
            w.put(p, 4)
            for r in part:
                w.rice(r, p)


def wasted_verbatim(w: Writer, x: list[int]):
    w.put(0, 1), w.put(1, 6), w.put(1, 1), w.put(1, 2)
    for v in x:
        w.put(v >> 2, 6)


def test_subframes_that_the_encoder_never_writes():
    x = [int(30 * np.sin(i / 3)) + i % 5 for i in range(64)]
    assert flac.decode_batch([stream(x, fixed_with_partitions)])[0][0].tolist() == x
    y = [4 * (i % 11) - 16 for i in range(40)]
    assert flac.decode_batch([stream(y, wasted_verbatim)])[0][0].tolist() == y


def test_query(spark):
    rows = [(1, "abc", 5, None), (2, None, 6, "x"), (2, None, 6, "x"), (None, "é" * 5000, 7, None), (3, "abc", 8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media int, pcm string")
    got = {}
    for r in flac.digest(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[2]) == 2 and got[2][0] == got[2][1]
    for key, text in ((1, "abc"), (2, None), (None, "é" * 5000), (3, "abc")):
        r, p = got[key][0], payload(text)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len((text or "").encode()), len(p), hashlib.sha256(p).hexdigest())
        assert r.tail_crc32 == zlib.crc32(p[-16:])
    assert got[1][0].media_sha256 == got[3][0].media_sha256 and got[1][0].feature == got[3][0].feature
    assert flac.digest(docs.limit(0)).count() == 0
    blocks = flac.pcm_blocks(flac.decode(flac.encode(docs.select("doc_id", flac.padded(docs.text).alias("p")), "p")))
    whole = blocks.where("doc_id is null").orderBy("block").collect()
    assert b"".join(bytes(b.pcm) for b in whole) == payload("é" * 5000)


def test_frame_numbers_of_all_lengths():
    for n, want in {0: b"\x00", 127: b"\x7f", 128: b"\xc2\x80", 2047: b"\xdf\xbf", 2048: b"\xe0\xa0\x80", 65535: b"\xef\xbf\xbf", 65536: b"\xf0\x90\x80\x80", 70_000: b"\xf0\x91\x85\xb0", (1 << 21) - 1: b"\xf7\xbf\xbf\xbf", 1 << 21: b"\xf8\x88\x80\x80\x80", 1 << 26: b"\xfc\x84\x80\x80\x80\x80", (1 << 31) - 1: b"\xfd\xbf\xbf\xbf\xbf\xbf"}.items():
        columns = flac._utf8_number(np.array([n]))
        assert bytes(int(v[0]) for v, bits in columns if bits[0]) == want, n
    with pytest.raises(ValueError):
        flac._utf8_number(np.array([1 << 31]))


def test_frames_beyond_65535_are_read_back():
    """A frame with a number of four bytes, decoded with its header's checksum."""
    x = np.arange(192, dtype=np.int64).reshape(1, -1) % 50
    for number in (65_535, 65_536, 70_000, 1 << 21, (1 << 31) - 1):
        values, bits = flac._frames(x, np.array([number]))
        ends = np.cumsum(bits, axis=1)
        n = int(-(-ends[0, -1] // 8))
        used = bits > 0
        packed = flac._packed(values[used], ends[used], n)
        crc = int(flac.crc16(packed, np.array([0]), np.array([n]))[0])
        raw = np.concatenate([packed, np.array([crc >> 8, crc & 255], np.uint8)])
        samples, numbers, _ = flac._decode_frames(flac._Bits(raw), np.array([0]), np.array([8]))
        assert numbers[0] == number and (samples[0] == x[0]).all()


def test_pcm_blocks_are_written_and_sought(spark):
    payload = bytes(i * 7 % 251 for i in range(5000))
    docs = spark.createDataFrame([(1, payload), (2, b"x" * 192), (3, None)], "doc_id long, payload binary")
    path = shared_dir(spark, "pcm-blocks")
    flac.write_pcm_blocks(flac.decode(flac.encode(docs, "payload")), path)
    rows = spark.read.parquet(path)
    assert rows.count() == 6
    own = sorted(rows.where("doc_id = 1").collect(), key=lambda r: r.block)
    assert b"".join(bytes(r.pcm) for r in own) == payload
    found = rows.where("doc_id = 1 and first_sample <= 3000 and 3000 < first_sample + n_samples").first()
    assert found.block == 2 and bytes(found.pcm)[3000 - found.first_sample] == payload[3000]
