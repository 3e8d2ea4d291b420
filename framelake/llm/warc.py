"""Deterministic sharded WARC archives.

Records are sorted by URL and page across shards. The bounds between shards are
quantiles of a sample that is chosen by hashes of URL and page, so the same pages
give the same shards, however they are dealt and whenever this runs. A shard is
written as files that are rolled once their compressed size reaches a limit; each
record is a gzip member of its own, and its headers and digests are made anew
from the payload. A file is written under a temporary name and then renamed to
its final one, which depends only on shard and sequence; the manifest, a Parquet
table, is committed last by Spark's own protocol, and only files it names are
part of the archive. A task that runs again after the loss of an executor writes
the same bytes under the same names.

Of records with equal payloads of at least ``revisit_bytes`` bytes, the one with
the largest page_id is a response; the others are revisits that refer to it and
carry no payload. Which ones these are travels to the shards as short rows in
front of their pages, so that each page is shuffled once. Record ids are unique,
also among rows that share a page_id, and a revisit names its response's.

Defined cases: a null payload is empty; a null URL is written as ``urn:null``;
rows that repeat both page_id and payload are responses all; a null page_id is
smaller than any; an empty table gives an archive without files; a payload is
held whole in memory where it is written and read. Other columns, whatever their
names, are not looked at.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import joined_by_key, partitions, shared_dir, written

ROLL_BYTES = 32 << 20
#: Sampled pages for each shard, in the mean, by which the bounds between shards are set.
SAMPLED = 64
#: Names of stores in Spark's and in Arrow's file systems.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}
#: Records carry this date unless another is given, so that reruns agree.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, shard int, sequence int, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _block(fields: list[tuple[str, str]], body: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def _id(page: int | None, url: str | None, payload_digest: str, nth: int) -> str:
    """A record's own id: rows of one page differ by URL, payload or, if they repeat both, by their number."""
    told = hashlib.sha1(f"{'' if url is None else '+' + url}\n{payload_digest}".encode()).hexdigest()[:16]
    return f"<urn:page:{'null' if page is None else page}:{told}:{nth}>"


def _uri(url: str | None) -> str:
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url is not None else "urn:null"


def record(page: int | None, url: str | None, payload: bytes, refers_to: tuple[int, str | None] | None, date: str, nth: int = 0) -> bytes:
    """A response, or a revisit of the first row with this payload, page and URL."""
    told = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _id(page, url, told, nth)), ("WARC-Date", date)]
    fields += [("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{told}"), ("WARC-Block-Digest", f"sha1:{digest(body)}")]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _id(*refers_to, told, 0)), ("WARC-Refers-To-Target-URI", _uri(refers_to[1]))]
    return _block([*fields, ("Content-Type", "application/http; msgtype=response")], body)


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and the folder's path in it."""
    scheme, colon, rest = uri.partition(":")
    return fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest)


class _Shard:
    """Writes the files of one shard."""

    def __init__(self, out: str, shard: int, roll: int, date: str):
        self.files, self.base = _store(out)
        self.shard, self.roll, self.date, self.sequence, self.stream = shard, roll, date, 0, None

    def _open(self) -> None:
        self.name = f"shard-{self.shard:05d}-{self.sequence:05d}.warc.gz"
        self.files.create_dir(f"{self.base}/_temporary", recursive=True)
        self.temporary = f"{self.base}/_temporary/{self.name}.{uuid.uuid4().hex}"
        self.stream, self.size, self.records, self.sha = self.files.open_output_stream(self.temporary), 0, 0, hashlib.sha256()
        info = f"software: framelake\r\nformat: WARC File Format 1.1\r\nisPartOf: shard-{self.shard:05d}\r\n".encode()
        fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{self.name}>"), ("WARC-Date", self.date), ("WARC-Filename", self.name)]
        self._put(_block([*fields, ("Content-Type", "application/warc-fields")], info))

    def _put(self, raw: bytes) -> None:
        member = gzip.compress(raw, 6, mtime=0)
        self.stream.write(member)
        self.sha.update(member)
        self.size += len(member)

    def add(self, raw: bytes) -> Iterator[tuple]:
        if self.stream is None:
            self._open()
        self._put(raw)
        self.records += 1
        if self.size >= self.roll:
            yield self.close()

    def close(self) -> tuple:
        self.stream.close()
        final = f"{self.base}/{self.name}"
        there = self.files.get_file_info(final)
        if there.type == fs.FileType.File and there.size == self.size:
            self.files.delete_file(self.temporary)  # an earlier attempt has left the same bytes
        else:
            self.files.move(self.temporary, final)
        self.stream, self.sequence = None, self.sequence + 1
        return self.name, self.shard, self.sequence - 1, self.records, self.size, self.sha.hexdigest()


def _order(url: str | None, page: int | None) -> tuple:
    """Pages in the order of Spark's sort."""
    return (url is not None, url or "", page is not None, page or 0)


def bounds(keys: DataFrame, shards: int) -> list[tuple]:
    """The first page of every shard but the first, by (url, page_id); as few as there are shards."""
    n = keys.count()
    every = max(1, n // (shards * SAMPLED))
    # Each page is in the sample by its own hash, whatever else is there; repeated rows count once.
    sample = keys.where(F.pmod(F.xxhash64("url", "page_id"), F.lit(every)) == 0).distinct()
    numbered = sample.orderBy("url", "page_id").collect() if n else []
    found = [numbered[i * len(numbered) // shards] for i in range(1, shards)] if numbered else []
    return sorted({_order(r.url, r.page_id) for r in found})


def write(pages: DataFrame, out: str, shards: int | None = None, roll_bytes: int = ROLL_BYTES, revisit_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Writes (page_id, url, html) below ``out``; returns the manifest, which is committed there too."""
    spark, shards = pages.sparkSession, shards or partitions(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html"))
    narrow = written(rows.select("page_id", "url", F.sha1("html").alias("sha"), F.octet_length("html").alias("n")), "warc-digests")
    large = narrow.where(F.col("n") >= revisit_bytes)
    groups = written(large.groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count(F.lit(1)).alias("c")).where("c > 1"), "warc-groups")
    revisits = joined_by_key(large, groups, ["sha"], "c").where("not page_id <=> top.page_id")
    revisits = revisits.select("page_id", "url", F.lit(0).alias("kind"), F.unhex("sha").alias("html"), F.col("top.page_id").alias("refers_to"), F.col("top.url").alias("refers_url")).distinct()
    full = rows.select("page_id", "url", F.lit(1).alias("kind"), "html", F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"))
    starts = bounds(narrow.select("url", "page_id"), shards)

    @F.pandas_udf("int")
    def shard_of(url: pd.Series, page: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(starts, _order(u, None if p is None else int(p))) for u, p in zip(url, page)], dtype="int32")

    # Numbers travel as text, as pandas would make floats of a column with nulls.
    shard = shard_of("url", F.col("page_id").cast("string"))
    dealt = full.union(revisits).withColumn("shard", shard).repartitionById(shards, "shard")
    sorted_rows = dealt.sortWithinPartitions("shard", "url", "page_id", "kind", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines() -> Iterator[tuple]:
            shard, known, before, nth = None, {}, None, 0
            for b in batches:
                for i in range(b.num_rows):
                    number, page, url, kind, html, *refers = (c[i].as_py() for c in b.columns)
                    if shard is None or shard.shard != number:
                        if shard is not None and shard.stream is not None:
                            yield shard.close()
                        shard = _Shard(out, number, roll_bytes, date)
                    key = (url, page)
                    if kind == 0:
                        known = known if known.get("key") == key else {"key": key}
                        known[html] = tuple(refers)
                    else:
                        sha = hashlib.sha1(html).digest()
                        nth, before = nth + 1 if before == (*key, sha) else 0, (*key, sha)
                        to = known.get(sha) if known.get("key") == key else None
                        yield from shard.add(record(page, url, html, to, date, nth))
            if shard is not None and shard.stream is not None:
                yield shard.close()

        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        names = ["file", "shard", "sequence", "records", "bytes", "sha256"]
        for line in lines():
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(line, kinds)], names)

    manifest = sorted_rows.select("shard", "page_id", "url", "kind", "html", "refers_to", "refers_url").mapInArrow(run, MANIFEST)
    manifest.write.parquet(f"{out}/_manifest")
    return spark.read.parquet(f"{out}/_manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should start")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        n = int(fields["content-length"])
        body = stream.read(n)
        if len(body) != n:
            raise ValueError("the archive is cut")
        yield fields, body


def _page(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+):[0-9a-f]{16}:\d+>", uri or "")
    return int(found[1]) if found else None


def _parsed(fields: dict[str, str], body: bytes) -> tuple:
    head, _, payload = body.partition(b"\r\n\r\n")
    stated = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields.get("warc-block-digest", "").removeprefix("sha1:") != digest(body):
        raise ValueError("a block's digest is wrong")
    n = int(re.search(rb"(?i)^content-length: *(\d+)", head, re.M)[1])
    if fields["warc-type"] == "response" and (len(payload) != n or digest(payload) != stated):
        raise ValueError("a payload's digest is wrong")
    refers = _page(fields.get("warc-refers-to"))
    return _page(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], n, stated, refers, payload


def read(spark: SparkSession, out: str) -> DataFrame:
    """The response and revisit records of an archive's committed files; checks sizes and digests."""
    manifest = spark.read.parquet(f"{out}/_manifest")
    files = manifest.select("file", "bytes").repartition(partitions(spark), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(out)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        for b in batches:
            for name, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if store.get_file_info(f"{base}/{name}").size != size:
                    raise ValueError(f"{name} isn't as the manifest says")
                with store.open_input_stream(f"{base}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    held, held_bytes = [], 0
                    for fields, body in records(stream):
                        if fields["warc-type"] == "warcinfo":
                            continue
                        held.append(_parsed(fields, body))
                        held_bytes += len(body)
                        if held_bytes >= 4 << 20 or len(held) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                            held, held_bytes = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    return files.mapInArrow(run, RECORD)


def archive(pages: DataFrame) -> DataFrame:
    """Writes the pages to a new archive in shared storage and reads it back."""
    out = shared_dir(pages.sparkSession, "warc")
    write(pages, out)
    return read(pages.sparkSession, out)
