from __future__ import annotations

import gzip
from urllib.request import url2pathname

from pyarrow import fs
from pyspark.sql import functions as F

from framelake.llm import warc
from framelake.llm.common import shared_dir

ROWS = [
    (1, "http://a/1", "same", 7),
    (2, "http://b/ü x\ny", "same", 7),
    (9, "http://a/1", "same", 7),
    (3, None, None, 7),
    (4, "http://c", "", 7),
    (5, "http://d", "é" * 3000, 7),
    (5, "http://d", "é" * 3000, 7),
    (6, "http://d", "HTTP\r\n\r\nWARC/1.1\r\n", 7),
    (None, "http://e", "same", 7),
]


def expected(rows):
    by = {}
    for page, _, html, _ in rows:
        by.setdefault((html or "").encode(), []).append(page)
    out = []
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        top = max((p for p in by[raw] if p is not None), default=None)
        out.append((page, len(raw), warc.digest(raw), "response" if page == top else "revisit", None if page == top else top))
    return sorted(map(repr, out))


def shown(df):
    return sorted(repr(tuple(r)) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, refers_to int")
    assert shown(warc.archive(pages)) == expected(ROWS)
    assert warc.archive(pages.limit(0)).count() == 0


def test_files_are_sorted_rolled_and_reproducible(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    manifests = []
    for _ in range(2):
        out = shared_dir(spark, "warc-test")
        manifests.append(sorted(map(tuple, warc.write(pages, out, shards=3, roll_bytes=10_000).collect())))
    assert manifests[0] == manifests[1]
    assert len(manifests[0]) > 3
    store, base = fs.FileSystem.from_uri(out)
    urls = []
    for name, *_ in manifests[0]:
        with gzip.open(url2pathname(f"{base}/{name}")) as stream:
            found = list(warc.records(stream))
        assert found[0][0]["warc-type"] == "warcinfo"
        urls += [f["warc-target-uri"] for f, _ in found[1:]]
    assert len(urls) == pages.count()
    back = {r.page_id: bytes(r.payload).decode() for r in warc.read(spark, out).collect() if r.record_type == "response"}
    want = {r.page_id: r.html for r in pages.collect()}
    assert all(want[k] == v for k, v in back.items())


def test_the_same_pages_give_the_same_files(spark):
    pages = spark.range(12_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.xxhash64("id") % 50, F.lit("/"), F.col("id") % 700).alias("url"), F.repeat(F.concat(F.lit("text "), (F.col("id") % 9000).cast("string")), 3).alias("html"))
    manifests = []
    for dealt in (pages, pages, pages.repartition(13), pages.repartition(5, "url")):
        spark.range(100).groupBy((F.col("id") % 3).alias("k")).count().orderBy("k").collect()
        manifests.append(sorted(map(tuple, warc.write(dealt, shared_dir(spark, "warc-test"), shards=4, roll_bytes=100_000).collect())))
    assert all(m == manifests[0] for m in manifests)
    assert len({m[1] for m in manifests[0]}) == 4 and max(m[2] for m in manifests[0]) > 0
    records = [sum(m[3] for m in manifests[0] if m[1] == k) for k in range(4)]
    assert sum(records) == 12_000 and max(records) < 1.5 * min(records)


def test_short_payloads_are_never_revisits(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, refers_to int")
    out = shared_dir(spark, "warc-test")
    warc.write(pages, out, revisit_bytes=5)
    got = warc.read(spark, out).collect()
    assert len(got) == len(ROWS)
    assert all(r.record_type == "response" for r in got if r.payload_bytes < 5 or r.page_id in (4, 5, 6))
    out = shared_dir(spark, "warc-test")
    warc.write(pages, out, revisit_bytes=4)
    assert {r.page_id for r in warc.read(spark, out).collect() if r.record_type == "revisit"} == {1, 2, None}


def test_extreme_keys(spark):
    top = (1 << 63) - 1
    pages = spark.createDataFrame([(top, None, "a", "s"), (top - 1, "", "b", "s"), (None, None, None, "s"), (-top, "\U0001f600", "c" * 300_000, "s")], "page_id long, url string, html string, shard string")
    out = shared_dir(spark, "warc-test")
    warc.write(pages, out, shards=3)
    assert {(r.page_id, r.payload_bytes) for r in warc.read(spark, out).collect()} == {(top, 1), (top - 1, 1), (None, 0), (-top, 300_000)}


def test_record_ids_are_unique_and_revisits_name_their_response(spark):
    repeated = [(7, "http://x/1", "twice", 0), (7, "http://x/2", "twice", 0), (7, "http://x/1", "twice", 0), (7, "http://x/1", "other", 0), (6, "http://x/1", "twice", 0), (8, None, "last", 0), (None, "http://x/1", "twice", 0), (None, None, "last", 0), (None, "", "last", 0), (None, None, None, 0), (None, None, None, 0)]
    pages = spark.createDataFrame(ROWS + repeated, "page_id long, url string, html string, refers_to int").repartition(5)
    out = shared_dir(spark, "warc-test")
    manifest = warc.write(pages, out, shards=3).collect()
    store, base = fs.FileSystem.from_uri(out)
    found = []
    for m in manifest:
        with gzip.open(url2pathname(f"{base}/{m.file}")) as stream:
            found += [f for f, _ in warc.records(stream)]
    assert len({f["warc-record-id"] for f in found}) == len(found) == len(ROWS + repeated) + len(manifest)
    responses = {f["warc-record-id"]: f for f in found if f["warc-type"] == "response"}
    revisits = [f for f in found if f["warc-type"] == "revisit"]
    assert len(revisits) >= 6
    for f in revisits:
        to = responses[f["warc-refers-to"]]
        assert to["warc-payload-digest"] == f["warc-payload-digest"] and to["warc-target-uri"] == f["warc-refers-to-target-uri"]
