"""Writing objects by key with a commit: a Spark data source for JSON documents and images.

    rows.write.format("artifacts").option("root", root).option("name", "job-7").mode("append").save()

Rows are (key string, content binary or string). A task stages its objects below
``<root>/_staged/<write>`` and moves them to their keys only when it has all of
them, after it has listed them in a part of the manifest; so a task that fails
half-way leaves none, and one that runs again writes the same keys again. The job's
commit checks that no two tasks wrote one key's object differently, writes
``<root>/_manifests/<name>.json``, which names the parts, and drops the staging
folder; its abort deletes the objects of tasks that were done, but for those that an
earlier write had put there. What goes through the driver is one message a task.

Objects count once they are in a committed manifest: ``committed`` lists these.
A write of a name that was committed before is refused.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

LISTED = "key string, bytes long, sha256 string, replaced boolean"


@dataclass
class Done(WriterCommitMessage):
    """A task's part of the manifest."""

    part: str
    objects: int
    bytes: int


class ObjectWriter(DataSourceWriter):
    def __init__(self, root: str, name: str):
        if not root or not name or "/" in name:
            raise ValueError("a write needs a root, and a name without slashes")
        self.root, self.name, self.write_id = root, name, uuid.uuid4().hex

    def _store(self):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.root)
        return store, base, f"{base}/_staged/{self.write_id}"

    @staticmethod
    def _put(store, path: str, content: bytes) -> None:
        store.create_dir(path.rpartition("/")[0], recursive=True)
        with store.open_output_stream(path) as out:
            out.write(content)

    @staticmethod
    def _exists(store, path: str) -> bool:
        from pyarrow import fs

        return store.get_file_info(path).type == fs.FileType.File

    def write(self, iterator: Iterator) -> Done:
        store, base, staged = self._store()
        part = f"{staged}/{uuid.uuid4().hex}"
        found: dict[str, dict] = {}
        try:
            for row in iterator:
                key, content = row[0], row[1]
                if not key or key.startswith(("/", "_")) or ".." in key.split("/"):
                    raise ValueError(f"no key for an object: {key!r}")
                if content is None:
                    raise ValueError(f"no content for {key}")
                content = content.encode() if isinstance(content, str) else bytes(content)
                digest = hashlib.sha256(content).hexdigest()
                if key in found and found[key]["sha256"] != digest:
                    raise ValueError(f"two contents for {key}")
                found[key] = {"key": key, "bytes": len(content), "sha256": digest, "replaced": self._exists(store, f"{base}/{key}")}
                self._put(store, f"{part}/{key}", content)
        except BaseException:
            if found:
                store.delete_dir(part)
            raise
        # Listed before any object is moved, so that an abort knows of all.
        listed = f"{base}/_manifests/{self.name}.parts/{uuid.uuid4().hex}.json"
        self._put(store, listed, "".join(json.dumps(x) + "\n" for x in found.values()).encode())
        for key in found:
            store.create_dir(f"{base}/{key}".rpartition("/")[0], recursive=True)
            store.move(f"{part}/{key}", f"{base}/{key}")
        return Done(listed[len(base) + 1 :], len(found), sum(x["bytes"] for x in found.values()))

    def commit(self, messages: list[Done | None]) -> None:
        store, base, staged = self._store()
        done = [m for m in messages if m is not None]
        facts = {"name": self.name, "objects": sum(m.objects for m in done), "bytes": sum(m.bytes for m in done), "parts": [m.part for m in done]}
        self._put(store, f"{base}/_manifests/{self.name}.json", json.dumps(facts).encode())
        self._drop(store, staged)

    def abort(self, messages: list[Done | None]) -> None:
        store, base, staged = self._store()
        for m in messages:
            if m is None:
                continue
            with store.open_input_stream(f"{base}/{m.part}") as f:
                listed = [json.loads(x) for x in f.read().splitlines()]
            for x in listed:
                if not x["replaced"] and self._exists(store, f"{base}/{x['key']}"):
                    store.delete_file(f"{base}/{x['key']}")
            store.delete_file(f"{base}/{m.part}")
        self._drop(store, staged)

    @staticmethod
    def _drop(store, path: str) -> None:
        from pyarrow import fs

        if store.get_file_info(path).type == fs.FileType.Directory:
            store.delete_dir(path)


class ObjectSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def schema(self) -> str:
        return "key string, content binary"

    def writer(self, schema, overwrite: bool) -> ObjectWriter:
        return ObjectWriter(self.options.get("root", ""), self.options.get("name", ""))


def write_objects(rows: DataFrame, root: str, name: str) -> None:
    """Writes (key, content) as one commit; rows that share a key must be equal, and are written once.

    A write whose name was committed before does nothing, so a job may run again.
    """
    spark = rows.sparkSession
    spark.dataSource.register(ObjectSink)
    if committed(spark, root, name) is not None:
        return
    # Rows of a key meet in one task, which compares them.
    dealt = rows.select("key", F.col("content").cast("binary").alias("content")).repartition("key")
    dealt.write.format("artifacts").option("root", root).option("name", name).mode("append").save()


def committed(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """(key, bytes, sha256, replaced) of a committed write, or None."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root)
    at = f"{base}/_manifests/{name}.json"
    if store.get_file_info(at).type != fs.FileType.File:
        return None
    with store.open_input_stream(at) as f:
        parts = json.loads(f.read())["parts"]
    if not parts:
        return spark.createDataFrame([], LISTED)
    return spark.read.schema(LISTED).json([f"{root.rstrip('/')}/{p}" for p in parts])
