"""Stored objects by key, over any file system that Arrow knows."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class ArtifactStore:
    """Objects below a root such as ``s3://bucket/prefix`` or ``file:///folder``."""

    root: str
    read_url: str = "https://objects.example/"
    url_ttl: int = 3600

    def __post_init__(self):
        if not self.root.strip() or not self.read_url.strip():
            raise ValueError("a store needs a root and a URL to read from")
        if self.url_ttl <= 0:
            raise ValueError("the time to live of a URL must be positive")

    def _at(self, key: str) -> tuple[fs.FileSystem, str]:
        store, base = fs.FileSystem.from_uri(self.root)
        return store, f"{base}/{key}"

    def put(self, key: str, content: bytes) -> None:
        store, path = self._at(key)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        with store.open_output_stream(path) as out:
            out.write(content)

    def get(self, key: str) -> bytes:
        store, path = self._at(key)
        with store.open_input_stream(path) as f:
            return f.read()

    def exists(self, key: str) -> bool:
        """False if the store can't tell, too."""
        try:
            store, path = self._at(key)
            return store.get_file_info(path).type == fs.FileType.File
        except OSError:
            return False

    def delete(self, key: str) -> None:
        store, path = self._at(key)
        store.delete_file(path)

    def sign(self, key: str) -> str:
        return f"{self.read_url}{quote(key)}?exp={self.url_ttl}"

    def keys(self, spark: SparkSession) -> DataFrame:
        """(key, length): a distributed listing, to join against."""
        from pyspark.sql import functions as F

        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.root).select("path", "length")
        return files.select(F.regexp_extract("path", r"(jobs/.*)$", 1).alias("key"), "length")

    def delete_listed(self, rows: DataFrame) -> DataFrame:
        """Deletes the objects of a ``key`` column where the rows are; returns what was deleted."""
        store = self

        def run(batches):
            import pyarrow as pa

            for b in batches:
                gone = [k for k in b.column(0).to_pylist() if k and store.exists(k)]
                for k in gone:
                    store.delete(k)
                yield pa.RecordBatch.from_arrays([pa.array(gone, pa.string())], ["key"])

        return rows.select("key").mapInArrow(run, "key string")
