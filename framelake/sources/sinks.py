"""Writing artifacts: JSON by job, images, and the list of what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions import ids

#: The folders of artifact kinds.
FOLDERS = {"frame": "analysis/json", "packet": "scene/packets", "narrative": "scene/narratives", "synopsis": "summary", "graph": "corpus/graph", "retrieval": "corpus/rag", "embeddings": "corpus/embeddings"}


def write_json(rows: DataFrame, root: str, kind: str) -> str:
    """One folder for each job; Spark's commit protocol leaves no half-written files after a failure.

    Only the jobs at hand are replaced.
    """
    path = f"{root}/{FOLDERS[kind]}"
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy("job_id").json(path)
    return path


def write_table(rows: DataFrame, path: str, buckets: int = 0, table: str | None = None) -> None:
    """Flat tables as Parquet by job; with buckets, as a table whose joins on job_id need no shuffle."""
    if buckets and table:
        rows.write.mode("overwrite").bucketBy(buckets, "job_id").sortBy("job_id").option("path", path).saveAsTable(table)
    else:
        rows.write.mode("overwrite").parquet(path)


def write_checked(rows: DataFrame, bad: DataFrame, root: str, kind: str) -> str:
    """Writes only if there are no violations; else raises with a few of them."""
    if sample := bad.limit(5).collect():
        raise ValueError(f"not written: {[tuple(r) for r in sample]}")
    return write_json(rows, root, kind)


def bundles(rows: DataFrame, kind: str) -> DataFrame:
    """(job_id, key, content) of corpus bundles given as (job_id, bundle, filename); the bundle is any struct or map."""
    key = ids.corpus_key(F.col("job_id"), kind, F.col("filename"))
    return rows.select("job_id", key.alias("key"), F.to_json("bundle", {"ignoreNullFields": "false"}).cast("binary").alias("content"))


def write_bundles(rows: DataFrame, kind: str, root: str | None = None) -> DataFrame:
    """The keys of bundles, which are written below the root; without a root there are the keys only."""
    made = bundles(rows, kind)
    return made.select("key") if root is None else write_images(made, root)


def write_images(rows: DataFrame, root: str) -> DataFrame:
    """(key, content) to one object each; returns the keys written. Any store that Arrow knows will do."""

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for b in batches:
            for key, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                final = f"{base}/{key}"
                store.create_dir(final.rpartition("/")[0], recursive=True)
                temporary = f"{final}.{uuid.uuid4().hex}"
                with store.open_output_stream(temporary) as out:
                    out.write(content)
                store.move(temporary, final)
            yield pa.RecordBatch.from_arrays([b.column(0)], ["key"])

    return rows.select("key", "content").where(F.col("content").isNotNull()).mapInArrow(run, "key string")
