"""Reading the tables, and writing intermediate tables to shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-framelake-", dir="/tmp")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    Only a local session without ``spark.checkpoint.dir`` (as in tests) gets a
    temporary folder of its own; on a cluster, machines don't share such folders.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that the whole cluster shares")
        base = _own_dir()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: The tables of each open scope, innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were written within, but for kept ones.

    Rows that are still to be read afterwards must not need the others; kept
    tables are left to the scope around this one, if there is any.
    """
    paths: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), paths))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, purpose: str, kept: bool = False, **options: str) -> DataFrame:
    """Writes the rows to shared storage once and reads them back.

    This cuts the lineage without depending on any one executor; the shuffle
    files of the write can go as soon as it is done. A kept table outlives the
    scope it is written in. Options are the writer's.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    scopes = _SCOPES.get()[:-1] if kept else _SCOPES.get()
    if scopes:
        scopes[-1].append(path)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions the cluster was sized for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: A key is hot if at least one in so many rows has it; so there are at most 1000.
HOT_SHARE = 1000


def joined_by_key(rows: DataFrame, facts: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Rows with the facts of their key; ``facts`` has one row for each key, and how many rows have it in ``size``.

    Rows of hot keys stay where they are, as the facts of these keys, at most
    HOT_SHARE, are broadcast; the others are shuffled. Keys aren't null.
    """
    total = facts.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) * HOT_SHARE >= total
    hot = F.broadcast(facts.where(is_hot))
    cold = rows.join(F.broadcast(facts.where(is_hot).select(*keys)), keys, "left_anti").join(facts.where(~is_hot), keys)
    return rows.join(hot, keys).unionByName(cold)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like those asked for that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        new = f"__{name}"
        while new in taken:
            new += "_"
        found.append(new)
    return found
