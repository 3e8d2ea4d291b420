"""Exact deduplication against a persistent digest index.

The index is a Parquet table in the shared folder, bucketed and sorted by digest,
with one row per distinct text: the digest, the document that stays, the number
of rows that had this text when it entered and the batch that brought it. A
batch's digests are checked by a sort-merge anti-join, for which the index is
never shuffled, and those not seen before are appended. DataFrame operations only.

A batch has a name. If it comes again, as after a failure at any point, only what
is missing of it is appended, and its own rows in the index don't count as
earlier ones; so it gets the verdicts that it would have got. A batch that comes
again must have the same rows, and an index has one writer at a time.

Defined cases: a null text counts as empty, and so equals an empty one. Of equal
texts within one batch the row with the largest doc_id stays (null is smaller
than any); a text that an earlier batch brought is dropped in favour of the
document of that batch. Repeated rows (same doc_id, same text) are members of
the group and share its verdict. An empty batch leaves the index as it is. Long
texts are hashed where they lie. Other columns, whatever their names, are not
looked at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import fresh_names, joined_by_key, partitions, shared_dir, written

COLUMNS = "digest binary, keep_id bigint, group_size bigint, batch string"


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the whole text in UTF-8, as 32 bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))


class DigestIndex:
    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        if not spark.catalog.tableExists(self.name):
            # The session's warehouse may be a folder of the driver's machine only.
            self._create(spark, self.name, buckets or partitions(spark), f"location '{shared_dir(spark, 'digest-index')}'")
        facts = spark.sql(f"describe extended {self.name}").where("col_name = 'Num Buckets'").first()
        self.buckets = int(facts["data_type"])

    @staticmethod
    def _create(spark: SparkSession, name: str, buckets: int, location: str = "") -> None:
        spark.sql(f"create table if not exists {name} ({COLUMNS}) using parquet clustered by (digest) sorted by (digest) into {int(buckets)} buckets {location}")

    @classmethod
    def attach(cls, spark: SparkSession, name: str, location: str, buckets: int) -> DigestIndex:
        """An index whose files an earlier session with another catalog left at ``location``."""
        cls._create(spark, name, buckets, f"location '{location}'")
        return cls(spark, name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Deletes the table and its files."""
        place = self.spark.sql(f"describe extended {self.name}").where("col_name = 'Location'").first()["data_type"]
        self.spark.sql(f"drop table if exists {self.name}")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest isn't in the index."""
        return groups.hint("merge").join(self.read().select("digest"), "digest", "left_anti")

    def add(self, rows: DataFrame, batch: str) -> DataFrame:
        """Appends the digests of rows (doc_id, digest) that aren't there yet.

        Returns (digest, keep_id, before, own, top_copies, earlier) for each
        digest of the batch: the document that stays, the rows that the index
        counted before and those of the batch, how often the batch has its last
        document, and whether the digest is an earlier batch's.
        """
        by_row = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))
        groups = by_row.groupBy("digest").agg(F.max("doc_id").alias("top"), F.sum("n").alias("own"), F.max_by("n", F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("top_copies"))
        groups = written(groups, "digest-groups")
        fresh = written(self.unseen(groups).select("digest", F.col("top").alias("keep_id"), F.col("own").alias("group_size"), F.lit(batch).alias("batch")), "digest-fresh")
        # Dealt like the buckets, so a batch adds one file to each.
        fresh = fresh.repartition(self.buckets, "digest")
        fresh.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        earlier = F.col("batch") != batch
        found = groups.hint("merge").join(self.read(), "digest")
        before = F.when(earlier, F.col("group_size")).otherwise(F.lit(0).cast("long")).alias("before")
        return written(found.select("digest", "keep_id", before, "own", "top_copies", earlier.alias("earlier")), "digest-verdicts")

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Adds a batch; returns (doc_id, digest, keep_id, group_size, kept) for each of its rows.

        ``group_size`` counts the rows of the batch that brought the text.
        """
        rows = written(digests(docs, id_col, text_col), "digests")
        verdicts = self.add(rows, batch or uuid.uuid4().hex)
        kept = ~F.col("earlier") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
        size = F.when(F.col("earlier"), F.col("before")).otherwise(F.col("own"))
        return joined_by_key(rows, verdicts, ["digest"], "own").select("doc_id", "digest", "keep_id", size.alias("group_size"), kept.alias("kept"))


def _ingested(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, digest), and (digest, keep_id, own, top_copies) over a whole table that enters a new index in two batches.

    The rows with the larger doc_ids come first, so a text's first document is the one that stays.
    """
    spark = docs.sparkSession
    rows = written(digests(docs), "digests")
    middle = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    upper = F.coalesce(F.col("doc_id") >= F.lit(middle), F.lit(False))
    index = DigestIndex(spark)
    try:
        first, second = (index.add(part, name) for part, name in ((rows.where(upper), "upper"), (rows.where(~upper), "lower")))
    finally:
        index.drop()
    both = first.unionByName(second).groupBy("digest")
    # Of the second batch's rows none with an earlier text is the one that stays.
    copies = F.max(F.when(~F.col("earlier"), F.col("top_copies"))).alias("top_copies")
    return rows, written(both.agg(F.max("keep_id").alias("keep_id"), F.sum("own").alias("own"), copies), "digest-all")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document, dropped ones too, with the hex digest of its text."""
    rows, verdicts = _ingested(docs)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    out = joined_by_key(rows, verdicts, ["digest"], "own")
    return out.select("doc_id", "keep_id", F.col("own").alias("group_size"), kept, F.lower(F.hex("digest")).alias("text_sha256"))


def keep_distinct(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns; of those that share doc_id and text the first by their other columns as JSON."""
    _, verdicts = _ingested(docs)
    digest, keep_id, own, copies = fresh_names(docs, "digest", "keep_id", "own", "copies")
    verdicts = verdicts.withColumnsRenamed({"digest": digest, "keep_id": keep_id, "own": own, "top_copies": copies})
    marked = docs.withColumn(digest, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    stays = joined_by_key(marked, verdicts, [digest], own).where(F.col("doc_id").eqNullSafe(F.col(keep_id)))
    if verdicts.where(F.col(copies) > 1).isEmpty():
        return stays.select(*docs.columns)
    once = stays.where(F.col(copies) == 1)
    rest = [c for c in docs.columns if c.lower() != "text"]
    first = F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*rest))).alias(keep_id)
    again = stays.where(F.col(copies) > 1).groupBy(digest).agg(first).select(f"{keep_id}.*")
    return once.select(*docs.columns).unionByName(again)
