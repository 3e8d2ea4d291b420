"""The corpus pipeline: filter, deduplicate, mix and encode documents.

Each stage gets all rows that its predecessor kept, written as Parquet and read
again. All but the last return the columns of documents; the last returns the
token counts and digests of every row of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelake.llm import bpe, exact_dedup, hyperminhash, mixing, nbsvm
from framelake.llm.common import scratch, table, written
from framelake.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nbsvm.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_distinct(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hyperminhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode(docs, tokenizer_path()))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("mixing to target weights", mix),
    ("BPE encoding and decoding", encode),
]
#: A trained model and BPE aren't expressible in SQL; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), kept=True)
    return STAGES[-1][1](spark, docs, sf_dir)
