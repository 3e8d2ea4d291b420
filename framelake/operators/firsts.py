"""The first few rows of each group, without holding the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_k(rows: DataFrame, keys: list[str], order: Column, value: Column, k: int, name: str) -> DataFrame:
    """(keys, name): an array of the k first values of each group by ``order``.

    Rows are ranked and cut before they are collected, and every task passes on no
    more than k rows of a group. Keys aren't null.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__order"))
    ranked = rows.select(*keys, order.alias("__order"), value.alias("__value")).withColumn("__rank", rank).where(F.col("__rank") <= k)
    listed = F.array_sort(F.collect_list(F.struct("__rank", "__value")))
    return ranked.groupBy(*keys).agg(F.transform(listed, lambda x: x["__value"]).alias(name))
