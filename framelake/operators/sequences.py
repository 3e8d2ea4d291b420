"""Long sequences by ranges: earlier values and running sums without a window over a whole key.

Rows of a key (a job) in their order are cut into ranges of about equal size, so a
long sequence is spread over tasks. Each range is summarized in one row; a window
over a key's summaries, of which there are no more than ranges, says what comes
before a range, and the rows of a range need no more than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.shared import written

PART = "__part"


def in_ranges(rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """The rows with the number of their range in ``__part``; ranges ascend with (keys, order).

    The rows are written, as another run of the partitioning could cut elsewhere.
    Keys and order aren't null, and together name a row.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = rows.repartitionByRange(n, *keys, *order).withColumn(PART, F.spark_partition_id())
    return written(dealt, "ranges")


def _before(ranges: DataFrame, keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(PART)


def previous(ranges: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds the value of the row before in the key's sequence; null for a key's first row."""
    own = F.lag(value).over(Window.partitionBy(PART, *keys).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(PART, *keys).orderBy(*order)) == 1
    last = ranges.groupBy(PART, *keys).agg(F.max_by(value, F.struct(*order)).alias("__last"))
    carried = last.select(PART, *keys, F.lag("__last").over(_before(ranges, keys)).alias("__carried"))
    out = ranges.withColumns({"__own": own, "__first": first}).join(carried, [PART, *keys])
    return out.withColumn(name, F.when(F.col("__first"), F.col("__carried")).otherwise(F.col("__own"))).drop("__own", "__first", "__carried")


def running(ranges: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of a whole-number value from the key's first row up to and with each row."""
    rows = ranges.withColumn("__value", value)
    own = F.sum("__value").over(Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sums = rows.groupBy(PART, *keys).agg(F.sum("__value").alias("__sum"))
    upto = F.coalesce(F.sum("__sum").over(_before(rows, keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = sums.select(PART, *keys, upto.alias("__carried"))
    return rows.withColumn("__own", own).join(carried, [PART, *keys]).withColumn(name, F.col("__own") + F.col("__carried")).drop("__own", "__carried", "__value")


def ordinals(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Numbers each key's rows from 0 in their order; the rows may come in any."""
    return running(in_ranges(rows, keys, order), keys, order, F.lit(1), name).withColumn(name, F.col(name) - 1).drop(PART)
