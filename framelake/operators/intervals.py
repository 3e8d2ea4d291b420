"""Rows and the intervals their time lies in, by a sorted sweep.

Rows are cut into ranges of (job, time) of about equal size. An interval goes to
each range it crosses, once; in a range, both come sorted by time and are swept
in batches: an interval is live from its start until a row after its end has been
seen, and its rows in a batch are one run that two binary searches find. So a long
interval isn't copied once a minute, rows aren't compared with intervals that
ended before or begin after them, and no job is one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from framelake.operators.sequences import PART, in_ranges

#: Pairs that are handed on together.
PAIRS = 1 << 16


def crossing(ranges: DataFrame, scenes: DataFrame) -> DataFrame:
    """(part, scene): each scene once for each range with rows of its job that it crosses; ``at`` is where the sweep meets it."""
    held = ranges.groupBy(PART, "job_id").agg(F.min("ts_sec").alias("__low"), F.max("ts_sec").alias("__high"))
    bounds = scenes.where("end_sec >= start_sec").select("job_id", "scene_id", F.col("start_sec").cast("double"), F.col("end_sec").cast("double"))
    met = bounds.join(held, "job_id").where((F.col("start_sec") <= F.col("__high")) & (F.col("end_sec") >= F.col("__low")))
    return met.select(PART, "job_id", F.greatest("start_sec", "__low").alias("at"), F.struct("scene_id", "start_sec", "end_sec").alias("scene"))


def _pairs(rows: pa.Array, at: np.ndarray, scenes: pa.Array, most: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Rows sorted by time beside the scenes they lie in."""
    first = np.searchsorted(at, scenes.field("start_sec").to_numpy(), side="left")
    count = np.maximum(np.searchsorted(at, scenes.field("end_sec").to_numpy(), side="right") - first, 0)
    upto = np.cumsum(count)
    a = 0
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, side="right")))
        n = count[a:b]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if len(within):
            yield rows.take(pa.array(np.repeat(first[a:b], n) + within)), scenes.take(pa.array(np.repeat(np.arange(a, b), n)))
        a = b


def _sweep(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches of (part, job, at, kind, row, scene), sorted by the first four, to pairs of row and scene."""
    last, live = None, None
    for batch in batches:
        part, at, kind = (batch.column(i).to_numpy() for i in (0, 2, 3))
        job = batch.column(1).dictionary_encode()
        code = job.indices.to_numpy()
        edges = np.flatnonzero((part[1:] != part[:-1]) | (code[1:] != code[:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(part)]):
            if a == b:
                continue
            key = (int(part[a]), job.dictionary[int(code[a])].as_py())
            if key != last:
                last, live = key, batch.column(5).slice(0, 0)
            is_row = kind[a:b] == 1
            rows, begun = a + np.flatnonzero(is_row), a + np.flatnonzero(~is_row)
            live = pa.concat_arrays([live, batch.column(5).take(pa.array(begun))])
            if len(rows) and len(live):
                for pair in _pairs(batch.column(4).take(pa.array(rows)), at[rows], live, most):
                    yield pa.RecordBatch.from_arrays(list(pair), ["row", "scene"])
                live = live.filter(pa.array(live.field("end_sec").to_numpy() >= at[rows[-1]]))


def in_intervals(rows: DataFrame, scenes: DataFrame, parts: int | None = None, pairs: int = PAIRS) -> DataFrame:
    """Rows joined with all scenes their time lies in, both ends included; scenes may overlap and be of any length.

    The rows' columns are kept, but for a scene's own, which follow. Rows without
    a job or a time are in no scene, nor is any in a scene that ends before it
    starts or lacks a bound; repeated rows and scenes are all paired. The rows are
    written to the shared folder once, for their ranges.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = rows.drop("scene_id", "start_sec", "end_sec").where("job_id is not null and ts_sec is not null and not isnan(ts_sec)")
    ranges = in_ranges(rows, ["job_id"], ["ts_sec"], n)
    met = crossing(ranges, scenes)
    seen = ranges.select(PART, "job_id", F.col("ts_sec").cast("double").alias("at"), F.lit(1).alias("kind"), F.struct(*rows.columns).alias("row"))
    kinds = StructType([StructField("row", seen.schema["row"].dataType), StructField("scene", met.schema["scene"].dataType)])
    seen = seen.withColumn("scene", F.lit(None).cast(kinds["scene"].dataType))
    met = met.select(PART, "job_id", "at", F.lit(0).alias("kind"), F.lit(None).cast(kinds["row"].dataType).alias("row"), "scene")
    events = seen.union(met).repartitionById(n, F.col(PART)).sortWithinPartitions(PART, "job_id", "at", "kind")
    return events.mapInArrow(lambda batches: _sweep(batches, pairs), kinds).select("row.*", "scene.*")
