"""Task state over a stream of transitions, and the polling worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framelake.operators.tasklog import claim_order, fold

OUTPUT = "task_id string, status string, attempts int, lease_owner string, last_seq long"


def task_states(log: DataFrame, max_attempts: int = 3) -> DataFrame:
    """A stream of (task_id, seq, op, owner) to the state of each task touched, in update mode.

    Transitions that were seen before (a lower or equal seq) are dropped, so a
    replayed append changes nothing.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts, owner, last = state.get if state.exists else (None, 0, None, 0)
        rows = pd.concat(list(batches))
        rows = rows[rows["seq"] > last]
        if len(rows):
            status, attempts, owner = fold(rows, max_attempts, (status, attempts, owner))
            last = int(rows["seq"].max())
        state.update((status, attempts, owner, last))
        yield pd.DataFrame([(key[0], status, attempts, owner, last)], columns=["task_id", "status", "attempts", "lease_owner", "last_seq"])

    rows = log.select("task_id", F.col("seq").cast("long"), "op", "owner")
    return rows.groupBy("task_id").applyInPandasWithState(run, OUTPUT, "status string, attempts int, owner string, last long", "update", GroupStateTimeout.NoTimeout)


def worker(log: DataFrame, execute: Callable[[DataFrame], None], checkpoint: str, poll_seconds: float = 2.0) -> StreamingQuery:
    """Runs ``execute`` on the tasks that every micro-batch queues, for the first time or again; the checkpoint makes restarts resume."""

    def batch(rows: DataFrame, _: int) -> None:
        queued = rows.where("op in ('enqueue', 'retry')").dropDuplicates(["task_id"])
        if not queued.isEmpty():
            execute(queued)

    return log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=f"{poll_seconds} seconds").start()


def poller(spark: SparkSession, tasks: Callable[[], DataFrame], execute: Callable[[DataFrame], None], checkpoint: str, poll_seconds: float = 2.0, n: int = 1) -> StreamingQuery:
    """Looks at the table of tasks at every tick and runs ``execute`` on the n that are due first, retries whose time has come among them.

    ``tasks`` reads the table as it is at that moment; ``execute`` records the claim,
    so that a task isn't due at the next tick.
    """

    def batch(_: DataFrame, __: int) -> None:
        due = claim_order(tasks(), F.current_timestamp(), n)
        if not due.isEmpty():
            execute(due)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=f"{poll_seconds} seconds").start()
