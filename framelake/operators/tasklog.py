"""The task log: an append-only table of transitions, and state folded from it.

A transition is (task_id, seq, op, at, ...). The state of a task depends on the
order of its transitions, so each task is one group, folded in order by one
expression; groups are as small as one task's history. Streams take the same steps
in Python, where their state is. One driver appends claims (Spark has no row locks);
repeated appends are dropped by (task_id, seq).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ("queued", "retry", "processing")
OPS = ("enqueue", "claim", "success", "retry", "fail")


def backoff(attempt: Column, base: float = 5, multiplier: float = 2, most: float = 300) -> Column:
    """Seconds to wait after an attempt: base, then times the multiplier each time, most at most."""
    base, multiplier, most = max(1, base), max(1, multiplier), max(1, most)
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(float(multiplier)), F.greatest(F.lit(0), attempt - 1)))


def step(state: tuple[str | None, int, str | None], op: str, owner: str | None, most: int, status: str | None = None) -> tuple[str | None, int, str | None]:
    """One transition of (status, attempts, lease owner); what isn't allowed changes nothing."""
    now, attempts, lease = state
    mine = now == "processing" and (owner is None or owner == lease)
    if op == "enqueue":
        return state if now in ACTIVE else ("queued", 0, None)
    if op == "claim":
        return ("processing", attempts + 1, owner) if now in ("queued", "retry") else state
    if op == "success":
        return ("succeeded", attempts, None) if mine else state
    if op == "retry":
        return ("dead_letter" if attempts >= most else "retry", attempts, None) if mine else state
    if op == "fail":
        return (status or "failed", attempts, None) if mine and (status or "failed") in ("failed", "dead_letter") else state
    return state


def _stepped(state: Column, x: Column, most: int) -> Column:
    """``step`` as an expression; a transition whose number was there before changes nothing."""
    now, attempts, lease = state["status"], state["attempts"], state["owner"]
    op, owner, none = x["op"], x["owner"], F.lit(None).cast("string")
    mine = (now == "processing") & (owner.isNull() | (owner == lease))

    def to(status: Column, n: Column, who: Column) -> Column:
        return F.struct(status.alias("status"), n.alias("attempts"), who.alias("owner"), x["seq"].alias("seq"))

    return (
        F.when(x["seq"] == state["seq"], state)
        .when((op == "enqueue") & ~F.coalesce(now.isin(*ACTIVE), F.lit(False)), to(F.lit("queued"), F.lit(0), none))
        .when((op == "claim") & now.isin("queued", "retry"), to(F.lit("processing"), attempts + 1, owner))
        .when((op == "success") & mine, to(F.lit("succeeded"), attempts, none))
        .when((op == "retry") & mine, to(F.when(attempts >= most, "dead_letter").otherwise("retry"), attempts, none))
        .when((op == "fail") & mine, to(F.lit("failed"), attempts, none))
        .otherwise(to(now, attempts, lease))
    )


def fold(rows: pd.DataFrame, most: int, state: tuple = (None, 0, None)) -> tuple:
    # Of transitions with one number, the first by operation and owner (without one before) counts, as in the batch.
    for r in rows[rows["op"].isin(OPS)].sort_values(["seq", "op", "owner"], na_position="first").drop_duplicates("seq").itertuples(index=False):
        owner = None if pd.isna(r.owner) else r.owner
        state = step(state, r.op, owner, most)
    return state


def latest_state(log: DataFrame, max_attempts: int = 3) -> DataFrame:
    """(task_id, status, attempts, lease_owner, last_seq) after all transitions of the log.

    What isn't a transition only counts for last_seq.
    """
    owner = F.col("owner") if "owner" in log.columns else F.lit(None).cast("string")
    taken = F.when(F.col("op").isin(*OPS), F.struct(F.col("seq").cast("long").alias("seq"), "op", owner.alias("owner")))
    histories = log.groupBy("task_id").agg(F.array_sort(F.collect_list(taken)).alias("history"), F.max(F.col("seq").cast("long")).alias("last_seq"))
    start = F.struct(F.lit(None).cast("string").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("owner"), F.lit(None).cast("long").alias("seq"))
    s = F.col("state")
    folded = histories.withColumn("state", F.aggregate("history", start, lambda state, x: _stepped(state, x, max_attempts)))
    return folded.select("task_id", s["status"].alias("status"), s["attempts"].alias("attempts"), s["owner"].alias("lease_owner"), "last_seq").where("status is not null")


def claim_order(tasks: DataFrame, now: Column, n: int = 1) -> DataFrame:
    """The next n tasks to claim: due, queued or to be retried, not leased; by due time, then number.

    A top-k: each partition sorts only its own first n.
    """
    free = F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") <= now)
    due = tasks.where(F.col("status").isin("queued", "retry") & (F.col("next_attempt_at") <= now) & free)
    return due.orderBy("next_attempt_at", "id").limit(n)


def enqueue(new: DataFrame, tasks: DataFrame) -> DataFrame:
    """New tasks (with idempotency_key, seq) whose key has no active task, the first of each key."""
    active = tasks.where(F.col("status").isin(*ACTIVE)).select("idempotency_key")
    first = F.row_number().over(Window.partitionBy("idempotency_key").orderBy("seq"))
    return new.join(active, "idempotency_key", "left_anti").withColumn("n", first).where("n = 1").drop("n")


def expired_leases(tasks: DataFrame, now: Column) -> DataFrame:
    """Tasks in processing whose lease has run out (an option; by default they stay)."""
    return tasks.where((F.col("status") == "processing") & (F.col("lease_expires_at") <= now))


def job_state(events: DataFrame) -> DataFrame:
    """(job_id, seq, op, stage, error) to the latest state; stages change only while processing.

    Terminal states come from the last complete or fail; completing clears the error.
    """
    done = F.col("op").isin("complete", "fail")
    end = events.where(done).groupBy("job_id").agg(F.max_by(F.struct("op", "error"), "seq").alias("e"), F.min("seq").alias("first_end"))
    stages = events.where("op in ('create', 'stage')").join(end.select("job_id", "first_end"), "job_id", "left")
    stage = stages.where("first_end is null or seq < first_end").groupBy("job_id").agg(F.max_by("stage", "seq").alias("stage"))
    status = F.when(F.col("e.op") == "complete", "completed").when(F.col("e.op") == "fail", "failed").otherwise("processing")
    error = F.when(F.col("e.op") == "fail", F.col("e.error"))
    return stage.join(end, "job_id", "left").select("job_id", status.alias("status"), "stage", error.alias("error"))


def error_kind(error_type: Column) -> Column:
    """Bad payloads and storage failures end a task; anything else is tried again."""
    return F.when(error_type.isin("payload", "storage"), "dead_letter").otherwise("retry")


def terminal_action(policy: str) -> str:
    """What a job's end looks like when its task is dead: failed, or completed with empty scenes."""
    if policy not in ("fail_job", "fallback_empty"):
        raise ValueError(f"unknown policy {policy}")
    return "failed" if policy == "fail_job" else "completed"


def after_retry(tasks: DataFrame, now: Column, policy: str = "fail_job", max_attempts: int = 3, **delays: float) -> DataFrame:
    """(task_id, job_id, status, next_attempt_at, stage, job_status, error) after attempts (task_id, job_id, attempts, error) that may be tried again.

    Such a task waits for its next attempt and its job for the task; after the
    last attempt the task is dead, and its job ends as the policy says.
    """
    dead = F.col("attempts") >= max_attempts
    wait = F.make_dt_interval(secs=backoff(F.col("attempts"), **delays).cast("decimal(18,6)"))
    return tasks.select(
        "task_id", "job_id", F.when(dead, "dead_letter").otherwise("retry").alias("status"), F.when(~dead, now + wait).alias("next_attempt_at"),
        F.when(~dead, "waiting_scene_ai").alias("stage"), F.when(dead, terminal_action(policy)).otherwise("processing").alias("job_status"), "error",
    )


def decoded_payload(tasks: DataFrame, json_col: str = "payload") -> DataFrame:
    """The payload's well-formed scenes (two numbers) and frames; anything else is dropped."""
    kind = "struct<job_id:string,source_key:string,scenes:array<array<double>>,frame_results:array<map<string,string>>>"
    p = tasks.withColumn("p", F.from_json(json_col, kind))
    scenes = F.filter("p.scenes", lambda s: (F.size(s) == 2) & s[0].isNotNull() & s[1].isNotNull())
    frames = F.filter("p.frame_results", lambda f: f.isNotNull())
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    return p.select(*tasks.columns, "p.source_key", none(scenes, "array<array<double>>").alias("scenes"), none(frames, "array<map<string,string>>").alias("frames"))


def encoded_payload(job_id: Column, scenes: Column, source_key: Column) -> Column:
    return F.to_json(F.struct(job_id.alias("job_id"), scenes.alias("scenes"), source_key.alias("source_key")))


def worker_provenance(rows: DataFrame, worker: str, model: str) -> DataFrame:
    """Adds who made a row, as a struct column of its own."""
    return rows.withColumn("worker", F.struct(F.lit(worker).alias("worker_id"), F.lit(model).alias("model")))
