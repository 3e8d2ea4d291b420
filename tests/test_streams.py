"""Streams of late and shuffled boxes, and transitions that share a number, against the batch."""

import random

import pandas as pd
from pyspark.sql import functions as F

from framelake.operators import tasklog, tracking
from framelake.streaming import tracking as streaming

DETECTION = "job_id string, frame_id long, ts_sec double, det_index long, label string, track_id string, confidence double, x1 long, y1 long, x2 long, y2 long"


def _rows(jobs: int, frames: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    return [(f"job-{j}", f, float(f), i, r.choice(["person", "car"]), None, 0.5, x := r.randint(0, 60), 0, x + 40, 50) for j in range(jobs) for f in range(frames) for i in range(1, 4)]


def _streamed(spark, tmp_path, name: str, batches: list[list[tuple]], **options):
    """The rows a stream gives for micro-batches in this order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, DETECTION).coalesce(1).write.parquet(str(tmp_path / name / f"b{k}"))
    schema = spark.createDataFrame([], DETECTION).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / name))
    q = streaming.object_tracks(stream, **options).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
    return q


def _key(rows) -> list[tuple]:
    return sorted((x.job_id, x.frame_id, x.det_index, x.track_num) for x in rows)


def test_shuffled_boxes_within_the_delay_equal_the_batch(spark, tmp_path):
    rows = _rows(3, 24, 7)
    r = random.Random(8)
    # A box comes up to four frames after its own time, so at most five frames after a newer box's frame.
    order = sorted(rows, key=lambda x: (x[1] + r.uniform(0, 4), x[3]))
    batches = [order[k : k + 27] for k in range(0, len(order), 27)]
    end = [(f"job-{j}", 100, 100.0, 1, "end", None, 0.5, 0, 0, 1, 1) for j in range(3)]
    q = _streamed(spark, tmp_path, "shuffled", [*batches, end], delay=5)
    q.processAllAvailable()
    q.stop()
    got = spark.table("shuffled")
    assert got.where("late").count() == 0
    want = tracking.object_tracks(spark.createDataFrame(rows, DETECTION))
    assert _key(got.collect()) == _key(want.collect())


def test_late_boxes_come_out_apart(spark, tmp_path):
    rows = [("j", f, float(f), 1, "car", None, 0.5, f, 0, f + 40, 50) for f in range(10)]
    late = ("j", 2, 2.0, 2, "car", None, 0.5, 0, 0, 40, 50)
    q = _streamed(spark, tmp_path, "late_boxes", [rows, [late]], delay=3)
    q.processAllAvailable()
    q.stop()
    tracks, left = streaming.split_late(spark.table("late_boxes"))
    assert [(x.frame_id, x.det_index) for x in left.collect()] == [(2, 2)] and left.columns == ["job_id", "frame_id", "det_index", "label", "x1", "y1", "x2", "y2"]
    # Frames 6 to 9 may still get boxes.
    assert _key(tracks.collect()) == [("j", f, 1, 1) for f in range(6)]


def test_idle_jobs_are_tracked_to_their_end(spark, tmp_path):
    import time

    rows = _rows(2, 6, 9)
    q = _streamed(spark, tmp_path, "idle_jobs", [rows], delay=50, idle_seconds=0.5)
    want = _key(tracking.object_tracks(spark.createDataFrame(rows, DETECTION)).collect())
    until = time.time() + 60
    while time.time() < until and spark.table("idle_jobs").count() < len(want):
        time.sleep(0.5)
    q.stop()
    assert _key(spark.table("idle_jobs").collect()) == want


def test_transitions_with_one_number_fold_alike(spark):
    r = random.Random(11)
    rows = [(f"t{k}", r.randrange(1, 8), r.choice([*tasklog.OPS, "none"]), r.choice([None, "a", "b"])) for k in range(60) for _ in range(14)]
    log = spark.createDataFrame(rows, "task_id string, seq long, op string, owner string").repartition(4)
    got = {x.task_id: (x.status, x.attempts, x.lease_owner) for x in tasklog.latest_state(log, 2).collect()}
    want = {}
    for t, own in pd.DataFrame(rows, columns=["task_id", "seq", "op", "owner"]).groupby("task_id"):
        state = tasklog.fold(own, 2)
        if state[0] is not None:
            want[t] = state
    assert got == want and len(want) > 30
