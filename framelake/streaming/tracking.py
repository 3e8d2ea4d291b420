"""Object tracking over a stream of detections that come late and out of order.

Each job is a key with a clock of its own, the newest frame it has seen: times of
media are counted from the start of a recording, so one watermark over all jobs
would close the younger ones. Boxes wait in the job's state until their frame is
more than ``delay`` frames old, then frames are tracked in order. What the job has
passed by then is not tracked and not lost: it comes out as late, without a number.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framelake.operators.tracking import BOX, MAX_GAP, OBJECT_IOU, Tracker, number_rows

OUTPUT = "job_id string, frame_id long, det_index long, label string, x1 long, y1 long, x2 long, y2 long, track_num long, late boolean"
#: The tracker as JSON, the boxes that wait as JSON, the newest frame seen, the last frame taken.
STATE = "tracker string, waiting string, newest long, taken long"


def _restored(state: str) -> Tracker:
    tracker = Tracker(**json.loads(state))
    tracker.tracks = {int(n): (label, tuple(box), frame) for n, (label, box, frame) in tracker.tracks.items()}
    return tracker


def object_tracks(detections: DataFrame, least_iou: float = OBJECT_IOU, max_gap: int = MAX_GAP, delay: int = 0, idle_seconds: float | None = None) -> DataFrame:
    """A streaming DataFrame of detections to their track numbers, in append mode.

    Boxes that come no more than ``delay`` frames after a newer one get the numbers
    of the batch tracker, whatever their order. Without a delay, boxes are tracked
    as they come. Boxes of the frame taken last go on where it ended; those of
    earlier frames are ``late``: they have no number. A job without new boxes for
    ``idle_seconds`` is tracked to its end; without it, the last ``delay`` frames
    wait for newer ones. A job's state is its live tracks and the boxes of
    ``delay`` frames.
    """
    columns = ["job_id", "frame_id", "det_index", "label", *BOX]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker, waiting, newest, taken = Tracker(least_iou, max_gap), [], None, None
        if state.exists:
            tracker, waiting, newest, taken = _restored(state.get[0]), json.loads(state.get[1]), *state.get[2:]
        came = pd.concat([b[columns] for b in batches], ignore_index=True) if not state.hasTimedOut else pd.DataFrame(columns=columns)
        late = came[came["frame_id"] < taken] if taken is not None else came[:0]
        held = pd.DataFrame(waiting, columns=columns)
        rows = pd.concat([x for x in (held, came.drop(late.index)) if len(x)] or [held], ignore_index=True)
        if len(came):
            newest = max(int(came["frame_id"].max()), newest if newest is not None else int(came["frame_id"].max()))
        upto = newest if state.hasTimedOut or not delay else newest - delay - 1
        taken = upto if taken is None else max(taken, upto)
        ready = rows["frame_id"] <= taken
        done = rows[ready].copy()
        if len(done):
            done["track_num"] = number_rows(tracker, done, "label", ["frame_id", "det_index"])
        rest = rows[~ready]
        state.update((json.dumps(asdict(tracker)), rest.to_json(orient="values"), newest, taken))
        if idle_seconds is not None and len(rest):
            state.setTimeoutDuration(max(1, int(1000 * idle_seconds)))
        yield done.assign(track_num=done.get("track_num", pd.Series(dtype="Int64")), late=False)[[*columns, "track_num", "late"]]
        if len(late):
            yield late.assign(track_num=pd.Series(pd.NA, index=late.index, dtype="Int64"), late=True)[[*columns, "track_num", "late"]]

    keyed = detections.select(*columns).groupBy("job_id")
    timeout = GroupStateTimeout.NoTimeout if idle_seconds is None else GroupStateTimeout.ProcessingTimeTimeout
    return keyed.applyInPandasWithState(run, OUTPUT, STATE, "append", timeout)


def split_late(tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A micro-batch of tracks (as foreachBatch gets them) as (tracks, late boxes), each for a table of its own."""
    return tracks.where(~F.col("late")).drop("late"), tracks.where("late").drop("late", "track_num")
