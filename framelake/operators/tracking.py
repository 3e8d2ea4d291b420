"""Greedy box tracking, job by job.

The result depends on the order of boxes, so each task sorts its jobs by frame and
index and takes frame after frame. What it holds is one frame and the tracks of
the last ``max_gap`` frames, however long a job is. Jobs with more than ``whole``
boxes are cut where no track can cross, tracked in parallel, and numbered by a
running sum of the tracks before. ``framelake.streaming.tracking`` keeps the same
state between micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import ids
from framelake.operators import sequences
from framelake.operators.ordered import whole_groups
from framelake.shared import written

#: Least overlaps and most frames that a track may skip.
FACE_IOU, OBJECT_IOU, MAX_GAP = 0.35, 0.25, 2
#: Jobs with more boxes are cut at their gaps, and their segments dealt to tasks.
WHOLE = 200_000


def box_iou(a: tuple, b: tuple) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    size = lambda r: max(0, r[2] - r[0]) * max(0, r[3] - r[1])
    union = size(a) + size(b) - w * h
    return w * h / union if union > 0 else 0.0


@dataclass
class Tracker:
    """Tracks of one job: number -> (label, box, last frame)."""

    least_iou: float
    max_gap: int = MAX_GAP
    following: int = 1
    tracks: dict[int, tuple] = field(default_factory=dict)
    last: int | None = None
    given: list[int] = field(default_factory=list)

    def frame(self, frame_id: int, items: list[tuple]) -> list[int]:
        """Numbers for the (label, box) items of one frame; none is given twice, also if more items of the frame follow."""
        if frame_id != self.last:
            self.last, self.given = frame_id, []
            self.tracks = {n: t for n, t in self.tracks.items() if frame_id - t[2] <= self.max_gap}
        out: list[int] = []
        for label, box in items:
            best, best_iou = None, 0.0
            for n, (other, old, _) in self.tracks.items():
                if n not in self.given and other == label and (score := box_iou(box, old)) > best_iou:
                    best, best_iou = n, score
            if best is None or best_iou < self.least_iou:
                best, self.following = self.following, self.following + 1
            self.tracks[best] = (label, box, frame_id)
            self.given.append(best)
            out.append(best)
        return out


BOX = ["x1", "y1", "x2", "y2"]


def number_rows(tracker: Tracker, rows: pd.DataFrame, label: str | None, order: list[str]) -> pd.Series:
    """Track numbers of rows in frame order; the tracker keeps its state."""
    rows = rows.sort_values(order, kind="stable")
    out: list[int] = []
    for frame_id, part in rows.groupby("frame_id", sort=False):
        names = part[label] if label else [""] * len(part)
        out += tracker.frame(int(frame_id), list(zip(names, map(tuple, part[BOX].to_numpy().tolist()))))
    return pd.Series(out, index=rows.index, dtype="int64")


def _numbered(rows: DataFrame, keys: list[str], index: str, label: str | None, least_iou: float, max_gap: int) -> DataFrame:
    """Track numbers from 1 within each of ``keys``, which a task takes one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tracker = None, None
        for t in whole_groups(batches, [*keys, "frame_id"]):
            groups, frames = list(zip(*(t.column(k).to_pylist() for k in keys))), t.column("frame_id").to_pylist()
            names = t.column(label).to_pylist() if label else [""] * len(groups)
            boxes = list(zip(*(t.column(c).to_pylist() for c in BOX)))
            numbers, at = [], 0
            while at < len(groups):
                end = at + 1
                while end < len(groups) and frames[end] == frames[at] and groups[end] == groups[at]:
                    end += 1
                if tracker is None or groups[at] != now:
                    now, tracker = groups[at], Tracker(least_iou, max_gap)
                numbers += tracker.frame(frames[at], list(zip(names[at:end], boxes[at:end])))
                at = end
            yield from t.append_column("track_num", pa.array(numbers, pa.int64())).combine_chunks().to_batches()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "frame_id", index)
    return dealt.mapInArrow(run, f"{schema}, track_num long")


def segments(rows: DataFrame, max_gap: int) -> DataFrame:
    """(job_id, frame_id, segment): a job's frames with boxes, cut where more than ``max_gap`` frames pass without any.

    No track crosses such a cut. Frames are scanned in ranges, not job by job.
    """
    ranges = sequences.in_ranges(rows.select("job_id", "frame_id").distinct(), ["job_id"], ["frame_id"])
    ranges = sequences.previous(ranges, ["job_id"], ["frame_id"], "frame_id", "before")
    cut = F.when(F.col("frame_id") - F.col("before") > max_gap, 1).otherwise(0)
    return sequences.running(ranges, ["job_id"], ["frame_id"], cut, "segment").select("job_id", "frame_id", "segment")


def _in_segments(rows: DataFrame, index: str, label: str | None, least_iou: float, max_gap: int) -> DataFrame:
    """Tracks the segments of jobs each on its own; a segment's numbers go on where those of the segments before end."""
    columns = rows.columns
    placed = rows.join(segments(rows, max_gap), ["job_id", "frame_id"]).select(*columns, "segment")
    tracked = written(_numbered(placed, ["job_id", "segment"], index, label, least_iou, max_gap), "tracked")
    counts = tracked.groupBy("job_id", "segment").agg(F.max("track_num").alias("tracks"))
    ranges = sequences.in_ranges(counts, ["job_id"], ["segment"])
    upto = sequences.running(ranges, ["job_id"], ["segment"], F.col("tracks"), "upto").select("job_id", "segment", (F.col("upto") - F.col("tracks")).alias("before"))
    out = tracked.join(upto, ["job_id", "segment"])
    return out.select(*columns, (F.col("track_num") + F.col("before")).alias("track_num"))


def _tracked(rows: DataFrame, index: str, label: str | None, least_iou: float, max_gap: int, whole: int) -> DataFrame:
    chosen = rows.select("job_id", "frame_id", index, *([label] if label else []), *BOX)
    sizes = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > whole)
    long = written(sizes.select("job_id"), "long-jobs")
    if long.isEmpty():
        return _numbered(chosen, ["job_id"], index, label, least_iou, max_gap)
    short = _numbered(chosen.join(long, "job_id", "left_anti"), ["job_id"], index, label, least_iou, max_gap)
    return short.unionByName(_in_segments(chosen.join(long, "job_id", "left_semi"), index, label, least_iou, max_gap))


def object_tracks(detections: DataFrame, least_iou: float = OBJECT_IOU, max_gap: int = MAX_GAP, whole: int = WHOLE) -> DataFrame:
    """Adds track_num and track_id '<label>_<number>'; numbers are shared by all labels."""
    out = _tracked(detections, "det_index", "label", least_iou, max_gap, whole)
    return out.withColumn("track_id", F.concat_ws("_", "label", "track_num"))


def face_tracks(faces: DataFrame, least_iou: float = FACE_IOU, max_gap: int = MAX_GAP, whole: int = WHOLE) -> DataFrame:
    out = _tracked(faces, "face_id", None, least_iou, max_gap, whole)
    return out.withColumn("identity_id", F.concat(F.lit("face_"), "track_num"))


def track_number(detector_id: Column | None, tracked: Column | None, index: Column, job_id: Column, frame_id: Column, label: Column, has_ids: Column | None = None) -> Column:
    """The detector's id, else the tracker's number, else a number from a hash.

    Where the detector gives ids (``has_ids``) but not for this box, or not a number, index + 1 counts.
    """
    fallback = ids.fallback_track_number(job_id, frame_id, label, index)
    own = F.lit(None).cast("long")
    if detector_id is not None:
        number = F.when(~F.isnan(detector_id.cast("double")), detector_id.cast("double").cast("long"))
        own = F.when(has_ids if has_ids is not None else detector_id.isNotNull(), F.coalesce(number, index + 1))
    return F.coalesce(own, tracked if tracked is not None else F.lit(None).cast("long"), fallback)
