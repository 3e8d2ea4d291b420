"""Scene packets: frames in scenes, entity and event counts, keyframes.

Tables: scenes (job_id, scene_id, start_sec, end_sec); observations of any kind
carry job_id, frame_id and ts_sec. Every key leads with job_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators import sequences

SCENE = ["job_id", "scene_id"]
MAX_ENTITIES = MAX_EVENTS = 8
MAX_KEYFRAMES = 3
LABEL_THRESHOLD = 4
#: Seconds of a time bucket of the join of rows and scenes.
BUCKET_SEC = 60


def packet_value(c: Column) -> Column:
    """Without white space at both ends; 'unknown' if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit("")), F.lit("unknown"))


def in_scenes(rows: DataFrame, scenes: DataFrame) -> DataFrame:
    """Rows joined with the scenes their time lies in, both ends included; on a boundary, two.

    An equi-join on the job and a bucket of time, with the interval as residual: a
    long job is spread over tasks, and a row meets the scenes of its minute, not of
    its job. A scene is listed once for each bucket it touches; its bounds are finite.
    """
    bucket = lambda c: F.floor(F.col(c) / BUCKET_SEC)
    touched = F.explode(F.sequence(bucket("start_sec"), bucket("end_sec")))
    bounds = scenes.where("end_sec >= start_sec").select("job_id", "scene_id", "start_sec", "end_sec", touched.alias("__bucket"))
    rows = rows.drop("scene_id", "start_sec", "end_sec").withColumn("__bucket", bucket("ts_sec"))
    return rows.join(bounds, ["job_id", "__bucket"]).where(F.col("ts_sec").between(F.col("start_sec"), F.col("end_sec"))).drop("__bucket")


def _named(rows: DataFrame, name: Column, kind: str, branch: int, seq: str) -> DataFrame:
    at = F.struct(F.col("ts_sec").alias("t"), F.col("frame_id").alias("f"), F.lit(branch).alias("b"), F.col(seq).alias("i"))
    return rows.select(*SCENE, name.alias("name"), F.lit(kind).alias("entity_type"), at.alias("seq"))


def entity_counts(detections: DataFrame, segments: DataFrame, faces: DataFrame, k: int = MAX_ENTITIES) -> DataFrame:
    """(job_id, scene_id, name, entity_type, n, rank): the k most frequent entities of each scene.

    Detections and segments both count as objects, faces as one human entity.
    Ranked by count, then name, then first sighting.
    """
    seen = _named(detections, packet_value(F.col("label")), "object", 0, "det_index")
    seen = seen.unionByName(_named(segments, packet_value(F.col("class_name")), "object", 1, "object_id"))
    seen = seen.unionByName(_named(faces, F.lit("face"), "human", 2, "face_id"))
    counts = seen.groupBy(*SCENE, "name", "entity_type").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"))
    rank = F.row_number().over(Window.partitionBy(*SCENE).orderBy(F.desc("n"), "name", "seq"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k).drop("seq")


def scene_totals(entities: DataFrame) -> DataFrame:
    """Totals of the entities that are left after the cut to the most frequent ones."""
    n = F.col("n")
    return entities.groupBy(*SCENE).agg(
        F.sum(F.when(F.col("entity_type") == "object", n).otherwise(0)).alias("objects_total"),
        F.sum(F.when(F.col("name") == "face", n).otherwise(0)).alias("faces_total"),
        F.countDistinct("name").alias("unique_labels"),
    )


def event_counts(entities: DataFrame, k: int = MAX_EVENTS) -> DataFrame:
    """(job_id, scene_id, event, n, evidence, rank): one for each entity, and face_detected if there are faces."""
    observed = entities.select(*SCENE, F.concat("name", F.lit("_observed")).alias("event"), "n", F.lit("aggregated_frame_analysis").alias("evidence"), F.col("rank").alias("seq"))
    faces = scene_totals(entities).where("faces_total > 0")
    faces = faces.select(*SCENE, F.lit("face_detected").alias("event"), F.col("faces_total").alias("n"), F.lit("face_recognition").alias("evidence"), F.lit(1 << 30).alias("seq"))
    rank = F.row_number().over(Window.partitionBy(*SCENE).orderBy(F.desc("n"), "event", "seq"))
    return observed.unionByName(faces).withColumn("rank", rank).where(F.col("rank") <= k).drop("seq")


def keyframes(frames: DataFrame, totals: DataFrame, threshold: int = LABEL_THRESHOLD, n: int = MAX_KEYFRAMES) -> DataFrame:
    """The first n frames of each scene that has enough distinct labels; frames come with their scene."""
    rich = totals.where(F.col("unique_labels") >= threshold).select(*SCENE)
    place = F.row_number().over(Window.partitionBy(*SCENE).orderBy("frame_id"))
    return frames.join(rich, SCENE, "left_semi").withColumn("position", place).where(F.col("position") <= n)


def frame_summary(frames: DataFrame, detections: DataFrame, segments: DataFrame, faces: DataFrame, k: int = 8) -> DataFrame:
    """First k labels and classes of each frame in input order, and its three counts."""
    key = ["job_id", "frame_id"]

    def first(rows: DataFrame, index: str, value: str | None, count: str, values: str | None) -> DataFrame:
        aggs = [F.count(F.lit(1)).alias(count)]
        if value:
            listed = F.slice(F.array_sort(F.collect_list(F.struct(index, value))), 1, k)
            aggs.append(F.transform(listed, lambda x: x[value]).alias(values))
        return rows.groupBy(*key).agg(*aggs)

    out = frames.select(*key)
    out = out.join(first(detections, "det_index", "label", "n_detections", "labels"), key, "left")
    out = out.join(first(segments, "object_id", "class_name", "n_segments", "classes"), key, "left")
    out = out.join(first(faces, "face_id", None, "n_faces", None), key, "left")
    empty = F.array().cast("array<string>")
    return out.fillna(0, ["n_detections", "n_segments", "n_faces"]).withColumns({c: F.coalesce(c, empty) for c in ("labels", "classes")})


def label_rollup(detections: DataFrame) -> DataFrame:
    """Counts by job, scene and label with subtotals (an extra: Spark's rollup)."""
    return detections.rollup("job_id", "scene_id", "label").agg(F.count(F.lit(1)).alias("n"))


def cuts_from_scores(scores: DataFrame, threshold: float, parts: int | None = None) -> DataFrame:
    """(job_id, seq, ts_sec, score) to scenes: a frame whose score changes by more than the threshold starts one.

    A running count of cuts numbers the scenes of each job. Frames are scanned in
    ranges of (job, seq), so a long recording is no single task's.
    """
    order = ["seq"]
    ranges = sequences.in_ranges(scores.select("job_id", "seq", "ts_sec", "score"), ["job_id"], order, parts)
    ranges = sequences.previous(ranges, ["job_id"], order, "score", "before")
    cut = F.when(F.abs(F.col("score") - F.col("before")) > threshold, 1).otherwise(0)
    numbered = sequences.running(ranges, ["job_id"], order, cut, "scene_id")
    return numbered.groupBy("job_id", "scene_id").agg(F.min("ts_sec").alias("start_sec"), F.max("ts_sec").alias("end_sec"), F.count(F.lit(1)).alias("n_frames"))


def numbered_scenes(scenes: DataFrame) -> DataFrame:
    """Scenes (job_id, start_sec, end_sec) in any order, numbered from 0 by time within each job; equal ones are one."""
    return sequences.ordinals(scenes.select("job_id", "start_sec", "end_sec").distinct(), ["job_id"], ["start_sec", "end_sec"], "scene_id")


def middle_frames(scenes: DataFrame, fps: Column | None = None, default_fps: float = 25.0) -> DataFrame:
    """The frame in the middle of each scene: time and source index; frame_id is the scene's ordinal."""
    rate = F.coalesce(F.nullif(fps if fps is not None else F.lit(None).cast("double"), F.lit(0.0)), F.lit(default_fps))
    middle = (F.col("start_sec") + F.col("end_sec")) / 2
    return scenes.select("job_id", "scene_id", F.col("scene_id").alias("frame_id"), middle.alias("ts_sec"), F.floor(middle * rate).cast("long").alias("source_index"))


def tracking_samples(scenes: DataFrame, fps: float, sample_fps: float, most: int) -> DataFrame:
    """Sample times of each scene on a whole-number grid from its start, both ends included, ``most`` at most."""
    step = 1.0 / max(sample_fps, 1e-9) if sample_fps > 0 else 1.0
    span = F.col("end_sec") - F.col("start_sec")
    n = F.least(F.floor(span / step + 1e-9) + 1, F.lit(max(1, most))).cast("int")
    rows = scenes.where("end_sec >= start_sec").withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
    at = F.col("start_sec") + F.col("i") * F.lit(step)
    return rows.select(
        "job_id", "scene_id", F.col("i").cast("long").alias("sample_index"), (F.col("scene_id") * 1_000_000 + F.col("i")).cast("long").alias("frame_id"),
        at.alias("ts_sec"), F.floor(at * fps + 1e-9).cast("long").alias("source_index"),
    )
