"""Evidence of scene packets, and the checks that packets must pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import ids
from framelake.functions.canonical import canonical_json
from framelake.functions.timecode import format_timecode

#: Image modalities and the kind of frame image that shows each.
MODALITIES = {"object_detection": "detection", "original": "original", "semantic_segmentation": "segmentation"}
FACE_MODALITY = "face_recognition"
#: Parts in which references are checked, if shuffles don't have more: rows are wide in memory, so a task's part is small.
CHECK_PARTS = 256


def frame_contexts(frames: DataFrame, faces: DataFrame) -> DataFrame:
    """Frames of scenes with their image keys by modality; a face image only where there are faces."""
    key = ["job_id", "frame_id"]
    seen = faces.select(*key).distinct().withColumn("has_faces", F.lit(True))
    job, frame = F.col("job_id"), F.col("frame_id")
    images = [F.struct(F.lit(m).alias("key"), ids.frame_key(job, kind, frame).alias("value")) for m, kind in MODALITIES.items()]
    face = F.struct(F.lit(FACE_MODALITY).alias("key"), ids.frame_key(job, "face", frame).alias("value"))
    out = frames.join(seen, key, "left").fillna(False, ["has_faces"])
    entries = F.when(F.col("has_faces"), F.array(*images, face)).otherwise(F.array(*images))
    return out.withColumns({"images": F.map_from_entries(entries), "json_artifact_key": ids.analysis_key(job, frame), "timestamp": format_timecode(F.col("ts_sec"))})


def evidence_refs(contexts: DataFrame) -> DataFrame:
    """One reference for each frame and modality."""
    rows = contexts.select("job_id", "scene_id", "frame_id", "timestamp", "json_artifact_key", F.explode("images").alias("modality", "image_uri"))
    evidence_id = ids.deterministic_id("evidence", *map(F.col, ("scene_id", "frame_id", "modality", "image_uri", "json_artifact_key")))
    return rows.withColumn("evidence_id", evidence_id)


def _broken(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(job_id, scene_id, frame_id, rule) for each rule that a row breaks, in one pass."""
    broken = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())))
    return rows.select("job_id", "scene_id", "frame_id", F.explode(broken).alias("rule"))


def violations(scenes: DataFrame, contexts: DataFrame, refs: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(job_id, scene_id, frame_id, rule): every broken rule of the packets; empty if all are sound.

    Rules are checks of single rows, anti-joins, two joins and counts of repeats
    over all jobs at once, so one bad scene doesn't stop the others. References meet
    their frames and the index in many small parts; only keys and what is compared
    is shuffled.
    """
    parts = max(CHECK_PARTS, int(scenes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    index = refs if index is None else index
    scene, frame = ["job_id", "scene_id"], ["job_id", "scene_id", "frame_id"]
    by_id = [*scene, "evidence_id"]
    blank = lambda c: F.coalesce(F.length(c), F.lit(0)) == 0
    no_frame = lambda rows: rows.withColumn("frame_id", F.lit(None).cast("long"))
    image = lambda m: F.try_element_at("images", F.lit(m))
    always = F.lit(True)
    repeats = contexts.groupBy(*frame).agg(F.count(F.lit(1)).alias("n"))
    again = refs.select(*frame, "evidence_id").repartition(parts, *by_id).groupBy(*frame, "evidence_id").agg(F.count(F.lit(1)).alias("n"))
    # Each reference beside its frame, and beside its entry of the index.
    shown = contexts.select(*frame, "images", F.col("json_artifact_key").alias("frame_json"), always.alias("known")).repartition(parts, *frame)
    linked = refs.select(*frame, "modality", "image_uri", "json_artifact_key").repartition(parts, *frame).join(shown, frame, "left")
    listed = index.select(*by_id, F.col("frame_id").alias("index_frame"), F.col("json_artifact_key").alias("index_json"), always.alias("in_index")).repartition(parts, *by_id)
    stated = refs.select(*by_id, F.col("frame_id").alias("ref_frame"), F.col("json_artifact_key").alias("ref_json"), always.alias("in_refs")).repartition(parts, *by_id)
    both = stated.join(listed, by_id, "full").withColumn("frame_id", F.when(F.col("in_refs"), F.col("ref_frame")).otherwise(F.col("index_frame")))
    found = [
        _broken(no_frame(scenes.join(contexts.select(*scene).distinct(), scene, "left_anti")), {"no frames": always}),
        _broken(repeats, {"repeated frame": F.col("n") > 1}),
        _broken(contexts, {"no JSON key": blank("json_artifact_key")} | {f"no {m} image": blank(image(m)) for m in MODALITIES} | {"faces without image": F.col("has_faces") & blank(image(FACE_MODALITY))}),
        _broken(no_frame(scenes.join(refs.select(*scene).distinct(), scene, "left_anti")), {"no evidence": always}),
        _broken(again, {"repeated evidence": F.col("n") > 1}),
        _broken(refs, {"evidence without image": blank("image_uri"), "evidence without JSON key": blank("json_artifact_key")}),
        _broken(linked, {
            "unknown frame": F.col("known").isNull(),
            "image mismatch": F.col("known") & ~F.try_element_at("images", F.col("modality")).eqNullSafe(F.col("image_uri")),
            "JSON mismatch": F.col("known") & ~F.col("frame_json").eqNullSafe(F.col("json_artifact_key")),
        }),
        _broken(both, {
            "not in index": F.col("in_index").isNull(),
            "index mismatch": F.col("in_refs") & F.col("in_index") & ~F.col("index_json").eqNullSafe(F.col("ref_json")),
            "only in index": F.col("in_refs").isNull(),
        }),
    ]
    return reduce(DataFrame.unionByName, found)


def frame_anchors(detections: DataFrame, faces: DataFrame, ocr: DataFrame | None = None) -> DataFrame:
    """Anchors of each frame in order: detections, then faces, then text blocks."""
    def branch(rows: DataFrame, n: int, pos: str, text: str) -> DataFrame:
        return rows.select("job_id", "frame_id", F.lit(n).alias("branch"), F.col(pos).cast("long").alias("pos"), F.array("x1", "y1", "x2", "y2").alias("bbox"), F.col(text).alias("text_span"))

    out = branch(detections, 0, "det_index", "label").unionByName(branch(faces, 1, "face_id", "identity_id"))
    return out if ocr is None else out.unionByName(branch(ocr, 2, "pos", "text"))


def packet_json(scenes: DataFrame, entities: DataFrame, events: DataFrame, totals: DataFrame) -> DataFrame:
    """(job_id, scene_id, packet): canonical JSON, keys in alphabetic order, nulls written."""
    scene = ["job_id", "scene_id"]
    listed = lambda rows, fields, name: rows.groupBy(*scene).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct(*fields).alias("x")))), lambda r: r["x"]).alias(name))
    e = listed(entities, [F.col("n").alias("count"), "entity_type", "name"], "entities")
    v = listed(events, [F.col("n").alias("count"), "event", "evidence"], "events")
    rows = scenes.join(e, scene, "left").join(v, scene, "left").join(totals, scene, "left")
    empty = lambda c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c)
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    body = F.struct((F.col("end_sec") - F.col("start_sec")).alias("duration_sec"), "end_sec", empty("entities"), empty("events"), count("faces_total"), "job_id", count("objects_total"), "scene_id", "start_sec", count("unique_labels"))
    return rows.select(*scene, F.to_json(body, {"ignoreNullFields": "false"}).alias("packet"))


def packet_bytes(packets: DataFrame) -> DataFrame:
    """Packets as bytes that don't depend on who wrote them, with their length and digest."""
    out = packets.withColumn("packet", canonical_json(F.col("packet")))
    return out.withColumns({"n_bytes": F.octet_length("packet").cast("long"), "packet_sha256": F.sha2("packet", 256)})
