"""The scene corpus: entities, events and relations with time spans and evidence, and retrieval chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import ids
from framelake.functions.timecode import format_timecode
from framelake.operators.firsts import first_k
from framelake.operators.scenes import SCENE
from framelake.shared import written


def _filled(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def _anchor(text: Column, box: bool) -> Column:
    corners = F.array("x1", "y1", "x2", "y2") if box else F.lit(None).cast("array<bigint>")
    return F.struct(F.col("frame_id"), format_timecode(F.col("ts_sec")).alias("timestamp"), ids.analysis_key(F.col("job_id"), F.col("frame_id")).alias("artifact_key"), corners.alias("bbox"), text.alias("text_span"))


def sightings(detections: DataFrame, faces: DataFrame) -> DataFrame:
    """One row for each detection and face in a scene, with the key of its entity.

    Input rows carry their scene's bounds. Objects are keyed by track, people by
    the first of video, scene and frame identity that isn't blank.
    """
    job, scene, frame = F.col("job_id"), F.col("scene_id"), F.col("frame_id")
    bounds = ["job_id", "scene_id", "start_sec", "end_sec", "frame_id", "ts_sec"]
    label = F.coalesce("label", F.lit("unknown"))
    track = F.coalesce(_filled("track_id"), ids.deterministic_id("track", job, scene, frame, label))
    seq = lambda branch, i: F.struct(F.col("ts_sec").alias("t"), F.col("frame_id").alias("f"), F.lit(branch).alias("b"), F.col(i).alias("i"))
    objects = detections.select(*bounds, F.lit("object").alias("entity_type"), track.alias("key"), label.alias("label"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), seq(0, "det_index").alias("seq"), _anchor(label, True).alias("evidence"))
    named = [_filled(c) for c in ("video_person_id", "scene_person_id", "identity_id") if c in faces.columns]
    person = F.coalesce(*named, ids.deterministic_id("identity", job, scene, frame, F.col("face_id")))
    sure = F.coalesce(F.col("confidence") if "confidence" in faces.columns else F.lit(None).cast("double"), F.lit(0.0))
    people = faces.select(*bounds, F.lit("person").alias("entity_type"), person.alias("key"), person.alias("label"), sure.alias("confidence"), seq(1, "face_id").alias("seq"), _anchor(person, True).alias("evidence"))
    return objects.unionByName(people)


def entities(seen: DataFrame) -> DataFrame:
    """One row for each entity of a scene; label and id come from its first sighting."""
    key = [*SCENE, "start_sec", "end_sec", "entity_type", "key"]
    proof = first_k(seen, key, F.struct("seq", "evidence"), F.col("evidence"), 5, "evidence")
    groups = seen.groupBy(*key).agg(
        F.min_by("label", "seq").alias("label"),
        F.count(F.lit(1)).alias("count"),
        F.avg("confidence").alias("confidence"),
        F.min("ts_sec").alias("first"),
        F.max("ts_sec").alias("last"),
    ).join(proof, key)
    first, last = F.greatest("start_sec", "first"), F.least("end_sec", "last")
    named = F.when(F.col("entity_type") == "object", F.col("label")).otherwise(F.lit("person"))
    entity_id = ids.deterministic_id("entity", F.col("job_id"), F.col("scene_id"), F.col("entity_type"), F.col("key"), named)
    return groups.select(
        *SCENE, "start_sec", "end_sec", entity_id.alias("entity_id"), "label", "entity_type", "count", "confidence",
        first.alias("first_seen"), last.alias("last_seen"), F.greatest(F.lit(0.0), last - first).alias("duration_sec"), "evidence",
        F.when(F.col("entity_type") == "object", F.col("key")).alias("track_id"), F.when(F.col("entity_type") == "person", F.col("key")).alias("identity_id"),
    )


def events(found: DataFrame) -> DataFrame:
    """One event for each entity; its duration is the entity's."""
    kind = F.concat("entity_type", F.lit("_observed"))
    event_id = ids.deterministic_id("event", F.col("job_id"), F.col("scene_id"), kind, F.col("entity_id"))
    return found.select(
        *SCENE, event_id.alias("event_id"), kind.alias("event_type"), "count", "confidence",
        F.greatest("start_sec", "first_seen").alias("first_seen"), F.least("end_sec", "last_seen").alias("last_seen"), "duration_sec", F.slice("evidence", 1, 3).alias("evidence"),
    )


def relations(seen: DataFrame, found: DataFrame) -> DataFrame:
    """Entities seen in the same frame, as pairs of ids in order; counts frames.

    Within a frame a self-join pairs its distinct entities, so rows grow with what
    single frames hold, not with scenes or jobs. Pairs are read twice, so written once.
    """
    key = F.coalesce("track_id", "identity_id")
    names = found.select(*SCENE, "entity_type", key.alias("key"), "entity_id")
    here = seen.join(names, [*SCENE, "entity_type", "key"]).select(*SCENE, "start_sec", "end_sec", "frame_id", "ts_sec", "entity_id").distinct()
    left, right = here.alias("a"), here.select("job_id", "scene_id", "frame_id", F.col("entity_id").alias("target_id")).alias("b")
    pairs = left.join(right, ["job_id", "scene_id", "frame_id"]).where("entity_id < target_id")
    anchor = F.struct("ts_sec", "frame_id", _anchor(F.lit("co_occurs_with"), False).alias("evidence"))
    pairs = written(pairs.withColumnsRenamed({"entity_id": "source_entity_id", "target_id": "target_entity_id"}), "corpus-pairs")
    key = [*SCENE, "start_sec", "end_sec", "source_entity_id", "target_entity_id"]
    proof = first_k(pairs, key, anchor, anchor["evidence"], 5, "evidence")
    groups = pairs.groupBy(*key).agg(
        F.count(F.lit(1)).alias("count"),
        F.min("ts_sec").alias("first"),
        F.max("ts_sec").alias("last"),
    ).join(proof, key)
    first, last = F.greatest("start_sec", "first"), F.least("end_sec", "last")
    relation_id = ids.deterministic_id("relation", F.col("job_id"), F.col("scene_id"), F.col("source_entity_id"), "co_occurs_with", F.col("target_entity_id"))
    return groups.select(
        *SCENE, relation_id.alias("relation_id"), "source_entity_id", "target_entity_id", F.lit("co_occurs_with").alias("predicate"), "count",
        F.least(F.lit(1.0), 0.2 + 0.2 * F.col("count")).alias("confidence"), first.alias("first_seen"), last.alias("last_seen"),
        F.greatest(F.lit(0.0), last - first).alias("duration_sec"), "evidence",
    )


def scene_chunks(scenes: DataFrame, found: DataFrame, happened: DataFrame | None = None) -> DataFrame:
    """One retrieval chunk for each scene from its entities by count and label, and their events."""
    order = F.struct((-F.col("count")).alias("n"), "label", "entity_id", F.concat("entity_type", F.lit("_observed")).alias("event_type"))
    listed = first_k(found, SCENE, order, order, 8, "e")
    rows = scenes.join(listed, SCENE, "left")
    names = lambda field, k: F.coalesce(F.nullif(F.array_join(F.transform(F.slice("e", 1, k), lambda x: x[field]), ", "), F.lit("")), F.lit("none"))
    text = F.concat(
        F.lit("Scene "), F.col("scene_id").cast("string"), F.format_string(" (%.2fs-%.2fs) entities: ", "start_sec", "end_sec"),
        names("label", 6), F.lit(". Events: "), names("event_type", 6), F.lit("."),
    )
    chunk_id = ids.deterministic_id("chunk", F.col("job_id"), F.col("scene_id"), F.col("text"))
    sources = F.coalesce(F.transform("e", lambda x: x["entity_id"]), F.array().cast("array<string>"))
    keys = F.array(ids.scene_key(F.col("job_id"), "packet", F.col("scene_id")))
    return rows.withColumn("text", text).select(*SCENE, chunk_id.alias("chunk_id"), "text", sources.alias("source_entity_ids"), keys.alias("artifact_keys"), "start_sec", "end_sec")


CHUNKS = "chunks"


def chunk_records(narratives: DataFrame) -> DataFrame:
    """Retrieval records of scenes (job_id, scene_id, start_sec, end_sec, narrative, chunks).

    ``chunks`` is an array of (chunk_id, text, artifact_keys, source_entity_ids).
    Chunks with blank text are dropped; a scene whose list is empty or null, not
    merely blank, gives its narrative instead, if that isn't blank.
    """
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    job, scene = F.col("job_id"), F.col("scene_id")
    listed = narratives.select(*SCENE, "start_sec", "end_sec", F.posexplode(CHUNKS).alias("pos", "c"))
    listed = listed.withColumn("text", strip(F.col("c.text"))).where("text <> ''")
    none = F.array().cast("array<string>")
    given = F.coalesce(F.nullif(F.col("c.chunk_id"), F.lit("")), ids.deterministic_id("chunk", job, scene, F.col("text")))
    listed = listed.select(*SCENE, "start_sec", "end_sec", "pos", given.alias("chunk_id"), "text", F.coalesce("c.artifact_keys", none).alias("artifact_keys"), F.coalesce("c.source_entity_ids", none).alias("source_entity_ids"))
    bare = narratives.where(F.coalesce(F.size(CHUNKS), F.lit(0)) <= 0).withColumn("text", strip(F.col("narrative"))).where("text <> ''")
    bare = bare.select(
        *SCENE, "start_sec", "end_sec", F.lit(0).alias("pos"), ids.deterministic_id("chunk", job, scene, F.col("text")).alias("chunk_id"), "text",
        F.array(ids.scene_key(job, "narrative", scene)).alias("artifact_keys"), F.lit(None).cast("array<string>").alias("source_entity_ids"),
    )
    return listed.unionByName(bare)


def dedupe_last_wins(rows: DataFrame, key: list[str], seq: list[str]) -> DataFrame:
    """Of rows with equal keys the last one by ``seq``, at the place (column ``first_seq``) of the first."""
    order = F.struct(*seq)
    groups = rows.groupBy(*key).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in key)), order).alias("last"), F.min(order).alias("first_seq"))
    return groups.select(*key, "last.*", "first_seq")


def frame_chunks(frames: DataFrame, detections: DataFrame, faces: DataFrame) -> DataFrame:
    """One chunk for each frame from its first six labels and four faces."""
    key = ["job_id", "frame_id"]
    first = lambda rows, i, v, k, name: rows.groupBy(*key).agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct(i, v))), 1, k), lambda x: x[v]), ", ").alias(name))
    out = frames.join(first(detections, "det_index", "label", 6, "labels"), key, "left").join(first(faces, "face_id", "identity_id", 4, "people"), key, "left")
    stamp = format_timecode(F.col("ts_sec"))
    text = F.concat(
        F.lit("Frame "), F.col("frame_id").cast("string"), F.lit(" at "), stamp, F.lit(" includes objects ["), F.coalesce(F.nullif("labels", F.lit("")), F.lit("no_objects")),
        F.lit("] and faces ["), F.coalesce(F.nullif("people", F.lit("")), F.lit("no_faces")), F.lit("]."),
    )
    out = out.withColumn("text", text).withColumn("timestamp", stamp)
    return out.select(*key, ids.deterministic_id("chunk", F.col("job_id"), F.col("frame_id"), F.col("text")).alias("chunk_id"), "text", "timestamp", F.array(ids.analysis_key(F.col("job_id"), F.col("frame_id"))).alias("artifact_keys"))


def retrieval_bundle(narratives: DataFrame, frames: DataFrame, detections: DataFrame, faces: DataFrame) -> DataFrame:
    """Scene chunks without repeats; frame chunks for jobs that have no scene chunk at all."""
    chunks = dedupe_last_wins(chunk_records(narratives), ["job_id", "chunk_id"], ["scene_id", "pos"])
    chunks = chunks.select("job_id", "chunk_id", "text", F.lit("scene").alias("kind"))
    bare = frames.join(chunks.select("job_id").distinct(), "job_id", "left_anti")
    rest = frame_chunks(bare, detections, faces).select("job_id", "chunk_id", "text", F.lit("frame").alias("kind"))
    return chunks.unionByName(rest.dropDuplicates(["job_id", "chunk_id"]))
