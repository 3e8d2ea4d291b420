"""Result views: defaults, signed URLs, required artifacts, nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import ids
from framelake.functions.timecode import format_timecode
from framelake.operators import sequences
from framelake.operators.firsts import first_k
from framelake.shared import written


def is_object_key(value: Column) -> Column:
    return F.coalesce(value.startswith("jobs/"), F.lit(False))


def signed(key: Column, base: str = "https://objects.example/", ttl: int = 3600) -> Column:
    """A repeatable read URL; stores with real signatures supply a function of their own."""
    if ttl <= 0:
        raise ValueError("the time to live of a URL must be positive")
    return F.concat(F.lit(base), key, F.lit(f"?exp={ttl}"))


def to_url(value: Column, sign=signed) -> Column:
    """Object keys signed; URLs and other texts unchanged; null is the empty string."""
    return F.when(value.isNull(), F.lit("")).when(is_object_key(value), sign(value)).otherwise(value)


def to_urls(files: Column, sign=signed) -> Column:
    """The values of a map signed, empty ones dropped; a null map is empty."""
    files = F.coalesce(files, F.create_map().cast("map<string,string>"))
    return F.map_filter(F.transform_values(files, lambda _, v: to_url(v, sign)), lambda _, v: v != "")


def overlaid(base: Column, top: Column) -> Column:
    """A map with the entries of both; those on top win, and a null map is empty."""
    none = F.create_map().cast("map<string,string>")
    base, top = F.coalesce(base, none), F.coalesce(top, none)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(top), k)), top)


def keyframe_results(found: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Results (job_id, frame_id, pos, result) of keyframes with their scenes; of repeated results the last one holds.

    Results of frames that are no keyframes, and keyframes without a result, are left out.
    """
    last = found.groupBy("job_id", "frame_id").agg(F.max_by("result", "pos").alias("result"))
    return keyframes.join(last, ["job_id", "frame_id"])


def with_track_defaults(items: DataFrame) -> DataFrame:
    """(job_id, frame_id, items: array of structs with track_id) exploded; missing ids count from the original place."""
    rows = items.select("job_id", "frame_id", F.posexplode("items").alias("i", "item")).where("item is not null")
    default = F.concat_ws("_", F.lit("track"), "frame_id", F.col("i") + 1)
    return rows.select("job_id", "frame_id", "i", F.col("item").withField("track_id", F.coalesce(F.nullif(F.col("item.track_id"), F.lit("")), default)).alias("item"))


def with_identity_defaults(items: DataFrame) -> DataFrame:
    """As above for faces: identity_id defaults to face_<place>."""
    rows = items.select("job_id", "frame_id", F.posexplode("items").alias("i", "item")).where("item is not null")
    default = F.concat(F.lit("face_"), F.col("i") + 1)
    return rows.select("job_id", "frame_id", "i", F.col("item").withField("identity_id", F.coalesce(F.nullif(F.col("item.identity_id"), F.lit("")), default)).alias("item"))


def required_keys(frames: DataFrame, scenes: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, key): every distinct object that must exist before a job is complete.

    frames has files (a map) and json_key; scenes has artifacts (a map); jobs has
    source_key, synopsis_key and artifacts (a map). Values that aren't keys are
    dropped, but for the source.
    """
    values = lambda rows, c: rows.select("job_id", F.explode(F.map_values(c)).alias("key"))
    found = values(frames, "files").unionByName(frames.select("job_id", F.col("json_key").alias("key"))).unionByName(values(scenes, "artifacts"))
    found = found.unionByName(jobs.select("job_id", F.col("synopsis_key").alias("key"))).unionByName(values(jobs, "artifacts")).where(is_object_key(F.col("key")))
    return found.unionByName(jobs.select("job_id", F.col("source_key").alias("key"))).distinct()


def missing_artifacts(required: DataFrame, existing: DataFrame) -> DataFrame:
    """(job_id, missing, sample) for jobs that lack objects; the sample is the first five keys."""
    gone = required.join(existing.select("key").distinct(), "key", "left_anti")
    sample = first_k(gone, ["job_id"], F.col("key"), F.col("key"), 5, "sample")
    return gone.groupBy("job_id").agg(F.count(F.lit(1)).alias("missing")).join(sample, "job_id")


def frame_files(job_id: Column, frame_id: Column, stored: bool = True) -> Column:
    """The frame's images by kind: object keys, or local paths without a store."""
    kinds = list(ids.FRAME_KINDS)
    if stored:
        values = [ids.frame_key(job_id, k, frame_id) for k in kinds]
    else:
        values = [F.concat(F.lit("/static/"), job_id, F.lit(f"/{ids.FRAME_KINDS[k]}/frame_"), frame_id.cast("string"), F.lit(".jpg")) for k in kinds]
    return F.create_map(*(x for k, v in zip(kinds, values) for x in (F.lit(k), v)))


#: The models every frame passes, with the thresholds recorded for them.
MODEL_THRESHOLDS = {"detector": 0.0, "segmenter": 0.0, "face_detector": 0.9}
ENRICHED = {
    "ocr_blocks": "array<struct<text:string,confidence:double,bbox:array<bigint>>>",
    "actions": "array<struct<label:string,confidence:double>>",
    "poses": "array<struct<track_id:string,confidence:double,keypoints:array<struct<x:double,y:double,confidence:double>>>>",
    "camera_motion": "struct<label:string,confidence:double>",
    "quality": "struct<blur_score:double,is_blurry:boolean,is_occluded:boolean>",
}


def grouped_kinds(frames: DataFrame, kinds: dict[str, tuple[DataFrame, Column, Column]], keys: list[str], facts: list[str]) -> DataFrame:
    """Each row of ``frames`` (keys, facts) with a list for each kind: (rows, order, value) by the same keys.

    All tables are one union that is grouped once, so there is one exchange however
    many kinds there are. Rows of keys that ``frames`` lacks are left out.
    """
    fact = F.struct(*facts, F.lit(True).alias("there")).alias("__frame")
    every = frames.select(*keys, fact)
    for name, (rows, order, value) in kinds.items():
        every = every.unionByName(rows.select(*keys, F.struct(order.alias("order"), value.alias("value")).alias(name)), allowMissingColumns=True)
    lists = [F.transform(F.array_sort(F.collect_list(name)), lambda x: x["value"]).alias(name) for name in kinds]
    out = every.groupBy(*keys).agg(F.first("__frame", ignorenulls=True).alias("__frame"), *lists)
    return out.where(F.col("__frame").isNotNull()).select(*keys, *(F.col(f"__frame.{c}") for c in facts), *kinds)


def frame_documents(frames: DataFrame, detections: DataFrame, faces: DataFrame, segments: DataFrame, enriched: DataFrame | None = None, models: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """One nested document for each frame, assembled from the flat tables at the result edge by one exchange.

    ``enriched`` has (job_id, frame_id) and the normalized columns of ENRICHED, one
    row a frame; ``models`` names (id, version) of models by component.
    """
    key = ["job_id", "frame_id"]
    job, frame = F.col("job_id"), F.col("frame_id")
    box = F.array("x1", "y1", "x2", "y2")
    kinds = {
        "object_detection": (detections, F.col("det_index"), F.struct("track_id", "label", "confidence", box.alias("box"))),
        "face_recognition": (faces, F.col("face_id"), F.struct("face_id", "identity_id", "video_person_id", "match_confidence", box.alias("coordinates"))),
        "semantic_segmentation": (segments, F.col("object_id"), F.struct("object_id", F.col("class_name").alias("class"))),
    }
    if enriched is not None:
        kinds["enriched"] = (enriched, F.lit(0), F.struct(*(F.col(c).cast(kind).alias(c) for c, kind in ENRICHED.items())))
    out = grouped_kinds(frames, kinds, key, ["ts_sec"])
    given = F.get("enriched", F.lit(0)) if enriched is not None else F.lit(None).cast(f"struct<{','.join(f'{c}:{k}' for c, k in ENRICHED.items())}>")
    part = lambda c: F.coalesce(given[c], F.array().cast(ENRICHED[c])) if ENRICHED[c].startswith("array") else given[c]
    out = out.withColumn("enrichment", F.struct(*(part(c).alias(c) for c in ENRICHED)))
    stamp, artifact = format_timecode(F.col("ts_sec")), ids.analysis_key(job, frame)
    anchor = lambda box, text: F.struct(frame.alias("frame_id"), stamp.alias("timestamp"), artifact.alias("artifact_key"), box.alias("bbox"), text.alias("text_span"))
    anchors = F.concat(
        F.transform("object_detection", lambda x: anchor(x["box"].cast("array<bigint>"), x["label"])),
        F.transform("face_recognition", lambda x: anchor(x["coordinates"].cast("array<bigint>"), x["identity_id"])),
        F.transform("enrichment.ocr_blocks", lambda x: anchor(x["bbox"], x["text"])),
    )
    provenance = F.struct(job.alias("job_id"), F.lit(None).cast("long").alias("scene_id"), frame.alias("frame_id"), stamp.alias("timestamp"), ids.frame_key(job, "original", frame).alias("source_artifact_key"))
    named = {c: (models or {}).get(c, ("unknown", "unknown")) for c in MODEL_THRESHOLDS} | {c: m for c, m in (models or {}).items() if c not in MODEL_THRESHOLDS}
    entries = [F.struct(F.lit(c).alias("component"), F.lit(m).alias("model_id"), F.lit(v or "unknown").alias("version"), F.lit(MODEL_THRESHOLDS.get(c)).cast("double").alias("threshold")) for c, (m, v) in named.items()]
    return out.select(
        *key,
        stamp.alias("timestamp"),
        to_urls(frame_files(job, frame)).alias("files"),
        F.struct("semantic_segmentation", "object_detection", "face_recognition", "enrichment").alias("analysis"),
        F.struct(to_url(artifact).alias("json")).alias("analysis_artifacts"),
        F.struct(provenance.alias("provenance"), F.array(*entries).alias("model_provenance"), anchors.alias("evidence_anchors")).alias("metadata"),
    )


def result_view(documents: DataFrame, narratives: DataFrame, synopses: DataFrame, job_id: str | None = None) -> DataFrame:
    """One row for each job: frames, narratives and synopsis; one job only if given (a pruned read)."""
    pick = lambda df: df if job_id is None else df.where(F.col("job_id") == job_id)
    d = pick(documents).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("frame_id", "timestamp"))).alias("frames"))
    n = pick(narratives).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("start_sec", "scene_id", "narrative"))).alias("scene_narratives"))
    out = d.join(n, "job_id", "left").join(pick(synopses).select("job_id", "synopsis"), "job_id", "left")
    return out.withColumn("scene_narratives", F.coalesce("scene_narratives", F.array().cast(out.schema["scene_narratives"].dataType)))


def job_status(states: DataFrame, job_id: str | None = None) -> DataFrame:
    """(job_id, status, error) of all jobs, or of one; no row for a job that isn't known."""
    rows = states if job_id is None else states.where(F.col("job_id") == job_id)
    return rows.select("job_id", "status", "error")


def readable_results(states: DataFrame, view: DataFrame, job_id: str | None = None) -> DataFrame:
    """The view's rows with a code: 200 for completed jobs; others have 409, what they wait for or died of, and no results."""
    jobs = job_status(states, job_id)
    done = F.col("status") == "completed"
    detail = F.when(F.col("status") == "processing", "Job is still processing").when(~done, "Job failed")
    error = F.when(F.col("status") == "failed", F.coalesce("error", F.lit("Unknown error")))
    coded = jobs.select("job_id", F.when(done, 200).otherwise(409).alias("code"), detail.alias("detail"), error.alias("error"))
    return coded.where("code = 200").join(view, "job_id", "left").unionByName(coded.where("code <> 200"), allowMissingColumns=True)


def document_rules() -> dict[str, Column]:
    """What is wrong with a frame's document, as rules of its columns."""
    flat = lambda b: (F.size(b) != 4) | (b[0] >= b[2]) | (b[1] >= b[3])
    faces, seen = F.col("analysis.face_recognition"), F.col("analysis.object_detection")
    ids_of = F.transform(faces, lambda x: x["face_id"])
    anchored = F.size(seen) + F.size(faces) + F.size("analysis.enrichment.ocr_blocks")
    outside = lambda c: F.coalesce((c < 0) | (c > 1), F.lit(False))
    return {
        "no timestamp": F.coalesce(F.length("timestamp"), F.lit(0)) == 0,
        "no JSON object": F.coalesce(F.length("analysis_artifacts.json"), F.lit(0)) == 0,
        "empty box": F.exists(seen, lambda x: flat(x["box"])),
        "empty face box": F.exists(faces, lambda x: flat(x["coordinates"])),
        "confidence out of range": F.exists(seen, lambda x: outside(x["confidence"])),
        "repeated face": F.size(F.array_distinct(ids_of)) != F.size(ids_of),
        "anchors missing": F.size("metadata.evidence_anchors") != anchored,
    }


def pages(items: DataFrame, most_bytes: int = 1 << 20) -> DataFrame:
    """(job_id, page, next_page, n_items, bytes, items) of items (job_id, kind, pos, body), in order of kind and pos.

    kind and pos name an item of a job; pos is anything that sorts. A page has the
    items whose first byte lies in its window of half of ``most_bytes``, so with
    items of at most half a page no page is above ``most_bytes``; a longer item is
    at most half a page less than its page. Where windows are is a running sum
    over ranges of all items, so no task or row holds a job. Pages count from 0
    without gaps, and next_page is null for a job's last one.
    """
    window = max(1, most_bytes // 2)
    sized = items.select("job_id", "kind", "pos", "body", F.octet_length("body").cast("long").alias("size"))
    ranges = sequences.in_ranges(sized, ["job_id"], ["kind", "pos"])
    upto = sequences.running(ranges, ["job_id"], ["kind", "pos"], F.col("size"), "upto")
    cut = upto.withColumn("window", F.floor((F.col("upto") - F.col("size")) / window))
    listed = F.array_sort(F.collect_list(F.struct("kind", "pos", "body")))
    made = written(cut.groupBy("job_id", "window").agg(F.count(F.lit(1)).alias("n_items"), F.sum("size").alias("bytes"), listed.alias("items")), "pages")
    in_order = Window.partitionBy("job_id").orderBy("window")
    numbers = made.select("job_id", "window", (F.row_number().over(in_order) - 1).cast("long").alias("page"), F.lead("window").over(in_order).isNotNull().alias("more"))
    following = F.when(F.col("more"), F.col("page") + 1).alias("next_page")
    return made.join(numbers, ["job_id", "window"]).select("job_id", "page", following, "n_items", "bytes", "items")


def page(paged: DataFrame, job_id: str, token: int | None = None) -> DataFrame:
    """One page of a job: its first, or that which a page before named as next; a read that prunes."""
    return paged.where((F.col("job_id") == job_id) & (F.col("page") == (token or 0)))


def page_summary(paged: DataFrame) -> DataFrame:
    """(job_id, n_pages, n_items, bytes, kinds: items of each kind) for the head of a job's results."""
    kinds = paged.select("job_id", F.explode("items.kind").alias("kind")).groupBy("job_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    by_kind = kinds.groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    sums = paged.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("n_items").alias("n_items"), F.sum("bytes").alias("bytes"))
    return sums.join(by_kind, "job_id")
