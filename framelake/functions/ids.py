"""Deterministic ids and object keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(part) -> Column:
    c = part if isinstance(part, Column) else F.lit(part)
    return F.coalesce(c.cast("string"), F.lit("None"))


def deterministic_id(prefix: str, *parts) -> Column:
    """prefix_ and 16 hex digits of the SHA-1 of the parts joined by '::'; a null part reads None."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(F.concat_ws("::", *map(_text, parts))), 1, 16))


def person_track_id(job_id: Column, key: Column) -> Column:
    return F.concat(F.lit("person_track_"), F.substring(F.sha1(F.concat(job_id, F.lit(":"), key)), 1, 16))


def fallback_track_number(*parts) -> Column:
    """The first eight hex digits of the SHA-1 of the parts, as a number."""
    return F.conv(F.substring(F.sha1(F.concat_ws(":", *map(_text, parts))), 1, 8), 16, 10).cast("long")


def idempotency_key(job_id: Column, task: str = "scene_understanding", version: str = "v1") -> Column:
    return F.concat(job_id, F.lit(f":{task}:{version}"))


#: The folders of artifact kinds in object keys.
FRAME_KINDS = {"original": "original", "segmentation": "seg", "detection": "det", "face": "face"}
SCENE_KINDS = {"packet": "packets", "narrative": "narratives"}
CORPUS_KINDS = {"graph": "graph", "retrieval": "rag", "embeddings": "embeddings"}


def source_key(job_id: Column, extension: Column) -> Column:
    return F.concat(F.lit("jobs/"), job_id, F.lit("/input/source."), normalized_extension(extension))


def frame_key(job_id: Column, kind: str, frame_id: Column) -> Column:
    return F.concat(F.lit("jobs/"), job_id, F.lit(f"/frames/{FRAME_KINDS[kind]}/frame_"), frame_id.cast("string"), F.lit(".jpg"))


def analysis_key(job_id: Column, frame_id: Column) -> Column:
    return F.concat(F.lit("jobs/"), job_id, F.lit("/analysis/json/frame_"), frame_id.cast("string"), F.lit(".json"))


def scene_key(job_id: Column, kind: str, scene_id: Column) -> Column:
    return F.concat(F.lit("jobs/"), job_id, F.lit(f"/scene/{SCENE_KINDS[kind]}/scene_"), scene_id.cast("string"), F.lit(".json"))


def summary_key(job_id: Column) -> Column:
    return F.concat(F.lit("jobs/"), job_id, F.lit("/summary/synopsis.json"))


def corpus_key(job_id: Column, kind: str, filename: Column) -> Column:
    """A name without slashes and outer blanks; bundle.json for a null or blank one."""
    name = F.regexp_replace(F.regexp_replace(filename, r"^\s+|\s+$", ""), "/", "_")
    return F.concat(F.lit("jobs/"), job_id, F.lit(f"/corpus/{CORPUS_KINDS[kind]}/"), F.coalesce(F.nullif(name, F.lit("")), F.lit("bundle.json")))


def local_source_path(job_id: Column, extension: Column, root: str = "temp_media") -> Column:
    """Where an upload is staged before it is stored."""
    return F.concat(F.lit(f"{root}/"), job_id, F.lit("/input/source."), normalized_extension(extension))


def normalized_extension(extension: Column, default: str = "mp4") -> Column:
    """Lower case letters and digits only; the default if none are left."""
    plain = F.regexp_replace(F.lower(extension), r"[^\p{L}\p{N}]", "")
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit(default))


def source_extension(filename: Column) -> Column:
    return normalized_extension(F.regexp_extract(filename, r"\.([^./\\]*)$", 1))


#: Content types by extension.
CONTENT_TYPES = {"mp4": "video/mp4", "mov": "video/quicktime", "avi": "video/x-msvideo", "mkv": "video/x-matroska", "webm": "video/webm", "mpeg": "video/mpeg"}


def content_type(stated: Column, filename: Column) -> Column:
    """The stated type if it has a slash, else the extension's, else video/mp4."""
    known = F.create_map(*(F.lit(x) for kv in CONTENT_TYPES.items() for x in kv))
    return F.when(stated.contains("/"), stated).otherwise(F.coalesce(F.try_element_at(known, source_extension(filename)), F.lit("video/mp4")))
