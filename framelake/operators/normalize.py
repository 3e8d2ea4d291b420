"""Normalizing what models return: nested arrays with missing or wrong parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.geometry import palette, round_coord

#: Enrichment as models may return it; text that doesn't fit becomes null.
RAW = (
    "ocr_blocks array<struct<text:string,confidence:double,bbox:array<double>,box:array<double>>>, "
    "actions array<struct<label:string,confidence:double>>, "
    "poses array<struct<track_id:string,confidence:double,keypoints:array<struct<x:double,y:double,confidence:double>>>>, "
    "camera_motion struct<label:string,confidence:double>, "
    "quality struct<blur_score:double,is_blurry:boolean,is_occluded:boolean>"
)


def _items(c: str, f) -> Column:
    return F.transform(F.filter(F.coalesce(F.col(c), F.array().cast("array<void>")), lambda x: x.isNotNull()), f)


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _four(box: Column) -> Column:
    return F.coalesce(F.transform(F.when(F.size(box) == 4, box), round_coord), F.array(*[F.lit(0).cast("long")] * 4))


def _or_default(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def ocr_blocks(c: str) -> Column:
    box = lambda x: _four(F.when(F.size(x["bbox"]) > 0, x["bbox"]).otherwise(x["box"]))
    text = lambda x: F.regexp_replace(F.coalesce(x["text"], F.lit("")), r"^\s+|\s+$", "")
    return _items(c, lambda x: F.struct(text(x).alias("text"), _zero(x["confidence"]).alias("confidence"), box(x).alias("bbox")))


def actions(c: str) -> Column:
    return _items(c, lambda x: F.struct(F.coalesce(x["label"], F.lit("unknown")).alias("label"), _zero(x["confidence"]).alias("confidence")))


def poses(c: str) -> Column:
    points = lambda x: F.transform(F.filter(F.coalesce(x["keypoints"], F.array().cast("array<struct<x:double,y:double,confidence:double>>")), lambda k: k.isNotNull()), lambda k: F.struct(_zero(k["x"]).alias("x"), _zero(k["y"]).alias("y"), _zero(k["confidence"]).alias("confidence")))
    return _items(c, lambda x: F.struct(_or_default(x["track_id"], "unknown_track").alias("track_id"), _zero(x["confidence"]).alias("confidence"), points(x).alias("keypoints")))


def camera_motion(c: str) -> Column:
    x = F.col(c)
    return F.when(x.isNotNull(), F.struct(F.coalesce(x["label"], F.lit("static")).alias("label"), _zero(x["confidence"]).alias("confidence")))


def enrichment(rows: DataFrame, json_col: str = "enrichment") -> DataFrame:
    """Parses and normalizes the enrichment of each row; what is missing is empty or null."""
    raw = rows.withColumn("raw", F.from_json(F.col(json_col), f"struct<{', '.join(p.replace(' ', ':', 1) for p in _fields())}>"))
    raw = raw.select("*", *(F.col(f"raw.{p.split(' ', 1)[0]}").alias(f"raw_{p.split(' ', 1)[0]}") for p in _fields()))
    out = raw.withColumns({"ocr_blocks": ocr_blocks("raw_ocr_blocks"), "actions": actions("raw_actions"), "poses": poses("raw_poses"), "camera_motion": camera_motion("raw_camera_motion"), "quality": F.col("raw_quality")})
    return out.drop("raw", *(c for c in out.columns if c.startswith("raw_")))


def _fields() -> list[str]:
    out, depth, at = [], 0, 0
    for i, ch in enumerate(RAW):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(RAW[at:i].strip())
            at = i + 1
    return [*out, RAW[at:].strip()]


def kept_faces(raw: DataFrame, least: float = 0.9) -> DataFrame:
    """(job_id, frame_id, probs, boxes) to one row for each face sure enough, numbered after the cut."""
    both = F.filter(F.arrays_zip("probs", "boxes"), lambda x: (x["probs"] >= least) & x["boxes"].isNotNull())
    rows = raw.select("job_id", "frame_id", F.posexplode(both).alias("i", "x"))
    return rows.select("job_id", "frame_id", (F.col("i") + 1).alias("face_id"), F.col("x.probs").alias("confidence"), F.transform("x.boxes", round_coord).alias("coordinates"))


def named(class_id: Column, names: Column) -> Column:
    """The name of a class in a map, else its number."""
    return F.coalesce(F.try_element_at(names, class_id), class_id.cast("string"))


def segmentations(raw: DataFrame) -> DataFrame:
    """(job_id, frame_id, polygons, class_ids, names) to segments numbered from 1; the shorter list counts."""
    n = F.least(F.size("polygons"), F.size("class_ids"))
    both = F.when(n > 0, F.slice(F.arrays_zip("polygons", "class_ids"), 1, n)).otherwise(F.array().cast("array<struct<polygons:array<array<double>>,class_ids:int>>"))
    rows = raw.select("job_id", "frame_id", "names", F.posexplode(both).alias("i", "x"))
    polygon = F.transform("x.polygons", lambda p: F.transform(p, round_coord))
    return rows.select("job_id", "frame_id", (F.col("i") + 1).alias("object_id"), named(F.col("x.class_ids"), F.col("names")).alias("class_name"), polygon.alias("mask_polygon"), palette(F.col("i")).alias("color"))


def detections(raw: DataFrame) -> DataFrame:
    """(job_id, frame_id, boxes, class_ids, confs, box_ids, names) to one row for each detection."""
    zipped = F.arrays_zip("boxes", "class_ids", "confs", F.coalesce("box_ids", F.array().cast("array<double>")).alias("box_ids"))
    rows = raw.select("job_id", "frame_id", "names", F.posexplode(F.slice(zipped, 1, F.greatest(F.size("boxes"), F.lit(0)))).alias("i", "x"))
    return rows.select("job_id", "frame_id", F.col("i").alias("index"), named(F.col("x.class_ids"), F.col("names")).alias("label"), F.col("x.confs").alias("confidence"), F.transform("x.boxes", round_coord).alias("box"), F.col("x.box_ids").alias("box_id"))


#: The thresholds recorded for each component.
THRESHOLDS = {"segmentation": 0.0, "detection": 0.0, "face": 0.9, "enrichment": None}


def model_provenance(frames: DataFrame, models: dict[str, tuple[str, str]]) -> DataFrame:
    """A row for each frame and component (name to model id and version): an explode of a literal array, no join."""
    rows = [F.struct(F.lit(c).alias("component"), F.lit(m).alias("model_id"), F.lit(v or "unknown").alias("version"), F.lit(THRESHOLDS.get(c)).cast("double").alias("threshold")) for c, (m, v) in models.items()]
    return frames.select("job_id", "frame_id", F.explode(F.array(*rows)).alias("p")).select("job_id", "frame_id", "p.*")
