"""Reading uploads, frame documents and stored objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.timecode import parse_timecode

MAX_UPLOAD = 500 << 20

#: A frame document as it is stored: nested, with everything optional.
FRAME = (
    "job_id string, frame_id long, timestamp string, files map<string,string>, "
    "analysis struct<object_detection:array<struct<track_id:string,label:string,confidence:double,box:array<long>>>,"
    "face_recognition:array<struct<face_id:long,identity_id:string,scene_person_id:string,video_person_id:string,confidence:double,match_confidence:double,coordinates:array<long>>>,"
    "semantic_segmentation:array<struct<object_id:long,class:string,mask_polygon:array<array<long>>>>>, "
    "analysis_artifacts map<string,string>"
)


def uploads(spark: SparkSession, path: str, most: int = MAX_UPLOAD) -> DataFrame:
    """Uploaded files of at most ``most`` bytes with a name; the size is checked before content is read."""
    files = spark.read.format("binaryFile").load(path)
    return files.where((F.col("length") <= most) & (F.length(F.element_at(F.split("path", "/"), -1)) > 0))


def rejected_uploads(spark: SparkSession, path: str, most: int = MAX_UPLOAD) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where(F.col("length") > most).select("path", "length", F.lit(413).alias("status"))


def upload_status(filename: Column, length: Column, most: int = MAX_UPLOAD) -> Column:
    """422 for an upload without a name, 413 for one that is too large, else 200."""
    return F.when(F.coalesce(F.length(filename), F.lit(0)) == 0, 422).when(length > most, 413).otherwise(200)


def objects(spark: SparkSession, path: str) -> DataFrame:
    """The keys of stored objects below a path, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("key"), "length", F.col("modificationTime").alias("modified_at"))


def frame_documents(spark: SparkSession, path: str) -> DataFrame:
    """Frame documents, one JSON object a line, with a fixed schema (no inference pass)."""
    return spark.read.schema(FRAME).json(path)


def _box(c: str) -> list:
    return [F.get(F.col(c), F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]


def detections(documents: DataFrame) -> DataFrame:
    rows = documents.select("job_id", "frame_id", parse_timecode(F.col("timestamp")).alias("ts_sec"), F.posexplode("analysis.object_detection").alias("i", "d"))
    return rows.select("job_id", "frame_id", "ts_sec", (F.col("i") + 1).cast("long").alias("det_index"), "d.track_id", "d.label", "d.confidence", *_box("d.box"))


def faces(documents: DataFrame) -> DataFrame:
    rows = documents.select("job_id", "frame_id", parse_timecode(F.col("timestamp")).alias("ts_sec"), F.explode("analysis.face_recognition").alias("f"))
    return rows.select("job_id", "frame_id", "ts_sec", "f.face_id", "f.identity_id", "f.scene_person_id", "f.video_person_id", "f.confidence", "f.match_confidence", *_box("f.coordinates"))


def segments(documents: DataFrame) -> DataFrame:
    rows = documents.select("job_id", "frame_id", parse_timecode(F.col("timestamp")).alias("ts_sec"), F.explode("analysis.semantic_segmentation").alias("s"))
    return rows.select("job_id", "frame_id", "ts_sec", "s.object_id", F.col("s.class").alias("class_name"))
