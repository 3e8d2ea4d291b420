"""Face identities: clusters within a scene, stitched over a job.

Clustering is greedy with online centroids and so depends on order: each task
sorts its scenes and takes them one after the other. Embeddings go to Python
once; only a scene's centroids go on to the stitching of its job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.operators.ordered import groups_of, whole_groups

#: Least similarity and margin within a scene and over a video.
SCENE_SIMILARITY, SCENE_MARGIN = 0.68, 0.03
VIDEO_SIMILARITY, VIDEO_MARGIN = 0.74, 0.03
FACE = ["job_id", "scene_id", "frame_id", "face_id", "source"]


def unit(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, dtype=np.float32)
    norm = float(np.linalg.norm(v))
    return v if norm <= 1e-12 else v / norm


class Clusters:
    """Centroids in the order they were opened."""

    def __init__(self, least: float, margin: float):
        self.least, self.margin, self.counts = least, margin, []
        self.rows = np.zeros((0, 0), np.float32)

    @property
    def centroids(self) -> np.ndarray:
        return self.rows[: len(self.counts)]

    def _open(self, v: np.ndarray) -> None:
        n = len(self.counts)
        if n == len(self.rows):
            more = np.zeros((max(8, n), len(v)), np.float32)
            self.rows = np.concatenate([self.rows, more]) if n else more
        self.rows[n] = v
        self.counts.append(1)

    def add(self, v: np.ndarray) -> tuple[int, float, bool]:
        """(cluster, confidence, ambiguous); an ambiguous match opens a new cluster."""
        best, top, second = -1, 0.0, 0.0
        if self.counts:
            sims = self.centroids @ v
            best = int(sims.argmax())
            top = float(sims[best])
            if len(sims) > 1:
                sims[best] = -np.inf
                second = float(sims.max())
        close = best >= 0 and top >= self.least
        ambiguous = close and top - second <= self.margin
        if close and not ambiguous:
            n = self.counts[best]
            self.rows[best] = unit((self.rows[best] * n + v) / (n + 1))
            self.counts[best] += 1
            return best, top, False
        self._open(v)
        return len(self.counts) - 1, 1.0, bool(ambiguous)


def _vectors(column: pa.ChunkedArray) -> list[np.ndarray]:
    column = column.combine_chunks()
    flat, ends = column.flatten().to_numpy(), column.value_lengths().to_numpy().cumsum()
    return np.split(flat, ends[:-1]) if len(column) else []


def scene_identities(observations: DataFrame, least: float = SCENE_SIMILARITY, margin: float = SCENE_MARGIN) -> DataFrame:
    """(job, scene, frame, face, source, scene_person_id, match_confidence, is_identity_ambiguous, cluster_size, centroid).

    The last two are set in the first row of each cluster: its faces and its
    centroid after all of them. Scenes stream through their tasks in order; a task
    holds one scene's clusters and verdicts. Rows without an embedding are left out.
    """
    rows = observations.select(*FACE, F.col("embedding").cast("array<float>").alias("embedding")).where("embedding is not null")
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("embedding").schema)

    def scene(t: pa.Table) -> pa.Table:
        clusters = Clusters(least, margin)
        found = [clusters.add(unit(v)) for v in _vectors(t.column("embedding"))]
        name = f"scene_{t.column('scene_id')[0].as_py()}_person_"
        seen: set[int] = set()
        first = [c if c not in seen and not seen.add(c) else None for c, _, _ in found]
        out = t.drop_columns(["embedding"])
        out = out.append_column("scene_person_id", pa.array([f"{name}{c + 1}" for c, _, _ in found], pa.string()))
        out = out.append_column("match_confidence", pa.array([s for _, s, _ in found], pa.float64()))
        out = out.append_column("is_identity_ambiguous", pa.array([x for _, _, x in found], pa.bool_()))
        out = out.append_column("cluster_size", pa.array([None if c is None else clusters.counts[c] for c in first], pa.int64()))
        return out.append_column("centroid", pa.array([None if c is None else clusters.rows[c] for c in first], pa.list_(pa.float32())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["job_id", "scene_id"]):
            yield from pa.concat_tables([scene(g) for g in groups_of(t, ["job_id", "scene_id"])]).combine_chunks().to_batches()

    dealt = rows.repartition("job_id", "scene_id").sortWithinPartitions("job_id", "scene_id", "frame_id", "face_id", "source")
    return dealt.mapInArrow(run, f"{keys}, scene_person_id string, match_confidence double, is_identity_ambiguous boolean, cluster_size long, centroid array<float>")


def scene_clusters(assigned: DataFrame) -> DataFrame:
    """(job, scene, scene_person_id, count, centroid): the centroids after all their faces."""
    return assigned.where("centroid is not null").select("job_id", "scene_id", "scene_person_id", F.col("cluster_size").alias("count"), "centroid")


def video_identities(clusters: DataFrame, least: float = VIDEO_SIMILARITY, margin: float = VIDEO_MARGIN) -> DataFrame:
    """(job, scene, scene_person_id, video_person_id, video_confidence, is_video_ambiguous), by scene and name order.

    Jobs stream through their tasks; a task holds the centroids of one job's people.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, stitched = None, None
        for b in batches:
            found = []
            for name, v in zip(b.column(0).to_pylist(), _vectors(pa.chunked_array([b.column(3)]))):
                if stitched is None or name != job:
                    job, stitched = name, Clusters(least, margin)
                found.append(stitched.add(v))
            people = pa.array([f"video_person_{c + 1}" for c, _, _ in found], pa.string())
            columns = [*b.columns[:3], people, pa.array([s for _, s, _ in found], pa.float64()), pa.array([x for _, _, x in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["job_id", "scene_id", "scene_person_id", "video_person_id", "video_confidence", "is_video_ambiguous"])

    rows = clusters.select("job_id", "scene_id", "scene_person_id", F.col("centroid").cast("array<float>"))
    dealt = rows.repartition("job_id").sortWithinPartitions("job_id", "scene_id", "scene_person_id")
    return dealt.mapInArrow(run, "job_id string, scene_id long, scene_person_id string, video_person_id string, video_confidence double, is_video_ambiguous boolean")


def annotated_faces(faces: DataFrame, assigned: DataFrame, stitched: DataFrame, model_id: str = "embedding") -> DataFrame:
    """Faces with scene and video identity; the video one wins, confidences by the larger, ambiguity by either."""
    own = assigned.drop("cluster_size", "centroid").withColumnRenamed("match_confidence", "scene_confidence")
    key = [c for c in FACE if c in faces.columns]
    dropped = faces.drop("video_person_id", "scene_person_id", "match_confidence", "is_identity_ambiguous")
    out = dropped.join(own, key, "left").join(stitched, ["job_id", "scene_id", "scene_person_id"], "left")
    old = F.col("identity_id") if "identity_id" in faces.columns else F.lit(None).cast("string")
    return out.withColumns(
        {
            "identity_id": F.coalesce("video_person_id", "scene_person_id", old),
            "match_confidence": F.greatest("scene_confidence", "video_confidence"),
            "is_identity_ambiguous": F.coalesce("is_identity_ambiguous", F.lit(False)) | F.coalesce("is_video_ambiguous", F.lit(False)),
            "identity_model_id": F.lit(model_id),
        }
    ).drop("scene_confidence", "video_confidence", "is_video_ambiguous")


def identify(faces: DataFrame, keyframe: DataFrame, tracking: DataFrame | None = None, model_id: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """The whole operator: (annotated faces, video summary).

    Observations of keyframes and of tracking samples are clustered together; the
    source is part of their key, as both may use the same frame numbers.
    """
    seen = keyframe.withColumn("source", F.lit("keyframe"))
    if tracking is not None:
        seen = seen.unionByName(tracking.withColumn("source", F.lit("tracking")), allowMissingColumns=True)
    assigned = scene_identities(seen)
    stitched = video_identities(scene_clusters(assigned))
    return annotated_faces(faces.withColumn("source", F.lit("keyframe")), assigned, stitched, model_id), video_summary(stitched)


def crop_box(box, width, height):
    """A box clamped to an image; null if nothing is left of it."""
    x1, y1 = F.greatest(F.lit(0), box.x1), F.greatest(F.lit(0), box.y1)
    x2, y2 = F.least(width, box.x2), F.least(height, box.y2)
    return F.when((x2 > x1) & (y2 > y1), F.array(x1, y1, x2, y2))


def scene_summary(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("job_id", "scene_id").agg(F.countDistinct("scene_person_id").alias("clusters"), F.count(F.lit(1)).alias("faces"))


def video_summary(stitched: DataFrame) -> DataFrame:
    members = F.array_sort(F.collect_set("scene_person_id"))
    return stitched.groupBy("job_id", "video_person_id").agg(F.count(F.lit(1)).alias("cluster_size"), members.alias("scene_person_ids"))


def fallback_embedding(crop: bytes, dim: int = 512) -> np.ndarray:
    """A repeatable unit vector from the bytes of a crop, for when no model is there."""
    seed = int.from_bytes(hashlib.sha1(crop).digest()[:8], "big")
    return unit(np.random.default_rng(seed).standard_normal(max(16, dim)).astype(np.float32))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed_crops(crops: pd.Series) -> pd.Series:
    """The fallback for a column of image bytes; an empty crop gives zeros."""
    return crops.map(lambda b: fallback_embedding(b).tolist() if b else [0.0] * 512)


def similarity(a, b):
    """Cosine of two unit vectors of array columns; 0 if one is empty."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.aggregate(products, F.lit(0.0), lambda s, v: s + v)).otherwise(F.lit(0.0))
