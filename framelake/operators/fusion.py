"""Fusing object tracks with face identities into person tracks.

Faces and detections carry job_id, frame_id, ts_sec and box columns x1 .. y2; all
keys lead with job_id, and every step is a join or an aggregation on such a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import ids
from framelake.functions.geometry import Box, affinity, area
from framelake.operators.firsts import first_k

AFFINITY = 0.45
TRACK = ["job_id", "track_id"]


def persons(detections: DataFrame) -> DataFrame:
    """Person detections with a box of positive extent; blank track ids are filled in."""
    own = detections.where((F.lower(F.trim("label")) == "person") & (area(Box.of()) > 0) & (F.col("x2") > F.col("x1")))
    filler = F.concat_ws("_", F.lit("person_track"), "frame_id", "det_index")
    return own.withColumn("track_id", F.coalesce(F.nullif(F.trim("track_id"), F.lit("")), filler))


def with_identity(faces: DataFrame) -> DataFrame:
    """Adds identity, identity_source and identity_conf; drops faces without an identity or a box.

    The first of video, scene and frame identity that isn't blank counts; a
    confidence of 0 counts as missing.
    """
    names = [(c, s) for c, s in (("video_person_id", "video_person_id"), ("scene_person_id", "scene_person_id"), ("identity_id", "identity_id")) if c in faces.columns]
    filled = [(F.nullif(F.trim(F.col(c)), F.lit("")), s) for c, s in names]
    source = F.coalesce(*(F.when(v.isNotNull(), F.lit(s)) for v, s in filled))
    conf = [F.nullif(F.col(c), F.lit(0.0)) for c in ("match_confidence", "confidence") if c in faces.columns]
    out = faces.withColumns({"identity": F.coalesce(*(v for v, _ in filled)), "identity_source": source, "identity_conf": F.coalesce(*conf, F.lit(0.0))})
    return out.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")) & F.col("identity").isNotNull())


def best_person(faces: DataFrame, people: DataFrame, least: float = AFFINITY) -> DataFrame:
    """Each face with the person of its frame that fits best, if well enough; ties go to the first.

    An equi-join on the frame, then max_by: partial aggregation, no sort of frames.
    """
    key = ["job_id", "frame_id", "face_id"]
    pairs = faces.alias("f").join(people.alias("p"), (F.col("f.job_id") == F.col("p.job_id")) & (F.col("f.frame_id") == F.col("p.frame_id")))
    score = affinity(Box.of("f"), Box.of("p"))
    pairs = pairs.select(*(F.col(f"f.{c}").alias(c) for c in key), F.col("p.track_id").alias("track_id"), F.col("p.det_index").alias("det_index"), score.alias("affinity"))
    best = pairs.groupBy(*key).agg(F.max_by(F.struct("track_id", "det_index", "affinity"), F.struct("affinity", -F.col("det_index"))).alias("best"))
    return best.select(*key, "best.*").where((F.col("affinity") > 0) & (F.col("affinity") >= least))


def identity_votes(matches: DataFrame) -> DataFrame:
    """(job_id, track_id, identity, count, conf_sum); matches carry identity and identity_conf."""
    return matches.groupBy(*TRACK, "identity").agg(F.count(F.lit(1)).alias("count"), F.sum("identity_conf").alias("conf_sum"))


def resolve_votes(votes: DataFrame) -> DataFrame:
    """The winner of each track's votes, whether it is ambiguous, accepted, and how sure.

    One window over a track's identities, ranked by count, mean confidence and name.
    """
    mean = F.col("conf_sum") / F.col("count")
    order = Window.partitionBy(*TRACK).orderBy(F.desc("count"), F.desc("mean"), "identity")
    ranked = votes.withColumn("mean", mean).withColumns(
        {"place": F.row_number().over(order), "next_count": F.lead("count").over(order), "next_mean": F.lead("mean").over(order), "total": F.sum("count").over(Window.partitionBy(*TRACK))}
    )
    close = F.coalesce((F.col("next_count") >= F.col("count")) & (F.col("next_mean") >= F.col("mean") - 0.05), F.lit(False))
    share = F.col("count") / F.col("total")
    strong = (share >= 0.6) | (F.col("count") >= 2) | (F.col("mean") >= 0.85)
    sure = F.round(F.least(F.lit(1.0), 0.5 * share + 0.5 * F.col("mean")), 4)
    top = ranked.where("place = 1").withColumns({"is_ambiguous": close, "accepted": ~close & strong})
    return top.select(*TRACK, F.when(F.col("accepted"), F.col("identity")).alias("identity_id"), F.when(F.col("accepted"), sure).alias("identity_confidence"), "is_ambiguous", "accepted")


def source_winner(matches: DataFrame) -> DataFrame:
    """The identity source that a track's faces name most often; ties go to the first name."""
    counts = matches.groupBy(*TRACK, "identity_source").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "identity_source"))
    return counts.groupBy(*TRACK).agg(best.alias("b")).select(*TRACK, F.col("b.identity_source").alias("identity_source"))


def resolved_tracks(people: DataFrame, matches: DataFrame) -> DataFrame:
    """Every person track with its resolved identity, if any, and the group it belongs to."""
    resolved = resolve_votes(identity_votes(matches)).join(source_winner(matches), TRACK, "left")
    tracks = people.select(*TRACK).distinct().join(resolved, TRACK, "left")
    tracks = tracks.withColumn("identity_source", F.when(F.col("accepted"), F.col("identity_source"))).fillna(False, ["is_ambiguous", "accepted"])
    group = F.when(F.col("identity_id").isNotNull(), F.concat(F.lit("identity::"), "identity_id")).otherwise(F.concat(F.lit("track::"), "track_id"))
    return tracks.withColumn("group_key", group)


def _evidence() -> Column:
    return F.struct("frame_id", "face_id", "track_id", "identity", "identity_source", "identity_conf", F.round("affinity", 4).alias("association_confidence"))


def track_timelines(people: DataFrame) -> DataFrame:
    """(job_id, track_id, frame_ids, timestamps): distinct frames and all timestamps of each track, ascending.

    A row is as long as its track; spans and counts, which aggregate before they
    are shuffled, come from ``fused_tracks``.
    """
    return people.groupBy(*TRACK).agg(F.array_sort(F.collect_set("frame_id")).alias("frame_ids"), F.array_sort(F.collect_list("ts_sec")).alias("timestamps"))


def fused_tracks(people: DataFrame, matches: DataFrame) -> DataFrame:
    """One row for each fused person: spans, member tracks, confidence and the first 25 pieces of evidence."""
    tracks = resolved_tracks(people, matches)
    member = tracks.select(*TRACK, "group_key")
    group = ["job_id", "group_key"]
    facts = tracks.groupBy(*group).agg(
        F.max("identity_id").alias("identity_id"),
        F.min_by("identity_source", "track_id").alias("identity_source"),
        F.round(F.avg("identity_confidence"), 4).alias("identity_confidence"),
        F.bool_or("is_ambiguous").alias("is_identity_ambiguous"),
        F.array_sort(F.collect_set("track_id")).alias("object_track_ids"),
    )
    spans = people.join(member, TRACK).groupBy(*group).agg(
        F.min("frame_id").alias("first_frame_id"), F.max("frame_id").alias("last_frame_id"), F.countDistinct("frame_id").alias("observation_count"),
        F.min("ts_sec").alias("first_seen"), F.max("ts_sec").alias("last_seen"),
    )
    proof = first_k(matches.join(member, TRACK), group, _evidence(), _evidence(), 25, "evidence")
    out = facts.join(spans, group).join(proof, group, "left")
    stable = F.when(F.col("identity_id").isNotNull(), F.concat(F.lit("identity::"), "identity_id")).otherwise(F.concat(F.lit("tracks::"), F.array_join("object_track_ids", ",")))
    out = out.withColumn("person_track_id", ids.person_track_id(F.col("job_id"), stable)).withColumn("duration_sec", F.col("last_seen") - F.col("first_seen"))
    none = F.array().cast(out.schema["evidence"].dataType)
    return out.withColumn("evidence", F.coalesce("evidence", none)).drop("group_key")


def annotated(detections: DataFrame, fused: DataFrame) -> DataFrame:
    """Detections with the fused track of their object track; others than persons get nulls."""
    by_track = fused.select("job_id", F.explode("object_track_ids").alias("track_id"), "person_track_id", F.col("identity_id").alias("person_identity_id"), F.col("identity_source").alias("person_identity_source"), F.col("identity_confidence").alias("person_identity_confidence"))
    by_track = by_track.withColumn("is_person", F.lit(True))
    own = detections.withColumn("is_person", F.lower(F.trim("label")) == "person")
    return own.join(by_track, ["job_id", "track_id", "is_person"], "left").drop("is_person")


def fuse(detections: DataFrame, faces: DataFrame) -> DataFrame:
    """The whole operator: matches, votes, fused tracks."""
    people, known = persons(detections), with_identity(faces)
    return fused_tracks(people, matched(people, known))


def matched(people: DataFrame, known: DataFrame) -> DataFrame:
    facts = known.select("job_id", "frame_id", "face_id", "identity", "identity_source", "identity_conf")
    return best_person(known, people).join(facts, ["job_id", "frame_id", "face_id"])
