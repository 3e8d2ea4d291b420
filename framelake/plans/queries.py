"""Queries over the derived media tables, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions import geometry, ids, timecode
from framelake.operators import contracts, corpus, evidence, fusion, identity, intervals, jobs, narrative, normalize, plugins, results, retention, scenes, tasklog, tracking
from framelake.sources import checked, ingest, sinks
from framelake.shared import scratch, written
from framelake.sources.media import MEDIA_SQL, Media

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, media: bool = True, recursive: bool = False):
    """Registers a query of (Media) under its function's name."""

    def add(f: Callable[[Media], DataFrame]) -> Callable[[Media], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Media(spark, sf_dir))
        if sql:
            head = f"with {'recursive ' * recursive}{MEDIA_SQL}" if media else ""
            ORACLE_SQL[f.__name__] = head + sql
        return f

    return add


def _area(b: str) -> str:
    return f"(greatest(0, {b}.x2 - {b}.x1) * greatest(0, {b}.y2 - {b}.y1))"


def _inter(a: str, b: str) -> str:
    return f"(greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"


def _iou(a: str, b: str) -> str:
    return f"(case when {_inter(a, b)} > 0 then cast({_inter(a, b)} as double) / ({_area(a)} + {_area(b)} - {_inter(a, b)}) else 0.0::double end)"


def _inside(a: str, b: str) -> str:
    return f"(case when ({a}.x1 + {a}.x2) / 2.0 between {b}.x1 and {b}.x2 and ({a}.y1 + {a}.y2) / 2.0 between {b}.y1 and {b}.y2 then 1.0::double else 0.0::double end)"


AFFINITY_SQL = f"(0.55::double * (cast({_inter('f', 'p')} as double) / {_area('f')}) + 0.35::double * {_inside('f', 'p')} + 0.10::double * {_iou('f', 'p')})"


def _id(prefix: str, *parts: str) -> str:
    return f"concat('{prefix}_', substr(sha1(concat_ws('::', {', '.join(parts)})), 1, 16))"


MATCH_SQL = f""",
known as (select *, coalesce(video_person_id, identity_id) as identity,
                 case when video_person_id is not null then 'video_person_id' else 'identity_id' end as identity_source from media_faces),
pairs as (select f.job_id, f.frame_id, f.face_id, p.track_id, p.det_index, {AFFINITY_SQL} as affinity
          from media_faces f join media_detections p on f.job_id = p.job_id and f.frame_id = p.frame_id and p.label = 'person'),
best as (select * from (select *, row_number() over (partition by job_id, frame_id, face_id order by affinity desc, det_index) as rn from pairs) where rn = 1 and affinity >= 0.45),
matches as (select b.job_id, b.frame_id, b.face_id, b.track_id, b.det_index, b.affinity, k.identity, k.identity_source, k.match_confidence as conf
            from best b join known k on b.job_id = k.job_id and b.frame_id = k.frame_id and b.face_id = k.face_id),
votes as (select job_id, track_id, identity, count(*) as n, sum(conf) as conf_sum from matches group by all),
ranked as (select *, conf_sum / n as mean, row_number() over w as place, lead(n) over w as next_n, lead(conf_sum / n) over w as next_mean, sum(n) over (partition by job_id, track_id) as total
           from votes window w as (partition by job_id, track_id order by n desc, conf_sum / n desc, identity)),
top as (select *, coalesce(next_n >= n and next_mean >= mean - 0.05::double, false) as amb,
               n / total >= 0.6::double or n >= 2 or mean >= 0.85::double as strong from ranked where place = 1),
resolved as (select job_id, track_id, case when strong and not amb then identity end as identity_id,
                    case when strong and not amb then round(least(1.0::double, 0.5::double * (n / total) + 0.5::double * mean), 4) end as identity_confidence,
                    amb as is_ambiguous, strong and not amb as accepted from top),
sources as (select job_id, track_id, arg_min(identity_source, (-n, identity_source)) as identity_source
            from (select job_id, track_id, identity_source, count(*) as n from matches group by all) group by all),
people as (select * from media_detections where label = 'person'),
tracks as (select t.job_id, t.track_id, r.identity_id, r.identity_confidence, coalesce(r.is_ambiguous, false) as is_ambiguous,
                  case when r.accepted then s.identity_source end as identity_source,
                  coalesce('identity::' || r.identity_id, 'track::' || t.track_id) as group_key
           from (select distinct job_id, track_id from people) t left join resolved r using (job_id, track_id) left join sources s using (job_id, track_id)),
facts as (select job_id, group_key, max(identity_id) as identity_id, arg_min_null(identity_source, track_id) as identity_source, round(avg(identity_confidence), 4) as identity_confidence,
                 bool_or(is_ambiguous) as is_identity_ambiguous, string_agg(track_id, ',' order by track_id) as object_track_ids from tracks group by all),
spans as (select t.job_id, t.group_key, min(frame_id) as first_frame_id, max(frame_id) as last_frame_id, count(distinct frame_id) as observation_count, min(ts_sec) as first_seen, max(ts_sec) as last_seen
          from people p join tracks t using (job_id, track_id) group by all),
proof as (select t.job_id, t.group_key, count(*) as n from matches m join tracks t using (job_id, track_id) group by all),
fused as (select f.*, first_frame_id, last_frame_id, observation_count, first_seen, last_seen, last_seen - first_seen as duration_sec, least(25, coalesce(n, 0)) as n_evidence,
                 concat('person_track_', substr(sha1(concat(job_id, ':', coalesce('identity::' || identity_id, 'tracks::' || object_track_ids))), 1, 16)) as person_track_id
          from facts f join spans using (job_id, group_key) left join proof using (job_id, group_key))
"""


@query(MATCH_SQL + "select job_id, frame_id, face_id, track_id, det_index, round(affinity, 4) as affinity from best")
def face_person_affinity(m: Media) -> DataFrame:
    best = fusion.best_person(m.faces, fusion.persons(m.detections))
    return best.withColumn("affinity", F.round("affinity", 4))


@query(f"select a.job_id, a.frame_id, a.det_index as a, b.det_index as b, round({_iou('a', 'b')}, 6) as iou from media_detections a join media_detections b on a.job_id = b.job_id and a.frame_id = b.frame_id and a.det_index < b.det_index where {_iou('a', 'b')} > 0")
def box_iou_pairs(m: Media) -> DataFrame:
    a, b = m.detections.alias("a"), m.detections.alias("b")
    on = (F.col("a.job_id") == F.col("b.job_id")) & (F.col("a.frame_id") == F.col("b.frame_id")) & (F.col("a.det_index") < F.col("b.det_index"))
    iou = geometry.iou(geometry.Box.of("a"), geometry.Box.of("b"))
    return a.join(b, on).select("a.job_id", "a.frame_id", F.col("a.det_index").alias("a"), F.col("b.det_index").alias("b"), F.round(iou, 6).alias("iou")).where("iou > 0")


@query("select f.job_id, s.scene_id, f.frame_id from media_frames f join media_scenes s on f.job_id = s.job_id and f.ts_sec between s.start_sec + 5 and s.end_sec + 5")
def scene_frame_membership(m: Media) -> DataFrame:
    # Bounds that fall on frames, so that a boundary frame is in two scenes.
    shifted = m.scenes.withColumns({"start_sec": F.col("start_sec") + 5, "end_sec": F.col("end_sec") + 5})
    return scenes.in_scenes(m.frames, shifted).select("job_id", "scene_id", "frame_id")


@query("select f.job_id, s.scene_id, f.frame_id, f.ts_sec - s.start_sec as into_sec from media_frames f join media_scenes s on f.job_id = s.job_id and f.ts_sec between s.start_sec and s.end_sec + 300")
def overlapping_scene_frames(m: Media) -> DataFrame:
    # Scenes that last five minutes longer overlap, so that a frame is in several.
    longer = m.scenes.withColumn("end_sec", F.col("end_sec") + 300)
    return intervals.in_intervals(m.frames, longer).select("job_id", "scene_id", "frame_id", (F.col("ts_sec") - F.col("start_sec")).alias("into_sec"))


PACKET_SQL = """,
seen as (select job_id, scene_id, label as name, 'object' as entity_type from media_detections
         union all select job_id, scene_id, class_name, 'object' from media_segments
         union all select job_id, scene_id, 'face', 'human' from media_faces),
counted as (select job_id, scene_id, name, entity_type, count(*) as n from seen group by all),
ranked as (select *, row_number() over (partition by job_id, scene_id order by n desc, name) as rank from counted),
entities as (select * from ranked where rank <= {k}),
totals as (select job_id, scene_id, cast(sum(case when entity_type = 'object' then n else 0 end) as bigint) as objects_total,
                  cast(sum(case when name = 'face' then n else 0 end) as bigint) as faces_total, count(distinct name) as unique_labels from entities group by all),
happened as (select job_id, scene_id, concat(name, '_observed') as event, n, 'aggregated_frame_analysis' as evidence from entities
             union all select job_id, scene_id, 'face_detected', faces_total, 'face_recognition' from totals where faces_total > 0),
events_ranked as (select *, row_number() over (partition by job_id, scene_id order by n desc, event) as rank from happened)
"""


def _packets(m: Media, k: int) -> DataFrame:
    d, s, f = (scenes.in_scenes(x, m.scenes) for x in (m.detections, m.segments, m.faces))
    return scenes.entity_counts(d, s, f, k)


@query(PACKET_SQL.format(k=2) + "select * from entities")
def scene_entity_topk(m: Media) -> DataFrame:
    return _packets(m, 2)


@query(PACKET_SQL.format(k=8) + "select * from totals")
def scene_totals(m: Media) -> DataFrame:
    return scenes.scene_totals(_packets(m, 8))


@query(PACKET_SQL.format(k=2) + "select * from totals")
def scene_totals_after_cut(m: Media) -> DataFrame:
    return scenes.scene_totals(_packets(m, 2))


@query(PACKET_SQL.format(k=8) + "select * from events_ranked where rank <= 4")
def scene_events_topk(m: Media) -> DataFrame:
    return scenes.event_counts(_packets(m, 8), 4)


@query(PACKET_SQL.format(k=8) + "select * from (select job_id, scene_id, frame_id, row_number() over (partition by job_id, scene_id order by frame_id) as position from (select distinct job_id, scene_id, frame_id from media_base) join totals using (job_id, scene_id) where unique_labels >= 4) where position <= 3")
def keyframe_pick(m: Media) -> DataFrame:
    totals = scenes.scene_totals(_packets(m, 8))
    return scenes.keyframes(scenes.in_scenes(m.frames, m.scenes), totals).select("job_id", "scene_id", "frame_id", "position")


@query("""select f.job_id, f.frame_id, coalesce(d.n, 0) as n_detections, coalesce(s.n, 0) as n_segments, coalesce(a.n, 0) as n_faces, coalesce(d.labels, '') as labels, coalesce(s.classes, '') as classes
from media_frames f
left join (select job_id, frame_id, count(*) as n, string_agg(label, ',' order by det_index) filter (det_index <= 8) as labels from media_detections group by all) d using (job_id, frame_id)
left join (select job_id, frame_id, count(*) as n, string_agg(class_name, ',' order by object_id) filter (object_id <= 8) as classes from media_segments group by all) s using (job_id, frame_id)
left join (select job_id, frame_id, count(*) as n from media_faces group by all) a using (job_id, frame_id)""")
def frame_summary(m: Media) -> DataFrame:
    out = scenes.frame_summary(m.frames, m.detections, m.segments, m.faces)
    return out.withColumns({"labels": F.array_join("labels", ","), "classes": F.array_join("classes", ",")})


@query("select job_id, scene_id, label, count(*) as n from media_detections group by rollup (job_id, scene_id, label)")
def label_rollup(m: Media) -> DataFrame:
    return scenes.label_rollup(m.detections)


CORPUS_SQL = f""",
seen as (select d.job_id, s.scene_id, s.start_sec, s.end_sec, d.frame_id, d.ts_sec, 'object' as entity_type, d.track_id as key, d.label, d.confidence, (d.ts_sec, d.frame_id, 0, d.det_index) as seq
         from media_detections d join media_scenes s on d.job_id = s.job_id and d.ts_sec between s.start_sec and s.end_sec
         union all
         select f.job_id, s.scene_id, s.start_sec, s.end_sec, f.frame_id, f.ts_sec, 'person', coalesce(f.video_person_id, f.identity_id), coalesce(f.video_person_id, f.identity_id), 0.0::double, (f.ts_sec, f.frame_id, 1, f.face_id)
         from media_faces f join media_scenes s on f.job_id = s.job_id and f.ts_sec between s.start_sec and s.end_sec),
grouped as (select job_id, scene_id, start_sec, end_sec, entity_type, key, arg_min(label, seq) as label, count(*) as count, avg(confidence) as confidence, min(ts_sec) as first, max(ts_sec) as last from seen group by all),
entities as (select job_id, scene_id, start_sec, end_sec, entity_type, key, label, count, confidence, greatest(start_sec, first) as first_seen, least(end_sec, last) as last_seen,
                    {_id("entity", "job_id", "scene_id", "entity_type", "key", "case when entity_type = 'object' then label else 'person' end")} as entity_id from grouped),
here as (select distinct s.job_id, s.scene_id, s.start_sec, s.end_sec, s.frame_id, s.ts_sec, e.entity_id from seen s join entities e on s.job_id = e.job_id and s.scene_id = e.scene_id and s.entity_type = e.entity_type and s.key = e.key),
related as (select a.job_id, a.scene_id, a.start_sec, a.end_sec, a.entity_id as source_entity_id, b.entity_id as target_entity_id, count(*) as count, min(a.ts_sec) as first, max(a.ts_sec) as last
            from here a join here b on a.job_id = b.job_id and a.scene_id = b.scene_id and a.frame_id = b.frame_id and a.entity_id < b.entity_id group by all)
"""


def _sightings(m: Media) -> DataFrame:
    faces = m.faces.withColumn("confidence", F.lit(0.0))
    return corpus.sightings(scenes.in_scenes(m.detections, m.scenes), scenes.in_scenes(faces, m.scenes))


@query(CORPUS_SQL + "select job_id, scene_id, entity_id, label, entity_type, count, round(confidence, 6) as confidence, first_seen, last_seen, greatest(0.0::double, last_seen - first_seen) as duration_sec, least(5, count) as n_evidence, case when entity_type = 'object' then key end as track_id, case when entity_type = 'person' then key end as identity_id from entities")
def corpus_entities(m: Media) -> DataFrame:
    found = corpus.entities(_sightings(m))
    return found.withColumns({"confidence": F.round("confidence", 6), "n_evidence": F.size("evidence").cast("long")}).drop("evidence", "start_sec", "end_sec")


@query(CORPUS_SQL + f"select job_id, scene_id, {_id('event', 'job_id', 'scene_id', "concat(entity_type, '_observed')", 'entity_id')} as event_id, concat(entity_type, '_observed') as event_type, count, round(confidence, 6) as confidence, first_seen, last_seen, greatest(0.0::double, last_seen - first_seen) as duration_sec, least(3, count) as n_evidence from entities")
def corpus_events(m: Media) -> DataFrame:
    found = corpus.events(corpus.entities(_sightings(m)))
    return found.withColumns({"confidence": F.round("confidence", 6), "n_evidence": F.size("evidence").cast("long")}).drop("evidence")


@query(CORPUS_SQL + f"select job_id, scene_id, {_id('relation', 'job_id', 'scene_id', 'source_entity_id', "'co_occurs_with'", 'target_entity_id')} as relation_id, source_entity_id, target_entity_id, count, round(least(1.0::double, 0.2::double + 0.2::double * count), 6) as confidence, greatest(start_sec, first) as first_seen, least(end_sec, last) as last_seen, least(5, count) as n_evidence from related")
def co_occurrence_relations(m: Media) -> DataFrame:
    seen = _sightings(m)
    found = corpus.relations(seen, corpus.entities(seen))
    return found.withColumns({"confidence": F.round("confidence", 6), "n_evidence": F.size("evidence").cast("long")}).drop("evidence", "predicate", "duration_sec")


@query(CORPUS_SQL + f""", listed as (select job_id, scene_id, label, entity_id, concat(entity_type, '_observed') as event_type, row_number() over (partition by job_id, scene_id order by count desc, label, entity_id) as rn from entities),
texts as (select s.job_id, s.scene_id, s.start_sec, s.end_sec, concat('Scene ', s.scene_id, ' (', cast(s.start_sec as decimal(18, 2)), 's-', cast(s.end_sec as decimal(18, 2)), 's) entities: ',
   coalesce(string_agg(label, ', ' order by rn) filter (rn <= 6), 'none'), '. Events: ', coalesce(string_agg(event_type, ', ' order by rn) filter (rn <= 6), 'none'), '.') as text, coalesce(string_agg(entity_id, ',' order by rn) filter (rn <= 8), '') as source_entity_ids
   from media_scenes s left join listed l using (job_id, scene_id) group by s.job_id, s.scene_id, s.start_sec, s.end_sec)
select job_id, scene_id, {_id('chunk', 'job_id', 'scene_id', 'text')} as chunk_id, text, source_entity_ids, concat('jobs/', job_id, '/scene/packets/scene_', scene_id, '.json') as artifact_keys, start_sec, end_sec from texts""")
def scene_chunks(m: Media) -> DataFrame:
    out = corpus.scene_chunks(m.scenes, corpus.entities(_sightings(m)))
    return out.withColumns({c: F.array_join(c, ",") for c in ("source_entity_ids", "artifact_keys")})


@query(MATCH_SQL + "select job_id, track_id, identity, n as count, round(conf_sum, 6) as conf_sum from votes")
def identity_votes(m: Media) -> DataFrame:
    votes = fusion.identity_votes(fusion.matched(fusion.persons(m.detections), fusion.with_identity(m.faces)))
    return votes.withColumn("conf_sum", F.round("conf_sum", 6))


@query(MATCH_SQL + "select * from resolved")
def vote_resolution(m: Media) -> DataFrame:
    return fusion.resolve_votes(fusion.identity_votes(fusion.matched(fusion.persons(m.detections), fusion.with_identity(m.faces))))


FUSED = "job_id, person_track_id, identity_id, identity_source, identity_confidence, is_identity_ambiguous, object_track_ids, first_frame_id, last_frame_id, observation_count, first_seen, last_seen, duration_sec, n_evidence"


@query(MATCH_SQL + f"select {FUSED} from fused")
def person_tracks_fused(m: Media) -> DataFrame:
    out = fusion.fuse(m.detections, m.faces)
    out = out.withColumns({"object_track_ids": F.array_join("object_track_ids", ","), "n_evidence": F.size("evidence").cast("long")})
    return out.select(*FUSED.split(", "))


@query(MATCH_SQL + """select d.job_id, d.frame_id, d.det_index, d.track_id, f.person_track_id, f.identity_id as person_identity_id, f.identity_source as person_identity_source, f.identity_confidence as person_identity_confidence
from media_detections d left join tracks t on d.job_id = t.job_id and d.track_id = t.track_id and d.label = 'person' left join fused f on t.job_id = f.job_id and t.group_key = f.group_key""")
def detections_annotated(m: Media) -> DataFrame:
    out = fusion.annotated(m.detections, fusion.fuse(m.detections, m.faces))
    return out.select("job_id", "frame_id", "det_index", "track_id", "person_track_id", "person_identity_id", "person_identity_source", "person_identity_confidence")


STAMP_SQL = "concat(lpad(cast(floor(ts_sec / 3600) as bigint)::varchar, 2, '0'), ':', lpad((cast(floor(ts_sec / 60) as bigint) % 60)::varchar, 2, '0'), ':', lpad((cast(ts_sec as bigint) % 60)::varchar, 2, '0'), '.000')"
EVIDENCE_SQL = f""",
contexts as (select f.job_id, s.scene_id, f.frame_id, {STAMP_SQL} as timestamp, concat('jobs/', f.job_id, '/analysis/json/frame_', f.frame_id, '.json') as json_artifact_key, a.frame_id is not null as has_faces
             from media_frames f join media_scenes s on f.job_id = s.job_id and f.ts_sec between s.start_sec and s.end_sec
             left join (select distinct job_id, frame_id from media_faces) a on f.job_id = a.job_id and f.frame_id = a.frame_id),
kinds as (select * from (values ('object_detection', 'det'), ('original', 'original'), ('semantic_segmentation', 'seg'), ('face_recognition', 'face')) v(modality, kind)),
refs as (select job_id, scene_id, frame_id, timestamp, json_artifact_key, modality, concat('jobs/', job_id, '/frames/', kind, '/frame_', frame_id, '.jpg') as image_uri from contexts, kinds where modality <> 'face_recognition' or has_faces),
named as (select *, {_id('evidence', 'scene_id', 'frame_id', 'modality', 'image_uri', 'json_artifact_key')} as evidence_id from refs)
"""


@query(EVIDENCE_SQL + "select * from named")
def evidence_refs(m: Media) -> DataFrame:
    return evidence.evidence_refs(evidence.frame_contexts(scenes.in_scenes(m.frames, m.scenes), m.faces))


@query(EVIDENCE_SQL + """select job_id, scene_id, frame_id, 'unknown frame' as rule from named where frame_id % 7 = 0
union all select job_id, scene_id, frame_id, 'not in index' from named where frame_id % 11 = 3 and modality = 'original'
union all select job_id, scene_id, frame_id, 'JSON mismatch' from named where frame_id % 13 = 5 and frame_id % 7 <> 0
union all select job_id, scene_id, frame_id, 'index mismatch' from named where frame_id % 13 = 5 and not (frame_id % 11 = 3 and modality = 'original')
union all select job_id, scene_id, null, 'no frames' from (select job_id, scene_id from media_scenes except select job_id, scene_id from contexts where frame_id % 7 <> 0)""")
def evidence_violations(m: Media) -> DataFrame:
    contexts = evidence.frame_contexts(scenes.in_scenes(m.frames, m.scenes), m.faces)
    refs = evidence.evidence_refs(contexts)
    index = refs.where("not (frame_id % 11 = 3 and modality = 'original')")
    # Faults of three kinds: frames without context, entries not in the index, links that differ.
    wrong = refs.withColumn("json_artifact_key", F.when(F.col("frame_id") % 13 == 5, F.lit("jobs/other.json")).otherwise(F.col("json_artifact_key")))
    return evidence.violations(m.scenes, contexts.where("frame_id % 7 <> 0"), wrong, index)


@query(f"""select job_id, frame_id, 0 as branch, det_index as pos, concat_ws(',', x1, y1, x2, y2) as bbox, label as text_span from media_detections
union all select job_id, frame_id, 1, face_id, concat_ws(',', x1, y1, x2, y2), identity_id from media_faces""")
def frame_anchors(m: Media) -> DataFrame:
    return evidence.frame_anchors(m.detections, m.faces).withColumn("bbox", F.array_join("bbox", ","))


def _conversations(m: Media) -> DataFrame:
    """Conversations as narratives: of three turns one has chunks, one only a blank one, one none."""
    t = m.table("conversations")
    chunk = lambda text: F.struct(F.lit("").alias("chunk_id"), text.alias("text"), F.array(F.lit("k")).alias("artifact_keys"), F.array(F.lit("e")).alias("source_entity_ids"))
    text = F.coalesce("text", F.lit(""))
    chunks = F.when(F.col("turn") % 3 == 0, F.array(chunk(F.concat(F.lit(" "), text, F.lit("\n"))), chunk(F.lit(" ")))).when(F.col("turn") % 3 == 1, F.array(chunk(F.lit("\t"))))
    start = (10 * F.col("turn")).cast("double")
    return t.select(F.concat(F.lit("conv-"), "conv_id").alias("job_id"), F.col("turn").alias("scene_id"), start.alias("start_sec"), (start + 10).alias("end_sec"), F.col("text").alias("narrative"), chunks.alias("chunks"))


SAID_SQL = f"""
said as (select concat('conv-', conv_id) as job_id, turn as scene_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') as text from conversations where turn % 3 <> 1),
chunks as (select job_id, scene_id, {_id('chunk', 'job_id', 'scene_id', 'text')} as chunk_id, text from said where text <> '')
"""
CHUNK_SQL = "with " + SAID_SQL


@query(CHUNK_SQL + "select job_id, scene_id, chunk_id, text, case when scene_id % 3 = 0 then 'k' else concat('jobs/', job_id, '/scene/narratives/scene_', scene_id, '.json') end as artifact_keys from chunks", media=False)
def retrieval_chunks(m: Media) -> DataFrame:
    return corpus.chunk_records(_conversations(m)).select("job_id", "scene_id", "chunk_id", "text", F.array_join("artifact_keys", ",").alias("artifact_keys"))


@query("select n_chars % 50 as key, arg_max(source, doc_id) as source, max(doc_id) as doc_id, min(doc_id) as first_seq from documents group by 1", media=False)
def chunk_dedupe_last_wins(m: Media) -> DataFrame:
    rows = m.table("documents").select((F.col("n_chars") % 50).alias("key"), "source", "doc_id", F.col("doc_id").alias("seq"))
    out = corpus.dedupe_last_wins(rows, ["key"], ["seq"])
    return out.select("key", "source", "doc_id", F.col("first_seq.seq").alias("first_seq"))


FRAME_TEXT_SQL = f""", d as (select job_id, frame_id, string_agg(label, ', ' order by det_index) filter (det_index <= 6) as labels from media_detections group by all),
a as (select job_id, frame_id, string_agg(identity_id, ', ' order by face_id) filter (face_id <= 4) as people from media_faces group by all),
t as (select f.job_id, f.frame_id, concat('Frame ', f.frame_id, ' at ', {STAMP_SQL}, ' includes objects [', coalesce(labels, 'no_objects'), '] and faces [', coalesce(people, 'no_faces'), '].') as text
      from media_frames f left join d using (job_id, frame_id) left join a using (job_id, frame_id)),
frame_texts as (select job_id, {_id('chunk', 'job_id', 'frame_id', 'text')} as chunk_id, text, 'frame' as kind from t)
"""


@query(FRAME_TEXT_SQL + "select * from frame_texts where job_id not in (select job_id from media_frames where frame_id = 3)")
def frame_fallback_chunks(m: Media) -> DataFrame:
    # Jobs with a frame 3 have a scene chunk, so only the others fall back to frames.
    told = m.frames.where("frame_id = 3").select("job_id", F.lit(0).cast("long").alias("scene_id"), F.lit(0.0).alias("start_sec"), F.lit(1.0).alias("end_sec"), F.lit("text").alias("narrative"))
    told = told.withColumn("chunks", F.lit(None).cast("array<struct<chunk_id:string,text:string,artifact_keys:array<string>,source_entity_ids:array<string>>>"))
    return corpus.retrieval_bundle(told, m.frames, m.detections, m.faces).where("kind = 'frame'")


@query(FRAME_TEXT_SQL + "," + SAID_SQL + """select distinct job_id, chunk_id, text, 'scene' as kind from chunks
union all select distinct job_id, chunk_id, text, kind from frame_texts""")
def retrieval_bundle(m: Media) -> DataFrame:
    # Conversations have scene chunks, repeats among them; the jobs of frames have none.
    return corpus.retrieval_bundle(_conversations(m), m.frames, m.detections, m.faces)


NARRATIVE_SQL = PACKET_SQL.format(k=8) + """,
e3 as (select job_id, scene_id, string_agg(name, ', ' order by rank) as names from entities where rank <= 3 group by all),
v1 as (select job_id, scene_id, event from events_ranked where rank = 1),
told as (select s.job_id, s.scene_id, s.start_sec, s.end_sec, concat('From ', cast(start_sec as decimal(18, 2)), 's to ', cast(end_sec as decimal(18, 2)), 's, the scene shows ', coalesce(names, 'no dominant entities'), ' with ', coalesce(objects_total, 0), ' object signals and ', coalesce(faces_total, 0), ' face detections.') as narrative,
  concat_ws('|', concat('Scene duration is ', cast(end_sec - start_sec as decimal(18, 2)), ' seconds.'), concat('Detected ', coalesce(unique_labels, 0), ' unique labels.'), 'Notable event: ' || event || '.') as key_moments
  from media_scenes s left join totals using (job_id, scene_id) left join e3 using (job_id, scene_id) left join v1 using (job_id, scene_id))
"""


def _narratives(m: Media) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = written(_packets(m, 8), "counts")
    v = scenes.event_counts(e)
    return narrative.fallback_narratives(m.scenes, e, v, scenes.scene_totals(e)), e, v


@query(NARRATIVE_SQL + "select * from told")
def fallback_narratives(m: Media) -> DataFrame:
    out = _narratives(m)[0].withColumn("key_moments", F.array_join("key_moments", "|"))
    return out.drop("mentioned_entities", "mentioned_events")


@query(PACKET_SQL.format(k=2) + """, all8 as (select * from ranked where rank <= 3)
select job_id, scene_id, string_agg(name, ',' order by name) as entities from all8 where rank = 3 group by all""")
def narrative_faithfulness(m: Media) -> DataFrame:
    told, _, v = _narratives(m)
    # Packets cut to two entities don't support the third one mentioned.
    out = narrative.unfaithful(told, _packets(m, 2), v)
    return out.select("job_id", "scene_id", F.array_join("entities", ",").alias("entities"))


@query("""select concat('conv-', conv_id) as job_id, trim(string_agg(concat('[', cast(10 * turn as decimal(18, 2)), '-', cast(10 * turn + 10 as decimal(18, 2)), 's] ', text), ' ' order by turn, text)) as synopsis,
count(*) as scene_count, concat('jobs/conv-', conv_id, '/summary/synopsis.json') as artifact from conversations group by conv_id""", media=False)
def synopsis_fold(m: Media) -> DataFrame:
    return narrative.synopsis(_conversations(m))


@query(""", jobs as (select distinct job_id from media_base),
kinds as (select unnest(['original', 'seg', 'det', 'face']) as kind)
select job_id, concat('jobs/', job_id, '/frames/', kind, '/frame_', frame_id, '.jpg') as key from media_frames, kinds
union select job_id, concat('jobs/', job_id, '/analysis/json/frame_', frame_id, '.json') from media_frames
union select job_id, concat('jobs/', job_id, '/scene/packets/scene_', scene_id, '.json') from media_scenes
union select job_id, concat('jobs/', job_id, '/summary/synopsis.json') from jobs
union select job_id, concat('jobs/', job_id, '/corpus/rag/bundle.json') from jobs
union select job_id, concat('jobs/', job_id, '/input/source.mp4') from jobs""")
def artifact_keys(m: Media) -> DataFrame:
    job, frame, scene = F.col("job_id"), F.col("frame_id"), F.col("scene_id")
    frames = m.frames.select("job_id", results.frame_files(job, frame).alias("files"), ids.analysis_key(job, frame).alias("json_key"))
    by_scene = m.scenes.select("job_id", F.create_map(F.lit("packet"), ids.scene_key(job, "packet", scene), F.lit("other"), F.lit("no key")).alias("artifacts"))
    jobs = m.base.select("job_id").distinct()
    corpora = F.create_map(F.lit("retrieval"), ids.corpus_key(job, "retrieval", F.lit("bundle.json")))
    jobs = jobs.select("job_id", ids.source_key(job, F.lit(".MP4")).alias("source_key"), ids.summary_key(job).alias("synopsis_key"), corpora.alias("artifacts"))
    return results.required_keys(frames, by_scene, jobs)


@query(""", keys as (select job_id, frame_id, concat('jobs/', job_id, '/analysis/json/frame_', frame_id, '.json') as key from media_frames),
gone as (select *, row_number() over (partition by job_id order by key) as rn from keys where frame_id % 3 = 0)
select job_id, count(*) as missing, string_agg(key, ',' order by key) filter (rn <= 5) as sample from gone group by all""")
def missing_artifacts(m: Media) -> DataFrame:
    keys = m.frames.select("job_id", "frame_id", ids.analysis_key(F.col("job_id"), F.col("frame_id")).alias("key"))
    out = results.missing_artifacts(keys.select("job_id", "key"), keys.where("frame_id % 3 <> 0"))
    return out.withColumn("sample", F.array_join("sample", ","))


@query("""select page_id, case when page_id % 4 = 0 then '' when page_id % 4 = 1 then concat('https://objects.example/jobs/', page_id, '/x.jpg?exp=3600') when page_id % 4 = 2 then concat('/static/', page_id) else url end as shown from pages""", media=False)
def result_urls(m: Media) -> DataFrame:
    p = F.col("page_id")
    value = F.when(p % 4 == 1, F.concat(F.lit("jobs/"), p, F.lit("/x.jpg"))).when(p % 4 == 2, F.concat(F.lit("/static/"), p)).when(p % 4 == 3, F.col("url"))
    return m.table("pages").select("page_id", results.to_url(value).alias("shown"))


@query("""select job_id, frame_id, det_index - 1 as i, case when event_id % 3 = 0 then concat('track_', frame_id, '_', det_index) else track_id end as track_id, label from media_detections where event_id % 5 <> 0""")
def track_defaults(m: Media) -> DataFrame:
    track = F.when(F.col("event_id") % 3 != 0, F.col("track_id")).when(F.col("event_id") % 2 == 0, F.lit(""))
    item = F.when(F.col("event_id") % 5 != 0, F.struct(track.alias("track_id"), "label"))
    listed = m.detections.groupBy("job_id", "frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("det_index", item.alias("x")))), lambda r: r["x"]).alias("items"))
    return results.with_track_defaults(listed).select("job_id", "frame_id", F.col("i").cast("long").alias("i"), "item.track_id", "item.label")


@query(f"select job_id, frame_id, {STAMP_SQL} as timestamp, ts_sec as parsed, 0.0::double as wrong from media_frames")
def timecode_roundtrip(m: Media) -> DataFrame:
    stamp = timecode.format_timecode(F.col("ts_sec"))
    wrong = timecode.parse_timecode(F.concat(F.lit("x:"), stamp))
    return m.frames.select("job_id", "frame_id", stamp.alias("timestamp"), timecode.parse_timecode(stamp).alias("parsed"), wrong.alias("wrong"))


@query("""select job_id, scene_id, i as sample_index, scene_id * 1000000 + i as frame_id, start_sec + i * 0.5::double as ts_sec, cast(floor((start_sec + i * 0.5::double) * 10) as bigint) as source_index
from media_scenes, (select unnest(range(0, 60)) as i)""")
def tracking_sample_grid(m: Media) -> DataFrame:
    return scenes.tracking_samples(m.scenes, fps=10.0, sample_fps=2.0, most=60)


@query("select job_id, scene_id, scene_id as frame_id, (start_sec + end_sec) / 2 as ts_sec, cast(floor((start_sec + end_sec) / 2 * 25) as bigint) as source_index from media_scenes")
def scene_middle_frames(m: Media) -> DataFrame:
    return scenes.middle_frames(m.scenes)


@query("""with s as (select concat('job-', user_id) as job_id, event_id as seq, cast(event_id as double) as ts_sec, value as score from events),
c as (select *, case when abs(score - lag(score) over (partition by job_id order by seq)) > 50 then 1 else 0 end as cut from s),
n as (select *, sum(cut) over (partition by job_id order by seq) as scene_id from c)
select job_id, cast(scene_id as bigint) as scene_id, min(ts_sec) as start_sec, max(ts_sec) as end_sec, count(*) as n_frames from n group by 1, 2""", media=False)
def scene_cuts_from_scores(m: Media) -> DataFrame:
    e = m.table("events")
    scores = e.select(F.concat(F.lit("job-"), "user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_id").cast("double").alias("ts_sec"), F.col("value").alias("score"))
    return scenes.cuts_from_scores(scores, 50.0)


OPS = {"signup": "enqueue", "view": "claim", "error": "retry", "purchase": "success"}


def _task_log(m: Media) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    op = F.coalesce(F.create_map(*(F.lit(x) for kv in OPS.items() for x in kv))[F.col("event_type")], F.lit("none"))
    return m.table("events").select(F.concat(F.lit("task-"), "user_id").alias("task_id"), seq.cast("long").alias("seq"), op.alias("op"))


@query("""with recursive log as (select concat('task-', user_id) as task_id, row_number() over (partition by user_id order by ts, event_id) as seq,
  case event_type when 'signup' then 'enqueue' when 'view' then 'claim' when 'error' then 'retry' when 'purchase' then 'success' else 'none' end as op from events),
st as (select distinct task_id, cast(0 as bigint) as seq, cast(null as varchar) as status, 0 as attempts from log
  union all
  select l.task_id, l.seq,
    case when op = 'enqueue' and coalesce(status, '') not in ('queued', 'retry', 'processing') then 'queued' when op = 'claim' and status in ('queued', 'retry') then 'processing'
         when op = 'retry' and status = 'processing' then case when attempts >= 3 then 'dead_letter' else 'retry' end when op = 'success' and status = 'processing' then 'succeeded' else status end,
    case when op = 'enqueue' and coalesce(status, '') not in ('queued', 'retry', 'processing') then 0 when op = 'claim' and status in ('queued', 'retry') then attempts + 1 else attempts end
  from st join log l on l.task_id = st.task_id and l.seq = st.seq + 1)
select task_id, status, attempts, seq as last_seq from st qualify row_number() over (partition by task_id order by seq desc) = 1 and status is not null""", media=False)
def task_latest_state(m: Media) -> DataFrame:
    return tasklog.latest_state(_task_log(m)).drop("lease_owner")


TASK_SQL = "select o_orderkey as id, case o_orderkey % 4 when 0 then 'queued' when 1 then 'retry' when 2 then 'processing' else 'succeeded' end as status, o_orderdate as next_attempt_at, case when o_orderkey % 3 = 0 then timestamp '1998-01-01' end as lease_expires_at from orders"


@query(f"select id, status from ({TASK_SQL}) where status in ('queued', 'retry') and next_attempt_at <= timestamp '1996-06-01' and (lease_expires_at is null or lease_expires_at <= timestamp '1996-06-01') order by next_attempt_at, id limit 20", media=False)
def task_claim_order(m: Media) -> DataFrame:
    o = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("queued", "retry", "processing", "succeeded"))), (o % 4 + 1).cast("int"))
    lease = F.when(o % 3 == 0, F.lit("1998-01-01").cast("timestamp_ntz"))
    tasks = m.table("orders").select(o.alias("id"), status.alias("status"), F.col("o_orderdate").alias("next_attempt_at"), lease.alias("lease_expires_at"))
    return tasklog.claim_order(tasks, F.lit("1996-06-01").cast("timestamp_ntz"), 20).select("id", "status")


@query("select l_linenumber as attempt, least(300.0::double, 5.0::double * pow(2.0::double, greatest(0, l_linenumber - 1))) as wait, count(*) as n from lineitem group by 1, 2", media=False)
def backoff_schedule(m: Media) -> DataFrame:
    rows = m.table("lineitem").select(F.col("l_linenumber").alias("attempt"), tasklog.backoff(F.col("l_linenumber")).alias("wait"))
    return rows.groupBy("attempt", "wait").agg(F.count(F.lit(1)).alias("n"))


@query("""with a as (select concat('job-', user_id) as job_id, case event_id % 3 when 0 then 'input/source.mp4' when 1 then concat('frames/', event_id, '.jpg') else 'input/tmp/source.mp4' end as path, ts as modified_at from events),
j as (select job_id, max(modified_at) as newest from a group by all)
select a.job_id, path, count(*) as n, case when newest >= timestamp '2024-01-30' - interval 24 hours then 'keep' when job_id like '%5' and path = 'input/source.mp4' then 'keep' else 'delete' end as action from a join j using (job_id) group by all""", media=False)
def retention_decision(m: Media) -> DataFrame:
    e = F.col("event_id")
    path = F.when(e % 3 == 0, F.lit("input/source.mp4")).when(e % 3 == 1, F.concat(F.lit("frames/"), e, F.lit(".jpg"))).otherwise(F.lit("input/tmp/source.mp4"))
    files = m.table("events").select(F.concat(F.lit("job-"), "user_id").alias("job_id"), path.alias("path"), F.col("ts").alias("modified_at"))
    markers = files.where(F.col("job_id").endswith("5")).select("job_id").distinct()
    swept = retention.sweep(files, markers, F.lit("2024-01-30").cast("timestamp_ntz"))
    return swept.groupBy("job_id", "path", "action").agg(F.count(F.lit(1)).alias("n"))


@query("""select event_id, case when event_id % 4 = 0 then 0 else 1 end as n_ocr, case when event_id % 4 = 0 then null else concat('text ', event_id) end as text,
case when event_id % 4 = 0 then null when event_id % 4 = 1 then '0,0,0,0' else concat_ws(',', event_id % 10, 2, 4, 8) end as bbox, case when event_id % 2 = 0 then 'unknown' else event_type end as action,
case when event_id % 3 = 0 then null else 'static' end as motion, case when event_id % 5 = 0 then true end as is_blurry from events""", media=False)
def normalize_enrichment(m: Media) -> DataFrame:
    e = F.col("event_id")
    ocr = F.when(e % 4 == 0, F.lit("null")).when(e % 4 == 1, F.format_string('[{"text": " text %d\\t", "bbox": [1, 2]}, null]', e)).otherwise(F.format_string('[{"text": "text %d", "%s": [%d.4, 1.6, 3.5, 8.5], "confidence": 0.5}]', e, F.when(e % 4 == 2, F.lit("bbox")).otherwise(F.lit("box")), e % 10))
    action = F.when(e % 2 == 0, F.lit("[{}]")).otherwise(F.format_string('[{"label": "%s"}]', "event_type"))
    motion = F.when(e % 3 == 0, F.lit("null")).otherwise(F.lit("{}"))
    quality = F.when(e % 5 == 0, F.lit('{"is_blurry": true}')).otherwise(F.lit("{}"))
    raw = F.format_string('{"ocr_blocks": %s, "actions": %s, "camera_motion": %s, "quality": %s}', ocr, action, motion, quality)
    out = normalize.enrichment(m.table("events").select("event_id", raw.alias("enrichment")))
    block = F.get("ocr_blocks", F.lit(0))
    return out.select("event_id", F.size("ocr_blocks").alias("n_ocr"), block["text"].alias("text"), F.array_join(block["bbox"], ",").alias("bbox"), F.get("actions", F.lit(0))["label"].alias("action"), F.col("camera_motion.label").alias("motion"), F.col("quality.is_blurry").alias("is_blurry"))


IDENTITY_SQL = """,
firsts as (select job_id, scene_id, vec_id, min((frame_id, face_id)) as seen_at from media_faces group by all),
clusters as (select job_id, scene_id, vec_id, dense_rank() over (partition by job_id, scene_id order by seen_at) as n from firsts),
scene_people as (select *, concat('scene_', scene_id, '_person_', n) as scene_person_id from clusters),
vec_firsts as (select job_id, vec_id, min((scene_id, scene_person_id)) as seen_at from scene_people group by all),
video_people as (select job_id, vec_id, concat('video_person_', dense_rank() over (partition by job_id order by seen_at)) as video_person_id from vec_firsts)
"""


@query(IDENTITY_SQL + "select f.job_id, f.scene_id, f.frame_id, f.face_id, s.scene_person_id, 1.0::double as match_confidence, false as is_identity_ambiguous from media_faces f join scene_people s using (job_id, scene_id, vec_id)")
def scene_identities_exact(m: Media) -> DataFrame:
    out = identity.scene_identities(m.observations).drop("cluster_size", "centroid")
    return out.withColumn("match_confidence", F.round("match_confidence", 4)).drop("embedding", "source")


@query(IDENTITY_SQL + "select job_id, scene_id, scene_person_id, video_person_id, 1.0::double as video_confidence, false as is_video_ambiguous from scene_people join video_people using (job_id, vec_id)")
def video_identities_exact(m: Media) -> DataFrame:
    out = identity.video_identities(identity.scene_clusters(identity.scene_identities(m.observations)))
    return out.withColumn("video_confidence", F.round("video_confidence", 4))


@query(IDENTITY_SQL + "select f.job_id, f.scene_id, f.frame_id, f.face_id, s.scene_person_id, v.video_person_id, v.video_person_id as identity_id, 1.0::double as match_confidence, false as is_identity_ambiguous from media_faces f join scene_people s using (job_id, scene_id, vec_id) join video_people v using (job_id, vec_id)")
def faces_identified(m: Media) -> DataFrame:
    assigned = identity.scene_identities(m.observations)
    stitched = identity.video_identities(identity.scene_clusters(assigned))
    out = identity.annotated_faces(m.faces.withColumn("source", F.lit("keyframe")), assigned, stitched)
    return out.select("job_id", "scene_id", "frame_id", "face_id", "scene_person_id", "video_person_id", "identity_id", F.round("match_confidence", 4).alias("match_confidence"), "is_identity_ambiguous")


@query(IDENTITY_SQL + "select job_id, video_person_id, count(*) as cluster_size, string_agg(scene_person_id, ',' order by scene_person_id) as scene_person_ids from scene_people join video_people using (job_id, vec_id) group by all")
def video_identity_summary(m: Media) -> DataFrame:
    out = identity.video_summary(identity.video_identities(identity.scene_clusters(identity.scene_identities(m.observations))))
    return out.withColumn("scene_person_ids", F.array_join("scene_person_ids", ","))


@query()
def scene_identities_noisy(m: Media) -> DataFrame:
    return identity.scene_identities(m.noisy_observations).drop("cluster_size", "centroid", "source")


@query()
def object_tracks(m: Media) -> DataFrame:
    return tracking.object_tracks(m.detections)


@query()
def face_tracks(m: Media) -> DataFrame:
    return tracking.face_tracks(m.faces)


@query(PACKET_SQL.format(k=8) + """
select s.job_id, s.scene_id, cast(s.end_sec - s.start_sec as bigint) as duration_sec, coalesce(t.objects_total, 0) as objects_total, coalesce(t.faces_total, 0) as faces_total, coalesce(t.unique_labels, 0) as unique_labels,
 coalesce((select string_agg(concat(name, '=', n), ',' order by rank) from entities e where e.job_id = s.job_id and e.scene_id = s.scene_id), '') as entities,
 'duration_sec,end_sec,entities,events,faces_total,job_id,objects_total,scene_id,start_sec,unique_labels' as keys
from media_scenes s left join totals t using (job_id, scene_id)""")
def packet_json(m: Media) -> DataFrame:
    e = _packets(m, 8)
    packets = evidence.packet_json(m.scenes, e, scenes.event_counts(e), scenes.scene_totals(e))
    # Read back, as byte equality of JSON isn't to be had between engines.
    kind = "struct<duration_sec:double,objects_total:bigint,faces_total:bigint,unique_labels:bigint,entities:array<struct<count:bigint,name:string>>>"
    p = packets.withColumn("p", F.from_json("packet", kind)).withColumn("keys", F.array_join(F.json_object_keys("packet"), ","))
    listed = F.array_join(F.transform("p.entities", lambda x: F.concat(x["name"], F.lit("="), x["count"].cast("string"))), ",")
    return p.select("job_id", "scene_id", F.col("p.duration_sec").cast("long").alias("duration_sec"), "p.objects_total", "p.faces_total", "p.unique_labels", listed.alias("entities"), "keys")


@query(f"""select f.job_id, f.frame_id, {STAMP_SQL} as timestamp, concat('https://objects.example/jobs/', f.job_id, '/frames/det/frame_', f.frame_id, '.jpg?exp=3600') as detection_url,
coalesce((select count(*) from media_detections d where d.job_id = f.job_id and d.frame_id = f.frame_id), 0) as n_detections, coalesce((select count(*) from media_faces a where a.job_id = f.job_id and a.frame_id = f.frame_id), 0) as n_faces,
(select concat(d.label, ':', d.x1, ',', d.y1, ',', d.x2, ',', d.y2) from media_detections d where d.job_id = f.job_id and d.frame_id = f.frame_id and d.det_index = 1) as first_detection from media_frames f""")
def frame_documents(m: Media) -> DataFrame:
    d = results.frame_documents(m.frames, m.detections, m.faces, m.segments)
    one = F.get("analysis.object_detection", F.lit(0))
    shown = F.when(one.isNotNull(), F.concat(one["label"], F.lit(":"), F.array_join(one["box"], ",")))
    return d.select("job_id", "frame_id", "timestamp", F.col("files")["detection"].alias("detection_url"), F.size("analysis.object_detection").cast("long").alias("n_detections"), F.size("analysis.face_recognition").cast("long").alias("n_faces"), shown.alias("first_detection"))


def _frame_enrichment(m: Media) -> DataFrame:
    """What enrichers say of each frame, as the JSON of its first event."""
    e = F.col("e")
    first = m.base.groupBy("job_id", "frame_id").agg(F.min("event_id").alias("e"))
    ocr = F.when(e % 3 == 0, F.lit("[]")).otherwise(F.format_string('[{"text": " sign %d ", "bbox": [%d, 2, 4.4, 8], "confidence": 0.5}, null, {"text": "b"}]', e, e % 10))
    pose = F.when(e % 4 == 0, F.format_string('[{"track_id": "p%d", "confidence": 0.25, "keypoints": [{"x": 1.5, "y": 2}, null]}, {}]', e % 5)).otherwise(F.lit("null"))
    motion = F.when(e % 5 == 0, F.lit("null")).otherwise(F.lit('{"label": "pan", "confidence": 0.5}'))
    raw = F.format_string('{"ocr_blocks": %s, "actions": [{"confidence": 1}], "poses": %s, "camera_motion": %s, "quality": {"is_blurry": %s}}', ocr, pose, motion, (e % 2 == 0).cast("string"))
    return normalize.enrichment(first.select("job_id", "frame_id", raw.alias("enrichment")))


DOCUMENT_SQL = f""",
fe as (select job_id, frame_id, min(event_id) as e from media_base group by all),
stamped as (select job_id, frame_id, {STAMP_SQL} as stamp from media_frames),
d as (select job_id, frame_id, string_agg(concat_ws('/', track_id, label, cast(round(confidence * 100) as bigint), concat_ws(',', x1, y1, x2, y2)), ';' order by det_index) as detections, string_agg(concat(x1, ',', y1, ',', x2, ',', y2, '=', label), ';' order by det_index) as a from media_detections group by all),
f as (select job_id, frame_id, string_agg(concat_ws('/', face_id, identity_id, coalesce(video_person_id, '-'), cast(round(match_confidence * 100) as bigint), concat_ws(',', x1, y1, x2, y2)), ';' order by face_id) as faces, string_agg(concat(x1, ',', y1, ',', x2, ',', y2, '=', identity_id), ';' order by face_id) as a from media_faces group by all),
s as (select job_id, frame_id, string_agg(concat(object_id, '/', class_name), ';' order by object_id) as segments from media_segments group by all)
select b.job_id, b.frame_id, stamp as timestamp, coalesce(detections, '') as detections, coalesce(faces, '') as faces, coalesce(segments, '') as segments,
  case when e % 3 = 0 then '' else concat('sign ', e, '/', e % 10, ',2,4,8;b/0,0,0,0') end as ocr, 'unknown' as actions, case when e % 4 = 0 then concat('p', e % 5, ':1.5,2.0,0.0;unknown_track:') else '' end as poses,
  case when e % 5 <> 0 then 'pan' end as motion, e % 2 = 0 as is_blurry,
  concat_ws(';', d.a, f.a, case when e % 3 <> 0 then concat(e % 10, ',2,4,8=sign ', e, ';0,0,0,0=b') end) as anchors,
  concat_ws('|', b.job_id, b.frame_id, stamp, concat('jobs/', b.job_id, '/frames/original/frame_', b.frame_id, '.jpg')) as provenance,
  'detector:det:2:0.0,segmenter:unknown:unknown:0.0,face_detector:unknown:unknown:0.9,ocr_enricher:ocr:unknown:-' as models,
  concat('https://objects.example/jobs/', b.job_id, '/analysis/json/frame_', b.frame_id, '.json?exp=3600') as json_url, 4 as n_files
from stamped b join fe using (job_id, frame_id) left join d using (job_id, frame_id) left join f using (job_id, frame_id) left join s using (job_id, frame_id)"""


@query(DOCUMENT_SQL)
def frame_document_fields(m: Media) -> DataFrame:
    """Every field of the nested documents, lists as texts."""
    docs = results.frame_documents(m.frames, m.detections, m.faces, m.segments, _frame_enrichment(m), {"detector": ("det", "2"), "ocr_enricher": ("ocr", "")})
    cents = lambda c: F.round(c * 100).cast("long").cast("string")
    text = lambda name, f: F.array_join(F.transform(name, f), ";")
    box = lambda b: F.array_join(b, ",")
    point = lambda k: F.concat_ws(",", k["x"].cast("string"), k["y"].cast("string"), k["confidence"].cast("string"))
    p = "metadata.provenance"
    return docs.select(
        "job_id", "frame_id", "timestamp",
        text("analysis.object_detection", lambda x: F.concat_ws("/", x["track_id"], x["label"], cents(x["confidence"]), box(x["box"]))).alias("detections"),
        text("analysis.face_recognition", lambda x: F.concat_ws("/", x["face_id"].cast("string"), x["identity_id"], F.coalesce(x["video_person_id"], F.lit("-")), cents(x["match_confidence"]), box(x["coordinates"]))).alias("faces"),
        text("analysis.semantic_segmentation", lambda x: F.concat_ws("/", x["object_id"].cast("string"), x["class"])).alias("segments"),
        text("analysis.enrichment.ocr_blocks", lambda x: F.concat_ws("/", x["text"], box(x["bbox"]))).alias("ocr"),
        text("analysis.enrichment.actions", lambda x: x["label"]).alias("actions"),
        text("analysis.enrichment.poses", lambda x: F.concat(x["track_id"], F.lit(":"), F.array_join(F.transform(x["keypoints"], point), " "))).alias("poses"),
        F.col("analysis.enrichment.camera_motion.label").alias("motion"), F.col("analysis.enrichment.quality.is_blurry").alias("is_blurry"),
        text("metadata.evidence_anchors", lambda x: F.concat(box(x["bbox"]), F.lit("="), x["text_span"])).alias("anchors"),
        F.concat_ws("|", f"{p}.job_id", F.col(f"{p}.scene_id").cast("string"), F.col(f"{p}.frame_id").cast("string"), f"{p}.timestamp", f"{p}.source_artifact_key").alias("provenance"),
        F.array_join(F.transform("metadata.model_provenance", lambda x: F.concat_ws(":", x["component"], x["model_id"], x["version"], F.coalesce(x["threshold"].cast("string"), F.lit("-")))), ",").alias("models"),
        F.col("analysis_artifacts.json").alias("json_url"), F.size("files").alias("n_files"),
    )


@query("select job_id, start_sec, end_sec, row_number() over (partition by job_id order by start_sec, end_sec) - 1 as scene_id from media_scenes")
def scene_ordinals(m: Media) -> DataFrame:
    # Scenes come in no order of time.
    return scenes.numbered_scenes(m.scenes.drop("scene_id").repartition(3, "end_sec"))


@query("""select page_id, case page_id % 4 when 0 then 'mov' when 1 then 'mp4' when 2 then 'mp4' else 'tgz' end as extension, case page_id % 4 when 0 then 'video/quicktime' when 3 then 'application/x-tar' else 'video/mp4' end as content_type from pages""", media=False)
def source_names(m: Media) -> DataFrame:
    p = F.col("page_id")
    name = F.element_at(F.array(*map(F.lit, ("Clip.MOV", "clip", "clip.", "a.b.t-g.z"))), (p % 4 + 1).cast("int"))
    name = F.when(p % 4 == 3, F.lit("a.b.T-g z")).otherwise(name)
    stated = F.when(p % 4 == 3, F.lit("application/x-tar")).otherwise(F.lit("video"))
    return m.table("pages").select("page_id", ids.source_extension(name).alias("extension"), ids.content_type(stated, name).alias("content_type"))


def _tables(m: Media) -> jobs.Tables:
    return jobs.Tables(m.scenes, m.frames, m.detections, m.segments, m.faces)


@query(PACKET_SQL.format(k=8) + """,
placed as (select f.job_id, s.scene_id, f.frame_id, a.frame_id is not null as has_faces from media_frames f join media_scenes s on f.job_id = s.job_id and f.ts_sec between s.start_sec and s.end_sec
           left join (select distinct job_id, frame_id from media_faces) a on f.job_id = a.job_id and f.frame_id = a.frame_id),
proof as (select job_id, scene_id, sum(case when has_faces then 4 else 3 end) as n_refs, count(*) as n_frames from placed group by all),
e as (select job_id, scene_id, count(*) as n from entities group by all), v as (select job_id, scene_id, count(*) as n from events_ranked where rank <= 8 group by all)
select s.job_id, s.scene_id, objects_total, faces_total, coalesce(e.n, 0) as n_entities, coalesce(v.n, 0) as n_events, case when unique_labels >= 4 then least(3, n_frames) else 0 end as n_keyframes, cast(n_refs as bigint) as n_refs, 0 as n_violations
from media_scenes s left join totals using (job_id, scene_id) left join proof using (job_id, scene_id) left join e using (job_id, scene_id) left join v using (job_id, scene_id)""")
def scene_packet_composite(m: Media) -> DataFrame:
    with scratch(m.spark):
        p = jobs.scene_packets(_tables(m))
        parts = {"n_entities": p.entities, "n_events": p.events, "n_keyframes": p.keyframes, "n_refs": p.refs, "n_violations": p.violations}
        # One row for each thing, counted by one exchange: a chain of joins would hold the sorts of all parts in one task.
        rows = [x.select(*scenes.SCENE, F.lit(name).alias("name")) for name, x in parts.items()]
        counts = reduce(DataFrame.unionByName, rows).groupBy(*scenes.SCENE).agg(*(F.count(F.when(F.col("name") == name, 1)).alias(name) for name in parts))
        out = m.scenes.select("job_id", "scene_id").join(p.totals.drop("unique_labels"), scenes.SCENE, "left").join(counts, scenes.SCENE, "left")
        return written(out.fillna(0, list(parts)), "scene-packet-composite", kept=True)


@query(NARRATIVE_SQL + """, n as (select job_id, count(*) as n_narratives, trim(string_agg(concat('[', cast(start_sec as decimal(18, 2)), '-', cast(end_sec as decimal(18, 2)), 's] ', narrative), ' ' order by start_sec, scene_id)) as synopsis,
  concat('https://objects.example/jobs/', job_id, '/scene/packets/scene_', arg_min(scene_id, start_sec), '.json?exp=3600') as first_url from told group by job_id)
select f.job_id, 'completed' as status, f.n_frames, n_narratives, synopsis, first_url from (select job_id, count(*) as n_frames from media_frames group by all) f join n using (job_id)""")
def job_results(m: Media) -> DataFrame:
    t = _tables(m)
    states = m.frames.select("job_id", F.lit("completed").alias("status")).distinct()
    out = jobs.job_results(t, jobs.understand(t), states)
    url = F.get("scene_narratives", F.lit(0))["packet_url"].alias("first_url")
    return out.select("job_id", "status", F.size("frames").cast("long").alias("n_frames"), F.size("scene_narratives").cast("long").alias("n_narratives"), "synopsis", url)


@query(CORPUS_SQL + """, e as (select job_id, count(*) as n_entities from entities group by all), r as (select job_id, count(*) as n_relations from related group by all)
select job_id, n_entities, n_entities as n_events, coalesce(n_relations, 0) as n_relations, (select count(*) from media_scenes s where s.job_id = e.job_id) as n_chunks, 'scene' as kinds from e left join r using (job_id)""")
def job_corpus(m: Media) -> DataFrame:
    t = _tables(m)
    states = m.frames.select("job_id", F.lit("completed").alias("status")).distinct()
    n = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    with scratch(m.spark):
        out = jobs.job_results(t, jobs.understand(t), states)
        out = out.where("size(entities) > 0").select("job_id", *map(n, ("entities", "events", "relations", "chunks")), F.array_join(F.array_distinct("chunks.kind"), ",").alias("kinds"))
        return written(out, "job-corpus", kept=True)


@query("""select f.job_id, case when f.job_id like '%5' then 'failed' else 'completed' end as status, 0 as n_narratives, 0 as n_entities, count(*) as n_chunks, 'frame' as kinds from media_frames f group by all""")
def empty_scene_fallback(m: Media) -> DataFrame:
    # Dead tasks: jobs with one policy fail, the others complete without scenes.
    t = jobs.without_scenes(_tables(m))
    states = m.frames.select("job_id", F.when(F.col("job_id").endswith("5"), tasklog.terminal_action("fail_job")).otherwise(tasklog.terminal_action("fallback_empty")).alias("status")).distinct()
    out = jobs.job_results(t, jobs.understand(t), states)
    n = lambda c, name: F.size(c).cast("long").alias(name)
    return out.select("job_id", "status", n("scene_narratives", "n_narratives"), n("entities", "n_entities"), n("chunks", "n_chunks"), F.array_join(F.array_distinct("chunks.kind"), ",").alias("kinds"))


#: Every field of the objects that belong to narratives; ``corpus_entities`` and the like check how evidence is chosen, here it is compared as text.
ARTIFACT_SQL = NARRATIVE_SQL + CORPUS_SQL.replace("seen as", "sighted as").replace("from seen", "from sighted").replace("entities as", "known as").replace("join entities", "join known") + f""",
ev as (select *, concat(entity_type, '_observed') as event_type, {_id('event', 'job_id', 'scene_id', "concat(entity_type, '_observed')", 'entity_id')} as event_id from known),
pr as (select job_id, scene_id, entity_type, key, list((frame_id, ts_sec, label) order by seq)[1:5] as proof from sighted group by all),
el as (select job_id, scene_id, string_agg(concat_ws(':', entity_id, label, entity_type, count, cast(round(confidence * 1e6) as bigint), cast(first_seen as bigint), cast(last_seen as bigint), cast(greatest(0, last_seen - first_seen) as bigint), key, array_to_string(list_transform(proof, lambda x: concat(x[1], '@', cast(x[2] as bigint), '@', x[3])), '+')), ';' order by count desc, label, entity_id) as entities
       from known join pr using (job_id, scene_id, entity_type, key) group by all),
vl as (select job_id, scene_id, string_agg(concat_ws(':', event_id, event_type, count, cast(first_seen as bigint), cast(last_seen as bigint), least(3, count)), ';' order by count desc, event_type, event_id) as events from ev group by all),
rl as (select job_id, scene_id, string_agg(concat_ws(':', {_id('relation', 'job_id', 'scene_id', 'source_entity_id', "'co_occurs_with'", 'target_entity_id')}, source_entity_id, 'co_occurs_with', target_entity_id, count, cast(greatest(start_sec, first) as bigint), cast(least(end_sec, last) as bigint), least(5, count)), ';' order by count desc, source_entity_id, target_entity_id) as relations from related group by all),
listed as (select job_id, scene_id, label, entity_id, concat(entity_type, '_observed') as event_type, row_number() over (partition by job_id, scene_id order by count desc, label, entity_id) as rn from known),
texts as (select s.job_id, s.scene_id, s.start_sec, s.end_sec, concat('Scene ', s.scene_id, ' (', cast(s.start_sec as decimal(18, 2)), 's-', cast(s.end_sec as decimal(18, 2)), 's) entities: ',
   coalesce(string_agg(label, ', ' order by rn) filter (rn <= 6), 'none'), '. Events: ', coalesce(string_agg(event_type, ', ' order by rn) filter (rn <= 6), 'none'), '.') as text, coalesce(string_agg(entity_id, ',' order by rn) filter (rn <= 8), '') as sources
   from media_scenes s left join listed l using (job_id, scene_id) group by s.job_id, s.scene_id, s.start_sec, s.end_sec),
cl as (select job_id, scene_id, concat_ws('|', {_id('chunk', 'job_id', 'scene_id', 'text')}, text, sources, concat('jobs/', job_id, '/scene/packets/scene_', scene_id, '.json'), cast(start_sec as bigint), cast(end_sec as bigint)) as chunks from texts),
keyed as (select job_id, scene_id, concat('jobs/', job_id, '/corpus/graph/scene_', scene_id, '.json') as graph, concat('jobs/', job_id, '/corpus/rag/scene_', scene_id, '.json') as rag from told)
select job_id, scene_id, concat('jobs/', job_id, '/scene/narratives/scene_', scene_id, '.json') as key, concat_ws('#', cast(start_sec as bigint), cast(end_sec as bigint), narrative, key_moments, concat('jobs/', job_id, '/scene/packets/scene_', scene_id, '.json')) as said,
  null::varchar as entities, null::varchar as events, null::varchar as relations, null::varchar as chunks, null::varchar as artifacts from told
union all select job_id, scene_id, k.key, null, coalesce(entities, ''), coalesce(events, ''), coalesce(relations, ''), coalesce(chunks, ''), concat(graph, ',', rag)
from (select job_id, scene_id, graph, rag, unnest([graph, rag]) as key from keyed) k left join el using (job_id, scene_id) left join vl using (job_id, scene_id) left join rl using (job_id, scene_id) left join cl using (job_id, scene_id)"""
EVIDENCE_JSON = "array<struct<frame_id:bigint,timestamp:string,artifact_key:string,bbox:array<bigint>,text_span:string>>"
BODY_JSON = (
    "struct<scene_id:bigint,start_sec:double,end_sec:double,narrative_paragraph:string,key_moments:array<string>,packet:string,"
    f"entities:array<struct<entity_id:string,label:string,entity_type:string,count:bigint,confidence:double,temporal_span:struct<first_seen:double,last_seen:double,duration_sec:double>,track_id:string,identity_id:string,evidence:{EVIDENCE_JSON}>>,"
    f"events:array<struct<event_id:string,event_type:string,count:bigint,temporal_span:struct<first_seen:double,last_seen:double,duration_sec:double>,evidence:{EVIDENCE_JSON}>>,"
    f"relations:array<struct<relation_id:string,source_entity_id:string,predicate:string,target_entity_id:string,count:bigint,temporal_span:struct<first_seen:double,last_seen:double,duration_sec:double>,evidence:{EVIDENCE_JSON}>>,"
    "retrieval_chunks:array<struct<chunk_id:string,text:string,artifact_keys:array<string>,source_entity_ids:array<string>,temporal_span:struct<first_seen:double,last_seen:double,duration_sec:double>>>,artifacts:struct<graph_bundle:string,retrieval_bundle:string>>"
)


def _bodies(objects: DataFrame) -> DataFrame:
    """Artifact bodies parsed, each list as one text."""
    p = objects.withColumn("p", F.from_json("body", BODY_JSON))
    whole = lambda c: c.cast("long").cast("string")
    text = lambda *cs: F.concat_ws(":", *cs)
    span = lambda x: [whole(x["temporal_span"][c]) for c in ("first_seen", "last_seen")]
    listed = lambda name, f: F.when(F.col(f"p.{name}").isNotNull(), F.array_join(F.transform(f"p.{name}", f), ";")).alias(name)
    proof = lambda x: F.array_join(F.transform(x["evidence"], lambda e: F.concat_ws("@", e["frame_id"].cast("string"), whole(timecode.parse_timecode(e["timestamp"])), e["text_span"])), "+")
    said = F.when(F.col("p.narrative_paragraph").isNotNull(), F.concat_ws("#", whole(F.col("p.start_sec")), whole(F.col("p.end_sec")), "p.narrative_paragraph", F.array_join("p.key_moments", "|"), "p.packet"))
    chunk = lambda x: F.concat_ws("|", x["chunk_id"], x["text"], F.array_join(x["source_entity_ids"], ","), F.array_join(x["artifact_keys"], ","), *span(x))
    return p.select(
        "job_id", "scene_id", "key", said.alias("said"),
        listed("entities", lambda x: text(x["entity_id"], x["label"], x["entity_type"], x["count"].cast("string"), whole(F.round(x["confidence"] * 1e6)), *span(x), whole(x["temporal_span"]["duration_sec"]), F.coalesce(x["track_id"], x["identity_id"]), proof(x))),
        listed("events", lambda x: text(x["event_id"], x["event_type"], x["count"].cast("string"), *span(x), F.size(x["evidence"]).cast("string"))),
        listed("relations", lambda x: text(x["relation_id"], x["source_entity_id"], x["predicate"], x["target_entity_id"], x["count"].cast("string"), *span(x), F.size(x["evidence"]).cast("string"))),
        F.when(F.col("p.retrieval_chunks").isNotNull(), F.array_join(F.transform("p.retrieval_chunks", chunk), ";")).alias("chunks"),
        F.when(F.col("p.artifacts").isNotNull(), F.concat_ws(",", "p.artifacts.graph_bundle", "p.artifacts.retrieval_bundle")).alias("artifacts"),
    )


@query(ARTIFACT_SQL)
def narrative_artifacts(m: Media) -> DataFrame:
    with scratch(m.spark):
        return written(_bodies(jobs.narrative_artifacts(_narratives(m)[0], jobs.corpus_of(_tables(m)))), "narrative-artifacts", kept=True)


#: The rules of fusion, packets and corpus over the faces that identification named.
_named_faces = lambda sql: sql.replace("media_faces", "id_faces")
WHOLE_SQL = IDENTITY_SQL + """,
id_faces as (select f.* exclude (video_person_id, identity_id, match_confidence), v.video_person_id, v.video_person_id as identity_id, 1.0::double as match_confidence from media_faces f join video_people v using (job_id, vec_id))
""" + _named_faces(MATCH_SQL.replace("proof as", "track_proof as").replace("join proof", "join track_proof").replace("ranked as", "vote_ranks as").replace("from ranked", "from vote_ranks").replace("known as", "named as").replace("join known", "join named")) + _named_faces(ARTIFACT_SQL[: ARTIFACT_SQL.index("\nselect job_id, scene_id, concat('jobs/', job_id, '/scene/narratives/")]) + """,
i as (select job_id, string_agg(concat(video_person_id, '=', n), ',' order by video_person_id) as identities from (select job_id, video_person_id, count(*) as n from scene_people join video_people using (job_id, vec_id) group by all) group by job_id),
t as (select job_id, string_agg(concat(person_track_id, '=', coalesce(identity_id, '')), ',' order by person_track_id) as person_tracks from fused group by job_id),
k as (select job_id, string_agg(entity_id, ',' order by scene_id, entity_id) as entity_ids, count(*) as n_entities from known group by job_id),
g as (select job_id, count(*) as n_relations, sum(count) as n_pairs from related group by job_id),
n as (select job_id, trim(string_agg(concat('[', cast(start_sec as decimal(18, 2)), '-', cast(end_sec as decimal(18, 2)), 's] ', narrative), ' ' order by start_sec, scene_id)) as synopsis, 3 * count(*) as n_objects from told group by job_id),
h as (select job_id, string_agg(text, '~' order by scene_id) as chunks from texts group by job_id),
m as (select job_id, count(person_track_id) as n_marked from media_detections d left join (select job_id, person_track_id, unnest(string_split(object_track_ids, ',')) as track_id from fused) f using (job_id, track_id) where label = 'person' group by job_id)
select f.job_id, n_frames, coalesce(identities, '') as identities, coalesce(person_tracks, '') as person_tracks, coalesce(n_marked, 0) as n_marked, coalesce(entity_ids, '') as entity_ids, coalesce(n_entities, 0) as n_entities, coalesce(n_relations, 0) as n_relations,
       cast(coalesce(n_pairs, 0) as bigint) as n_pairs, synopsis, n_objects, chunks
from (select job_id, count(*) as n_frames from media_frames group by all) f left join i using (job_id) left join t using (job_id) left join k using (job_id) left join g using (job_id) left join n using (job_id) left join h using (job_id) left join m using (job_id)"""


@query(WHOLE_SQL)
def whole_job(m: Media) -> DataFrame:
    """From observations to all results of every job, one row each."""
    with jobs.whole(_tables(m), m.observations) as w:
        joined = lambda rows, order, value, name: rows.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("v")))), lambda x: x["v"]), "~" if name == "chunks" else ",").alias(name))
        count = lambda rows, name: rows.groupBy("job_id").agg(F.count(F.lit(1)).alias(name))
        c = w.understanding.corpus
        parts = [
            joined(w.identities, ["video_person_id"], F.concat_ws("=", "video_person_id", F.col("cluster_size").cast("string")), "identities"),
            joined(w.person_tracks, ["person_track_id"], F.concat("person_track_id", F.lit("="), F.coalesce("identity_id", F.lit(""))), "person_tracks"),
            w.tables.detections.groupBy("job_id").agg(F.count("person_track_id").alias("n_marked")),
            joined(c.entities, ["scene_id", "entity_id"], F.col("entity_id"), "entity_ids"),
            count(c.entities, "n_entities"),
            c.relations.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_relations"), F.sum("count").alias("n_pairs")),
            w.understanding.synopses.select("job_id", "synopsis"),
            count(w.artifacts, "n_objects"),
            joined(c.scene_chunks, ["scene_id"], F.col("text"), "chunks"),
        ]
        out = count(w.documents, "n_frames")
        for part in parts:
            out = out.join(part, "job_id", "left")
        out = out.fillna("", ["identities", "person_tracks", "entity_ids"]).fillna(0, ["n_marked", "n_entities", "n_relations", "n_pairs"])
        return written(out, "whole-job", kept=True)


@query("""select event_id, case event_id % 4 when 0 then 2 else 0 end as n_narratives, case event_id % 4 when 0 then event_type end as said from events""", media=False)
def scene_output_shapes(m: Media) -> DataFrame:
    e = F.col("event_id")
    good = F.format_string('{"scene_narratives": [{"a": 1}, "b"], "video_synopsis": {"said": "%s"}}', "event_type")
    raw = F.when(e % 4 == 0, good).when(e % 4 == 1, F.lit("[1, 2]")).when(e % 4 == 2, F.lit('{"scene_narratives": {"a": 1}, "video_synopsis": []}')).otherwise(F.lit("no JSON"))
    out = jobs.scene_outputs(m.table("events").select("event_id", raw.alias("outputs")))
    return out.select("event_id", F.size("scene_narratives").cast("long").alias("n_narratives"), F.get_json_object("video_synopsis", "$.said").alias("said"))


@query("""select event_id, case event_id % 4 when 0 then concat_ws(',', event_id, 0, event_id + 5, 7) end as box, cast(round_even(event_id / 2.0, 0) as bigint) as half from events""", media=False)
def box_coercion(m: Media) -> DataFrame:
    e = F.col("event_id").cast("string")
    grown = (F.col("event_id") + 5).cast("string")
    raw = F.when(F.col("event_id") % 4 == 0, F.array(e, F.lit("0.9"), F.concat(grown, F.lit(".7")), F.lit("7"))).when(F.col("event_id") % 4 == 1, F.array(e, F.lit("x"), grown, F.lit("7"))).when(F.col("event_id") % 4 == 2, F.array(grown, F.lit("0"), e, F.lit("7"))).otherwise(F.array(e, e))
    return m.table("events").select("event_id", F.array_join(geometry.coerced_box(raw), ",").alias("box"), geometry.round_coord(F.col("event_id") / 2.0).alias("half"))


@query("""with raw as (select job_id, frame_id, e, row_number() over (partition by job_id, frame_id order by e) as face_id
  from (select concat('job-', user_id) as job_id, event_id as frame_id, unnest([event_id, event_id + 1, event_id + 2]) as e from events) where 80 + e % 20 >= 90 and e % 7 <> 0)
select job_id, frame_id, face_id, (80 + e % 20) / 100.0::double as confidence, concat_ws(',', e, 1, e + 2, 4) as coordinates from raw""", media=False)
def kept_faces(m: Media) -> DataFrame:
    three = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: F.col("event_id") + i)
    probs = F.transform(three, lambda e: (80 + e % 20).cast("double") / 100)
    boxes = F.transform(three, lambda e: F.when(e % 7 != 0, F.array(e + 0.2, F.lit(0.6), e + 2.4, F.lit(4.0))))
    raw = m.table("events").select(F.concat(F.lit("job-"), "user_id").alias("job_id"), F.col("event_id").alias("frame_id"), probs.alias("probs"), boxes.alias("boxes"))
    return normalize.kept_faces(raw).withColumns({"face_id": F.col("face_id").cast("long"), "coordinates": F.array_join("coordinates", ",")})


def _raw_detections(m: Media) -> DataFrame:
    e = F.col("event_id")
    boxes = F.array(F.array(e + 0.4, F.lit(1.6), e + 9.6, F.lit(8.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)))
    names = F.create_map(F.lit(0), F.lit("person"), F.lit(1), F.lit("car"))
    ids_ = F.when(e % 2 == 0, F.array(e.cast("double"), F.lit(None).cast("double")))
    return m.table("events").select(F.lit("j").alias("job_id"), e.alias("frame_id"), boxes.alias("boxes"), F.array((e % 3).cast("int"), F.lit(0)).alias("class_ids"), F.array(F.lit(0.5), F.lit(0.25)).alias("confs"), ids_.alias("box_ids"), names.alias("names"))


DETECTED_SQL = """with d as (select event_id as frame_id, 0 as index, case event_id % 3 when 0 then 'person' when 1 then 'car' else '2' end as label, 0.5::double as confidence, concat_ws(',', event_id, 2, event_id + 10, 8) as box, case when event_id % 2 = 0 then cast(event_id as double) end as box_id from events
union all select event_id, 1, 'person', 0.25, '0,0,1,1', null from events)"""


@query(DETECTED_SQL + " select 'j' as job_id, * from d", media=False)
def detection_rows(m: Media) -> DataFrame:
    return normalize.detections(_raw_detections(m)).withColumns({"index": F.col("index").cast("long"), "box": F.array_join("box", ",")})


@query(DETECTED_SQL + """ select frame_id, index, case when frame_id % 2 = 0 then coalesce(cast(box_id as bigint), index + 1) when index = 0 then 77
 else cast(('0x' || substr(sha1(concat_ws(':', 'j', frame_id, label, index)), 1, 8)) as bigint) end as track_num from d""", media=False)
def track_numbers(m: Media) -> DataFrame:
    d = normalize.detections(_raw_detections(m))
    tracked = F.when(F.col("index") == 0, F.lit(77).cast("long"))
    n = tracking.track_number(F.col("box_id"), tracked, F.col("index").cast("long"), F.col("job_id"), F.col("frame_id"), F.col("label"), F.col("frame_id") % 2 == 0)
    return d.select("frame_id", F.col("index").cast("long").alias("index"), n.alias("track_num"))


@query("""select event_id as frame_id, 1 as object_id, case when event_id % 2 = 0 then 'person' else '7' end as class_name, concat_ws(',', event_id, 2) as first_point, '230,57,70' as color from events""", media=False)
def segment_rows(m: Media) -> DataFrame:
    e = F.col("event_id")
    polygons = F.array(F.array(F.array(e + 0.3, F.lit(1.7)), F.array(F.lit(3.0), F.lit(4.0))), F.array(F.array(F.lit(0.0), F.lit(0.0))))
    raw = m.table("events").select(F.lit("j").alias("job_id"), e.alias("frame_id"), polygons.alias("polygons"), F.array(F.when(e % 2 == 0, 0).otherwise(7)).alias("class_ids"), F.create_map(F.lit(0), F.lit("person")).alias("names"))
    raw = raw.withColumn("polygons", F.transform("polygons", lambda p: p))
    out = normalize.segmentations(raw)
    return out.select("frame_id", F.col("object_id").cast("long").alias("object_id"), "class_name", F.array_join(F.get("mask_polygon", F.lit(0)), ",").alias("first_point"), F.array_join("color", ",").alias("color"))


@query("""select job_id, frame_id, component, case component when 'face' then 'facenet' else 'nano' end as model_id, case component when 'face' then 'unknown' else '1' end as version, case component when 'face' then 0.9::double else 0.0::double end as threshold
from media_frames, (select unnest(['detection', 'face', 'segmentation']) as component)""")
def model_provenance(m: Media) -> DataFrame:
    return normalize.model_provenance(m.frames, {"detection": ("nano", "1"), "face": ("facenet", ""), "segmentation": ("nano", "1")})


@query("""select job_id, frame_id, rn - 1 as i, case when event_id % 3 = 0 then identity_id else concat('face_', rn) end as identity_id
from (select *, row_number() over (partition by job_id, frame_id order by face_id) as rn from media_faces) where event_id % 5 <> 0""")
def identity_defaults(m: Media) -> DataFrame:
    own = F.when(F.col("event_id") % 3 == 0, F.col("identity_id")).when(F.col("event_id") % 2 == 0, F.lit(""))
    item = F.when(F.col("event_id") % 5 != 0, F.struct(own.alias("identity_id"), "face_id"))
    listed = m.faces.groupBy("job_id", "frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("face_id", item.alias("x")))), lambda r: r["x"]).alias("items"))
    return results.with_identity_defaults(listed).select("job_id", "frame_id", F.col("i").cast("long").alias("i"), "item.identity_id")


@query("""with n as (select concat('job-', user_id, ':scene_understanding:v1') as idempotency_key, event_id as seq, user_id from events)
select idempotency_key, min(seq) as seq from n where user_id % 3 <> 0 group by all""", media=False)
def enqueue_once(m: Media) -> DataFrame:
    key = ids.idempotency_key(F.concat(F.lit("job-"), "user_id"))
    new = m.table("events").select(key.alias("idempotency_key"), F.col("event_id").alias("seq"), "user_id")
    status = F.when(F.col("user_id") % 3 == 0, "processing").otherwise("succeeded")
    return tasklog.enqueue(new.drop("user_id"), new.select("idempotency_key", status.alias("status")).distinct()).select("idempotency_key", "seq")


JOB_OPS = {"signup": "create", "view": "stage", "purchase": "complete", "error": "fail"}


@query("""with l as (select concat('job-', user_id) as job_id, event_id as seq, case event_type when 'signup' then 'create' when 'view' then 'stage' when 'purchase' then 'complete' when 'error' then 'fail' else 'none' end as op from events),
f as (select job_id, min(seq) as first_end, arg_max(op, seq) as last_op, max(seq) as last_seq from l where op in ('complete', 'fail') group by all),
s as (select l.job_id, arg_max(concat(op, ' ', seq), seq) as stage from l left join f using (job_id) where op in ('create', 'stage') and (first_end is null or seq < first_end) group by all)
select job_id, case last_op when 'complete' then 'completed' when 'fail' then 'failed' else 'processing' end as status, stage, case when last_op = 'fail' then concat('error ', last_seq) end as error from s left join f using (job_id)""", media=False)
def job_states(m: Media) -> DataFrame:
    op = F.coalesce(F.create_map(*(F.lit(x) for kv in JOB_OPS.items() for x in kv))[F.col("event_type")], F.lit("none"))
    log = m.table("events").select(F.concat(F.lit("job-"), "user_id").alias("job_id"), F.col("event_id").alias("seq"), op.alias("op"))
    stage = F.concat_ws(" ", "op", F.col("seq").cast("string"))
    return tasklog.job_state(log.withColumns({"stage": stage, "error": F.concat(F.lit("error "), F.col("seq").cast("string"))}))


@query("""select event_id, case when event_id % 2 = 0 and event_id % 3 = 0 then 'delete' when event_id % 2 = 0 then 'retain' else 'preserve' end as action, case event_id % 4 when 0 then 'dead_letter' when 1 then 'dead_letter' else 'retry' end as error_kind,
case when event_id % 5 = 0 then 3723.5::double else 0.0::double end as strict, event_id % 3 = 0 as is_object, case when event_id % 2 = 0 then concat('a', event_id) else '' end as said from events""", media=False)
def decision_tables(m: Media) -> DataFrame:
    e = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("payload", "storage", "timeout", "other"))), (e % 4 + 1).cast("int"))
    stamp = F.when(e % 5 == 0, F.lit("01:02:03.500")).otherwise(F.lit("1:2"))
    text = F.when(e % 3 == 0, F.lit('{"a": 1}')).when(e % 3 == 1, F.lit("[1]")).otherwise(F.lit("{broken"))
    parts = F.when(e % 2 == 0, F.array(F.lit(" a"), F.lit(None), e.cast("string")))
    return m.table("events").select(
        "event_id", retention.source_action(e % 3 == 0, e % 2 == 0).alias("action"), tasklog.error_kind(kind).alias("error_kind"),
        timecode.parse_timecode_strict(stamp).alias("strict"), plugins.json_object(text).isNotNull().alias("is_object"), plugins.text_of(parts).alias("said"),
    )


@query("""select event_id, concat('in/', event_id) as source_key, 2 as n_scenes, cast(event_id as double) as first_start from events""", media=False)
def payload_roundtrip(m: Media) -> DataFrame:
    e = F.col("event_id").cast("double")
    spans = F.array(F.array(e, e + 1), F.array(e), F.array(e + 2, e + 3), F.array(e, F.lit(None)))
    sent = m.table("events").select("event_id", tasklog.encoded_payload(F.lit("j"), spans, F.concat(F.lit("in/"), F.col("event_id").cast("string"))).alias("payload"))
    out = tasklog.decoded_payload(sent)
    return out.select("event_id", "source_key", F.size("scenes").cast("long").alias("n_scenes"), F.get(F.get("scenes", F.lit(0)), F.lit(0)).alias("first_start"))


@query("""select job_id, frame_id, concat('/static/', job_id, '/det/frame_', frame_id, '.jpg') as detection, concat('/static/', job_id, '/original/frame_', frame_id, '.jpg') as original, 4 as n from media_frames""")
def local_frame_files(m: Media) -> DataFrame:
    files = m.frames.select("job_id", "frame_id", results.frame_files(F.col("job_id"), F.col("frame_id"), stored=False).alias("f"))
    return files.select("job_id", "frame_id", F.col("f")["detection"].alias("detection"), F.col("f")["original"].alias("original"), F.size("f").cast("long").alias("n"))


@query(IDENTITY_SQL + """, keyed as (select job_id, scene_id, count(distinct scene_person_id) as clusters from scene_people group by all)
select job_id, scene_id, clusters, 2 * count(*) as faces from keyed join media_faces using (job_id, scene_id) group by all""")
def scene_identity_summary(m: Media) -> DataFrame:
    # The same faces seen in keyframes and in tracking samples: twice the observations, no more people.
    both = m.observations.unionByName(m.observations.withColumn("source", F.lit("tracking")))
    return identity.scene_summary(identity.scene_identities(both))


@query(PACKET_SQL.format(k=8) + """
select s.job_id, s.scene_id, start_sec, end_sec, coalesce((select string_agg(concat(event, '=', n, ' ', evidence), ',' order by rank) from events_ranked e where rank <= 8 and e.job_id = s.job_id and e.scene_id = s.scene_id), '') as events,
 coalesce((select string_agg(concat(entity_type, ' ', name), ',' order by rank) from entities e where e.job_id = s.job_id and e.scene_id = s.scene_id), '') as entities from media_scenes s""")
def packet_json_fields(m: Media) -> DataFrame:
    e = _packets(m, 8)
    packets = evidence.packet_json(m.scenes, e, scenes.event_counts(e), scenes.scene_totals(e))
    kind = "struct<job_id:string,scene_id:bigint,start_sec:double,end_sec:double,events:array<struct<count:bigint,event:string,evidence:string>>,entities:array<struct<entity_type:string,name:string>>>"
    p = packets.select(F.from_json("packet", kind).alias("p"))
    happened = F.transform("p.events", lambda x: F.concat(x["event"], F.lit("="), x["count"].cast("string"), F.lit(" "), x["evidence"]))
    named = F.transform("p.entities", lambda x: F.concat_ws(" ", x["entity_type"], x["name"]))
    return p.select("p.job_id", "p.scene_id", "p.start_sec", "p.end_sec", F.array_join(happened, ",").alias("events"), F.array_join(named, ",").alias("entities"))


@query(PACKET_SQL.format(k=8) + """,
e as (select job_id, scene_id, list({'count': n, 'entity_type': entity_type, 'name': name} order by rank) as entities from entities group by all),
v as (select job_id, scene_id, list({'count': n, 'event': event, 'evidence': evidence} order by rank) as events from events_ranked where rank <= 8 group by all),
p as (select job_id, scene_id, cast(to_json({'duration_sec': end_sec - start_sec, 'end_sec': end_sec, 'entities': coalesce(entities, []), 'events': coalesce(events, []), 'faces_total': coalesce(faces_total, 0),
 'job_id': job_id, 'objects_total': coalesce(objects_total, 0), 'scene_id': scene_id, 'start_sec': start_sec, 'unique_labels': coalesce(unique_labels, 0)}) as varchar) as packet
 from media_scenes left join e using (job_id, scene_id) left join v using (job_id, scene_id) left join totals using (job_id, scene_id))
select job_id, scene_id, packet, cast(octet_length(encode(packet)) as bigint) as n_bytes, sha256(packet) as packet_sha256 from p""")
def packet_bytes(m: Media) -> DataFrame:
    e = _packets(m, 8)
    return evidence.packet_bytes(evidence.packet_json(m.scenes, e, scenes.event_counts(e), scenes.scene_totals(e)))


@query(EVIDENCE_SQL + """, o as (select *, row_number() over (partition by job_id, scene_id order by frame_id, modality) as rn, count(*) over (partition by job_id, scene_id) as n from named)
select s.job_id, s.scene_id, 1 + 2 * coalesce(max(n), 0) as n_messages, concat('You describe one scene of a recording.\n\nUse only what the packet and its evidence show.\n\nWrite one short paragraph in order of time.\n\nAnswer with JSON: narrative_paragraph, key_moments, mentioned_entities, mentioned_events.\n\nProfile v2. Packet:\n{"scene": ', s.scene_id, '}') as head,
 max(case when rn = 1 then concat('Evidence ', evidence_id, ' ', json_artifact_key) end) as first_text, max(case when rn = n then image_uri end) as last_image
from media_scenes s left join o using (job_id, scene_id) group by s.job_id, s.scene_id""")
def scene_messages(m: Media) -> DataFrame:
    refs = evidence.evidence_refs(evidence.frame_contexts(scenes.in_scenes(m.frames, m.scenes), m.faces))
    packets = m.scenes.select("job_id", "scene_id", F.format_string('{"scene": %d}', "scene_id").alias("packet"))
    out = narrative.messages(refs, packets, "v2")
    at = lambda i: F.get("messages", F.lit(i))["value"]
    last = F.element_at("messages", -1)
    shown = F.when(last["type"] == "image", last["value"]).alias("last_image")
    return out.select("job_id", "scene_id", F.size("messages").cast("long").alias("n_messages"), at(0).alias("head"), at(1).alias("first_text"), shown)


@query("""select job_id, scene_id, 'narrative' as stage, 'nano' as model, job_id as traced_job, true as untraced, 'w1' as worker from media_scenes""")
def narrative_traces(m: Media) -> DataFrame:
    made = tasklog.worker_provenance(m.scenes, "w1", "nano").withColumns({"on": narrative.trace(True, "narrative", "nano"), "off": narrative.trace(False, "narrative", "nano")})
    t = F.col("on")
    return made.select("job_id", "scene_id", t["stage"].alias("stage"), t["model"].alias("model"), t["job_id"].alias("traced_job"), F.col("off").isNull().alias("untraced"), F.col("worker.worker_id").alias("worker"))


@query("""select job_id, scene_id, case scene_id % 3 when 0 then concat('Scene ', scene_id) end as narrative, case scene_id % 3 when 0 then 'start,end' end as key_moments,
case scene_id % 3 when 1 then 'unsupported: ghost' when 2 then 'incomplete output' end as error from media_scenes""")
def narratives_by_client(m: Media) -> DataFrame:
    # A client that answers well, claims too much or leaves its answer incomplete.
    def client(packet: str) -> dict:
        n = int(packet)
        told = {"narrative_paragraph": f"Scene {n}", "mentioned_entities": ["car"] + ["ghost"] * (n % 3 == 1), "mentioned_events": []}
        return told if n % 3 == 2 else told | {"key_moments": ["start", "end"]}

    packets = m.scenes.select("job_id", "scene_id", F.col("scene_id").cast("string").alias("packet"), F.array(F.lit("car")).alias("allowed_entities"), F.array(F.lit("car_observed")).alias("allowed_events"))
    return narrative.narratives_by(packets, client).withColumn("key_moments", F.array_join("key_moments", ","))


def _list_problems(f: str, least: int, missing: str) -> str:
    return f"""case when json_extract(a, '$.{f}') is null then {missing} when json_type(a, '$.{f}') <> 'ARRAY' then '{f}: not a list' when json_array_length(a, '$.{f}') < {least} then '{f}: fewer than {least}'
 else nullif(array_to_string(list_filter(list_transform(json_extract(a, '$.{f}[*]'), lambda x, i: case when json_type(x) <> 'VARCHAR' then concat('{f}[', i - 1, ']: not a text') end), lambda x: x is not null), '; '), '') end"""


#: Answers of a model, whole and malformed, made of a scene's first entities; the same text in both dialects.
ANSWER = """concat(case when scene_id % 13 = 0 then '[' else '' end, '{"narrative_paragraph": ', case when scene_id % 4 = 0 then 'null' when scene_id % 4 = 1 then '12' else concat('"', name, '"') end,
 case when n % 5 = 0 then '' when n % 5 = 1 then ', "key_moments": []' when n % 5 = 2 then ', "key_moments": "later"' when n % 5 = 3 then concat(', "key_moments": ["', name, '", ', n, ', null]') else concat(', "key_moments": ["', name, '"]') end,
 case when (scene_id + frames) % 3 = 0 then ', "mentioned_entities": null' when (scene_id + frames) % 3 = 1 then concat(', "mentioned_entities": ["', name, '", {"n": 1}]') else '' end, case when scene_id % 11 = 0 then '' else '}' end, case when scene_id % 13 = 0 then ']' else '' end)"""


@query(PACKET_SQL.format(k=1) + f""", f as (select job_id, scene_id, count(distinct frame_id) as frames from media_base group by all),
x as (select job_id, scene_id, {ANSWER} as a from entities join f using (job_id, scene_id))
select job_id, scene_id, case when not json_valid(a) then '$: not JSON' when json_type(a) <> 'OBJECT' then '$: not an object' else nullif(concat_ws('; ',
 case json_type(a, '$.narrative_paragraph') when 'VARCHAR' then null else 'narrative_paragraph: not a text' end,
 {_list_problems("key_moments", 1, "'key_moments: missing'")}, {_list_problems("mentioned_entities", 0, "null")}), '') end as problems from x""")
def narrative_contract(m: Media) -> DataFrame:
    """What is wrong with models' answers, by the path of each fault."""
    frames = m.base.groupBy("job_id", "scene_id").agg(F.countDistinct("frame_id").alias("frames"))
    answers = _packets(m, 1).join(frames, ["job_id", "scene_id"]).select("job_id", "scene_id", F.expr(ANSWER).alias("answer"))
    return answers.select("job_id", "scene_id", contracts.told(contracts.problems(F.col("answer"), contracts.NARRATIVE)).alias("problems"))


@query("""select event_id, concat('said ', event_type) as text, case when event_id % 2 = 0 then true end as is_blurry, 0 as n_actions from events""", media=False)
def enrichment_gather(m: Media) -> DataFrame:
    # Two of the five enrichers are registered, here as plain expressions.
    plug = plugins.Registry()
    plug.register("ocr_blocks", lambda c: F.to_json(F.array(F.struct(F.concat(F.lit("said "), c).alias("text")))))
    plug.register("quality", lambda c: F.when(F.col("event_id") % 2 == 0, F.lit('{"is_blurry": true}')))
    out = normalize.enrichment(plug.enrich(m.table("events").select("event_id", F.col("event_type").alias("content"))))
    return out.select("event_id", F.get("ocr_blocks", F.lit(0))["text"].alias("text"), F.col("quality.is_blurry").alias("is_blurry"), F.size("actions").alias("n_actions"))


@query("""select job_id, frame_id, det_index, case when least(60, x2) > x1 and least(50, y2) > y1 and least(60, x2) > greatest(0, x1) and least(50, y2) > greatest(0, y1)
then concat_ws(',', greatest(0, x1), greatest(0, y1), least(60, x2), least(50, y2)) end as crop from media_detections""")
def crop_boxes(m: Media) -> DataFrame:
    crop = identity.crop_box(geometry.Box.of(), F.lit(60), F.lit(50))
    return m.detections.select("job_id", "frame_id", "det_index", F.when(crop.isNotNull(), F.array_join(crop, ",")).alias("crop"))


@query("""select event_id, case when event_id % 3 = 0 then 422 when event_id % 7 > 4 then 413 else 200 end as status, concat('temp_media/j', event_id, '/input/source.', case when event_id % 2 = 0 then 'mov' else 'mp4' end) as path,
concat('jobs/j/corpus/graph/', case event_id % 3 when 0 then 'bundle.json' when 1 then concat('a_', event_id) else 'b.json' end) as key from events""", media=False)
def upload_decisions(m: Media) -> DataFrame:
    e = F.col("event_id")
    filename = F.when(e % 6 == 0, F.lit("")).when(e % 3 != 0, F.concat(F.lit("f"), e.cast("string")))
    extension = F.when(e % 2 == 0, F.lit(".MOV")).otherwise(F.lit("."))
    named = F.when(e % 6 == 0, F.lit(" \t")).when(e % 3 == 1, F.concat(F.lit(" a/"), e.cast("string"))).when(e % 3 == 2, F.lit("b.json\n"))
    path = ids.local_source_path(F.concat(F.lit("j"), e.cast("string")), extension)
    return m.table("events").select("event_id", ingest.upload_status(filename, (e % 7) * (100 << 20), 400 << 20).alias("status"), path.alias("path"), ids.corpus_key(F.lit("j"), "graph", named).alias("key"))


@query("""select job_id, concat('jobs/', job_id, '/corpus/rag/', case when n_scenes % 2 = 0 then 'scenes.json' else 'bundle.json' end) as key, concat('{"n_scenes":', n_scenes, ',"note":null}') as content
from (select job_id, count(*) as n_scenes from media_scenes group by all)""")
def corpus_bundles(m: Media) -> DataFrame:
    rows = m.scenes.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_scenes"))
    rows = rows.select("job_id", F.struct("n_scenes", F.lit(None).cast("string").alias("note")).alias("bundle"), F.when(F.col("n_scenes") % 2 == 0, "scenes.json").alias("filename"))
    return sinks.bundles(rows, "retrieval").select("job_id", "key", F.col("content").cast("string").alias("content"))


@query("""select distinct user_id as job_id from events where user_id % 5 <> 0 and (event_type = 'view' or user_id % 2 = 0)""", media=False)
def retention_markers(m: Media) -> DataFrame:
    jobs_of = m.table("events").select(F.col("user_id").alias("job_id"), "event_type")
    even = jobs_of.where("job_id % 2 = 0").select("job_id").distinct()
    marked = retention.with_markers(even, jobs_of.where("event_type = 'view'"))
    return retention.without_markers(marked, jobs_of.where("job_id % 5 = 0"))


@query("""select job_id, track_id, string_agg(distinct frame_id, ',' order by frame_id) as frame_ids, count(*) as n_timestamps, min(ts_sec) as first_seen, max(ts_sec) as last_seen from media_detections where label = 'person' group by all""")
def track_timelines(m: Media) -> DataFrame:
    out = fusion.track_timelines(fusion.persons(m.detections))
    at = lambda i: F.element_at("timestamps", i)
    return out.select("job_id", "track_id", F.array_join("frame_ids", ",").alias("frame_ids"), F.size("timestamps").cast("long").alias("n_timestamps"), at(1).alias("first_seen"), at(-1).alias("last_seen"))


@query("""select k.job_id, k.frame_id, k.scene_id, arg_max(label, det_index) as result from (select f.job_id, f.frame_id, s.scene_id from media_frames f join media_scenes s on f.job_id = s.job_id and f.ts_sec between s.start_sec and s.end_sec where f.frame_id % 2 = 0) k
join media_detections d on d.job_id = k.job_id and d.frame_id = k.frame_id group by all""")
def keyframe_results(m: Media) -> DataFrame:
    keyframes = scenes.in_scenes(m.frames.where("frame_id % 2 = 0"), m.scenes).select("job_id", "frame_id", "scene_id")
    found = m.detections.select("job_id", "frame_id", F.col("det_index").alias("pos"), F.col("label").alias("result"))
    return results.keyframe_results(found, keyframes)


@query("""select event_id, case when event_id % 5 = 0 then 'top' when event_id % 4 = 0 then '' else event_type end as kind, case when event_id % 4 = 0 then '' else 'low' end as a, case when event_id % 5 = 0 then 'b' else '' end as b from events""", media=False)
def overlaid_maps(m: Media) -> DataFrame:
    e = F.col("event_id")
    base = F.when(e % 4 != 0, F.create_map(F.lit("kind"), F.col("event_type"), F.lit("a"), F.lit("low")))
    top = F.when(e % 5 == 0, F.create_map(F.lit("b"), F.lit("b"), F.lit("kind"), F.lit("top")))
    of = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit("")).alias(k)
    return m.table("events").select("event_id", results.overlaid(base, top).alias("m")).select("event_id", *map(of, ("kind", "a", "b")))


@query("""select event_id as task_id, case when event_id % 5 >= 3 then 'dead_letter' else 'retry' end as status, case when event_id % 5 < 3 then cast(least(12, 5 * pow(2, greatest(0, event_id % 5 - 1))) as bigint) end as waits,
case when event_id % 5 < 3 then 'waiting_scene_ai' end as stage, case when event_id % 5 >= 3 then 'completed' else 'processing' end as job_status from events""", media=False)
def retry_outcomes(m: Media) -> DataFrame:
    failed = m.table("events").select(F.col("event_id").alias("task_id"), F.col("user_id").alias("job_id"), (F.col("event_id") % 5).alias("attempts"), F.lit("timeout").alias("error"))
    now = F.timestamp_seconds(F.lit(1000))
    out = tasklog.after_retry(failed, now, "fallback_empty", most=12)
    return out.select("task_id", "status", (F.unix_timestamp("next_attempt_at") - 1000).alias("waits"), "stage", "job_status")


@query("""with e as (select distinct user_id from events)
select concat('job-', user_id) as job_id, case when user_id % 3 = 0 then 200 else 409 end as code, case user_id % 3 when 1 then 'Job is still processing' when 2 then 'Job failed' end as detail,
case when user_id % 3 = 2 then case when user_id % 2 = 0 then 'lost' else 'Unknown error' end end as error, case when user_id % 6 = 0 then user_id end as frames from e""", media=False)
def readable_results(m: Media) -> DataFrame:
    u = F.col("user_id")
    known = m.table("events").select("user_id").distinct().select(F.concat(F.lit("job-"), u.cast("string")).alias("job_id"), "user_id")
    status = F.element_at(F.array(*map(F.lit, ("completed", "processing", "failed"))), (u % 3 + 1).cast("int"))
    states = known.select("job_id", status.alias("status"), F.when(u % 2 == 0, "lost").alias("error"))
    return results.readable_results(states, known.where("user_id % 2 = 0").select("job_id", u.alias("frames")))


@query("""select f.job_id, f.frame_id, concat_ws(',', case when count(d.event_id) filter (where d.event_id % 9 = 0) > 0 then 'empty box' end, case when count(d.event_id) filter (where d.event_id % 7 = 0) > 0 then 'confidence out of range' end) as broken,
case when count(d.event_id) filter (where d.event_id % 9 = 0 or d.event_id % 7 = 0) > 0 then 'quarantine/' else '' end || concat('jobs/', f.job_id, '/analysis/json/frame_', f.frame_id, '.json') as key
from media_frames f left join media_detections d on d.job_id = f.job_id and d.frame_id = f.frame_id group by f.job_id, f.frame_id""")
def frames_set_aside(m: Media) -> DataFrame:
    """Documents of frames with boxes turned over and confidences in percent, sorted out as they would be written."""
    e = F.col("event_id")
    faulty = m.detections.withColumns({"x2": F.when(e % 9 == 0, F.col("x1")).otherwise(F.col("x2")), "confidence": F.when(e % 7 == 0, 100 * F.col("confidence")).otherwise(F.col("confidence"))})
    documents = results.frame_documents(m.frames, faulty, m.faces, m.segments)
    keyed = documents.withColumns({"key": ids.analysis_key(F.col("job_id"), F.col("frame_id")), "content": F.to_json("analysis")})
    out = checked.sorted_out(keyed, results.document_rules())
    part = lambda i: F.regexp_extract("key", r"jobs/([^/]+)/.*?(\d+)\.json$", i)
    return out.select(part(1).alias("job_id"), part(2).cast("long").alias("frame_id"), F.array_join("broken", ",").alias("broken"), "key")


@query(""",
items as (select job_id, 'detection' as kind, event_id as pos, concat(label, ' ', x1, ',', y1, ' ', track_id) as body from media_detections
 union all select job_id, 'face', event_id, identity_id from media_faces),
run as (select *, strlen(body) as size, sum(strlen(body)) over (partition by job_id order by kind, pos rows unbounded preceding) as upto from items),
cut as (select *, (upto - size) // 100 as win from run),
num as (select *, dense_rank() over (partition by job_id order by win) - 1 as page from cut)
select job_id, page, case when page < max(page) over (partition by job_id) then page + 1 end as next_page, count(*) as n_items, cast(sum(size) as bigint) as bytes, string_agg(body, '|' order by kind, pos) as items
from num group by job_id, page""")
def result_pages(m: Media) -> DataFrame:
    label = F.concat("label", F.lit(" "), "x1", F.lit(","), "y1", F.lit(" "), "track_id")
    of = lambda rows, kind, body: rows.select("job_id", F.lit(kind).alias("kind"), F.col("event_id").alias("pos"), body.alias("body"))
    items = of(m.detections, "detection", label).unionByName(of(m.faces, "face", F.col("identity_id")))
    return results.pages(items, 200).withColumn("items", F.array_join("items.body", "|"))
