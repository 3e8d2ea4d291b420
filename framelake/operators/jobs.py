"""Whole jobs: packets, narratives, synopsis, corpus and results from flat tables, for any number of jobs at once.

Each step is a lazy plan over the tables of all jobs; Spark runs what a caller
writes or shows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import ids
from framelake.operators import corpus, evidence, fusion, identity, narrative, results
from framelake.operators import scenes as packets
from framelake.operators.scenes import SCENE
from framelake.shared import scratch, written


class Tables(NamedTuple):
    """What models have found in the frames of jobs."""

    scenes: DataFrame
    frames: DataFrame
    detections: DataFrame
    segments: DataFrame
    faces: DataFrame


class Packets(NamedTuple):
    entities: DataFrame
    events: DataFrame
    totals: DataFrame
    keyframes: DataFrame
    refs: DataFrame
    violations: DataFrame
    packets: DataFrame


class Corpus(NamedTuple):
    entities: DataFrame
    events: DataFrame
    relations: DataFrame
    chunks: DataFrame
    scene_chunks: DataFrame


class Understanding(NamedTuple):
    packets: Packets
    narratives: DataFrame
    synopses: DataFrame
    corpus: Corpus


def placed(t: Tables) -> Tables:
    """The same tables with each row in its scenes; what several stages ask for, joined once."""
    inside = lambda rows: packets.in_scenes(rows, t.scenes)
    return Tables(t.scenes, *map(inside, (t.frames, t.detections, t.segments, t.faces)))


def scene_packets(t: Tables, max_entities: int = packets.MAX_ENTITIES, max_events: int = packets.MAX_EVENTS, max_keyframes: int = packets.MAX_KEYFRAMES, threshold: int = packets.LABEL_THRESHOLD, inside: Tables | None = None) -> Packets:
    """Frames put into scenes, entities and events counted, keyframes picked, evidence listed and checked, packets written as JSON.

    Everything but evidence is made of the counted entities, so these are written once.
    """
    inside = inside or placed(t)
    found = written(packets.entity_counts(inside.detections, inside.segments, inside.faces, max_entities), "job-counts")
    events, totals = packets.event_counts(found, max_events), packets.scene_totals(found)
    contexts = evidence.frame_contexts(inside.frames, t.faces)
    refs = evidence.evidence_refs(contexts)
    keyframes = packets.keyframes(inside.frames, totals, threshold, max_keyframes)
    return Packets(found, events, totals, keyframes, refs, evidence.violations(t.scenes, contexts, refs), evidence.packet_json(t.scenes, found, events, totals))


def corpus_of(t: Tables, inside: Tables | None = None) -> Corpus:
    """The graph of each scene, and retrieval chunks: of scenes, or of frames for jobs without any scene.

    Sightings, entities and scene chunks are read by several of these, so written once.
    """
    inside = inside or placed(t)
    faces = inside.faces if "confidence" in inside.faces.columns else inside.faces.withColumn("confidence", F.lit(0.0))
    seen = written(corpus.sightings(inside.detections, faces), "corpus-sightings")
    found = written(corpus.entities(seen), "corpus-entities")
    told_of = written(corpus.scene_chunks(t.scenes, found), "corpus-scene-chunks")
    listed = told_of.select(*SCENE, "start_sec", "end_sec", F.lit("").alias("narrative"), F.array(F.struct("chunk_id", "text", "artifact_keys", "source_entity_ids")).alias("chunks"))
    return Corpus(found, corpus.events(found), corpus.relations(seen, found), corpus.retrieval_bundle(listed, t.frames, t.detections, t.faces), told_of)


def told(t: Tables, p: Packets) -> DataFrame:
    """The narratives of scenes; one that claims what its packet lacks is left out."""
    said = narrative.fallback_narratives(t.scenes, p.entities, p.events, p.totals)
    return said.join(narrative.unfaithful(said, p.entities, p.events).select(*SCENE), SCENE, "left_anti")


def understand(t: Tables, inside: Tables | None = None) -> Understanding:
    """Packets, then narratives, then synopses, and the corpus beside them."""
    p = scene_packets(t, inside=inside)
    said = told(t, p)
    return Understanding(p, said, narrative.synopsis(said), corpus_of(t, inside))


class Whole(NamedTuple):
    """All results of whole jobs; each table may be read as often as wanted while its scope is open."""

    tables: Tables
    assigned: DataFrame
    stitched: DataFrame
    identities: DataFrame
    person_tracks: DataFrame
    understanding: Understanding
    documents: DataFrame
    artifacts: DataFrame


@contextmanager
def whole(t: Tables, keyframes: DataFrame, tracking: DataFrame | None = None, enriched: DataFrame | None = None, models: dict[str, tuple[str, str]] | None = None, model_id: str = "embedding") -> Iterator[Whole]:
    """From observations to all results: identity, fusion, packets, narratives, synopses, corpus, documents and objects.

    ``keyframes`` and ``tracking`` are face observations with embeddings. What more
    than one stage reads is computed once and written to shared storage: scene
    clusters, identified faces, best persons, detections with their fused tracks,
    rows in their scenes, counted packets, narratives, corpus entities and
    relations. These tables are deleted when the scope ends.
    """
    spark = t.frames.sparkSession
    with scratch(spark):
        # Scanned once here; every later stage reads what is written.
        t = Tables(*(written(x, f"job-{name}") for name, x in t._asdict().items()))
        seen = keyframes.withColumn("source", F.lit("keyframe"))
        if tracking is not None:
            seen = seen.unionByName(tracking.withColumn("source", F.lit("tracking")), allowMissingColumns=True)
        assigned = written(identity.scene_identities(seen), "job-identities")
        stitched = written(identity.video_identities(identity.scene_clusters(assigned)), "job-stitched")
        faces = written(identity.annotated_faces(t.faces.withColumn("source", F.lit("keyframe")), assigned, stitched, model_id).drop("source"), "job-faces")
        people = fusion.persons(t.detections)
        tracks = written(fusion.fused_tracks(people, written(fusion.matched(people, fusion.with_identity(faces)), "job-matches")), "job-tracks")
        detections = written(fusion.annotated(t.detections, tracks), "job-detections")
        t = t._replace(faces=faces, detections=detections)
        inside = Tables(*(written(x, f"job-placed-{name}") if name != "scenes" else x for name, x in placed(t)._asdict().items()))
        p = scene_packets(t, inside=inside)
        said = written(told(t, p), "job-narratives")
        c = corpus_of(t, inside)
        c = c._replace(relations=written(c.relations, "job-relations"), chunks=written(c.chunks, "job-chunks"))
        u = Understanding(p, said, narrative.synopsis(said), c)
        documents = results.frame_documents(t.frames, t.detections, t.faces, t.segments, enriched, models)
        yield Whole(t, assigned, stitched, identity.video_summary(stitched), tracks, u, documents, narrative_artifacts(said, c))


def without_scenes(t: Tables) -> Tables:
    """What is left of jobs whose scenes can't be told: frames and what is in them."""
    return t._replace(scenes=t.scenes.limit(0))


def scene_corpus(scenes: DataFrame, c: Corpus) -> DataFrame:
    """(job_id, scene_id, entities, events, relations, retrieval_chunks) of each scene, by one exchange; lists by count, then name."""
    drop = [*SCENE, "start_sec", "end_sec", "first_seen", "last_seen", "duration_sec"]
    span = lambda a, z: F.struct(F.col(a).alias("first_seen"), F.col(z).alias("last_seen"), F.greatest(F.lit(0.0), F.col(z) - F.col(a)).alias("duration_sec")).alias("temporal_span")
    value = lambda rows: F.struct(*(x for x in rows.columns if x not in drop), span("first_seen", "last_seen"))
    fewer = (-F.col("count")).alias("fewer")
    kinds = {
        "entities": (c.entities, F.struct(fewer, "label", "entity_id"), value(c.entities)),
        "events": (c.events, F.struct(fewer, "event_type", "event_id"), value(c.events)),
        "relations": (c.relations, F.struct(fewer, "source_entity_id", "target_entity_id"), value(c.relations)),
        "retrieval_chunks": (c.scene_chunks, F.struct("chunk_id"), F.struct("chunk_id", "text", "source_entity_ids", "artifact_keys", span("start_sec", "end_sec"))),
    }
    return results.grouped_kinds(scenes.select(*SCENE), kinds, SCENE, [])


def narrative_artifacts(narratives: DataFrame, c: Corpus) -> DataFrame:
    """(job_id, scene_id, key, body): each narrative as an object of its own, and the scene's corpus as one for the graph and one for retrieval."""
    job, scene = F.col("job_id"), F.col("scene_id")
    name = F.concat(F.lit("scene_"), scene.cast("string"), F.lit(".json"))
    graph, retrieval = ids.corpus_key(job, "graph", name), ids.corpus_key(job, "retrieval", name)
    rows = narratives.join(scene_corpus(narratives, c), SCENE)
    keep_nulls = {"ignoreNullFields": "false"}
    said = F.to_json(F.struct("scene_id", "start_sec", "end_sec", F.col("narrative").alias("narrative_paragraph"), "key_moments", ids.scene_key(job, "packet", scene).alias("packet")), keep_nulls)
    listed = F.to_json(F.struct("scene_id", "entities", "events", "relations", "retrieval_chunks", F.struct(graph.alias("graph_bundle"), retrieval.alias("retrieval_bundle")).alias("artifacts")), keep_nulls)
    objects = F.array(F.struct(ids.scene_key(job, "narrative", scene).alias("key"), said.alias("body")), F.struct(graph.alias("key"), listed.alias("body")), F.struct(retrieval.alias("key"), listed.alias("body")))
    return rows.select(*SCENE, F.explode(objects).alias("o")).select(*SCENE, "o.key", "o.body")


def scene_outputs(rows: DataFrame, json_col: str = "outputs") -> DataFrame:
    """Adds scene_narratives and video_synopsis of a JSON object; parts of another shape are an empty list and null."""
    parsed = F.from_json(json_col, "struct<scene_narratives:string,video_synopsis:string>")
    listed = F.from_json(F.when(parsed["scene_narratives"].startswith("["), parsed["scene_narratives"]), "array<string>")
    synopsis = F.when(parsed["video_synopsis"].startswith("{"), parsed["video_synopsis"])
    return rows.withColumns({"scene_narratives": F.coalesce(listed, F.array().cast("array<string>")), "video_synopsis": synopsis})


def job_results(t: Tables, u: Understanding, states: DataFrame, job_id: str | None = None) -> DataFrame:
    """One row for each job with a state (job_id, status): frames, narratives with signed packet URLs, synopsis and corpus.

    Lists are empty where a job has nothing; one job only if given.
    """
    pick = lambda df: df if job_id is None else df.where(F.col("job_id") == job_id)

    def listed(rows: DataFrame, fields: list, name: str) -> DataFrame:
        return pick(rows).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))

    url = results.to_url(ids.scene_key(F.col("job_id"), "packet", F.col("scene_id"))).alias("packet_url")
    parts = [
        listed(t.frames, ["frame_id", "ts_sec"], "frames"),
        listed(u.narratives, ["start_sec", "scene_id", "narrative", url], "scene_narratives"),
        listed(u.corpus.entities, ["scene_id", "entity_id", "label", "count"], "entities"),
        listed(u.corpus.events, ["scene_id", "event_id", "event_type"], "events"),
        listed(u.corpus.relations, ["scene_id", "relation_id", "count"], "relations"),
        listed(u.corpus.chunks, ["chunk_id", "text", "kind"], "chunks"),
    ]
    out = pick(states).select("job_id", "status").join(pick(u.synopses).select("job_id", "synopsis"), "job_id", "left")
    for part in parts:
        name = part.columns[1]
        out = out.join(part, "job_id", "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return out


def result_items(w: Whole) -> DataFrame:
    """(job_id, kind, pos, body) of everything whole jobs result in, one JSON text an item, for ``results.pages``."""
    c, said = w.understanding.corpus, w.understanding.narratives
    url = results.to_url(ids.scene_key(F.col("job_id"), "packet", F.col("scene_id"))).alias("packet_url")
    in_scene = lambda id_: F.format_string("%012d/%s", F.col("scene_id").cast("long"), F.col(id_))
    number = lambda n: F.format_string("%020d", F.col(n).cast("long"))

    def kind(rows: DataFrame, name: str, pos: Column, *more: Column) -> DataFrame:
        return rows.select("job_id", F.lit(name).alias("kind"), pos.alias("pos"), F.to_json(F.struct(*(x for x in rows.columns if x != "job_id"), *more), {"ignoreNullFields": "false"}).alias("body"))

    parts = [
        kind(w.documents, "frame", number("frame_id")),
        kind(said, "narrative", number("scene_id"), url),
        kind(w.understanding.packets.packets, "packet", number("scene_id")),
        kind(w.understanding.synopses, "synopsis", F.lit("")),
        kind(c.entities, "entity", in_scene("entity_id")),
        kind(c.events, "event", in_scene("event_id")),
        kind(c.relations, "relation", in_scene("relation_id")),
        kind(c.chunks, "chunk", F.col("chunk_id")),
        kind(w.identities, "identity", F.col("video_person_id")),
        kind(w.person_tracks, "person_track", F.col("person_track_id")),
        kind(w.artifacts.select("job_id", "key"), "artifact", F.col("key")),
    ]
    return reduce(DataFrame.unionByName, parts)
