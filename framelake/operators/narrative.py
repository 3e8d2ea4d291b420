"""Narratives of scenes and the synopsis of a job.

Text generation is a plug-in point: any client that maps packets to text. The
deterministic client, which is also the fallback, is Column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import ids
from framelake.operators import contracts

SCENE = ["job_id", "scene_id"]


def _first(rows: DataFrame, value: str, k: int, name: str) -> DataFrame:
    listed = F.slice(F.array_sort(F.collect_list(F.struct("rank", value))), 1, k)
    return rows.groupBy(*SCENE).agg(F.transform(listed, lambda x: x[value]).alias(name))


def fallback_narratives(scenes: DataFrame, entities: DataFrame, events: DataFrame, totals: DataFrame) -> DataFrame:
    """(job, scene, start_sec, end_sec, narrative, key_moments, mentioned_entities, mentioned_events)."""
    rows = scenes.join(totals, SCENE, "left").join(_first(entities, "name", 3, "e"), SCENE, "left").join(_first(events, "event", 3, "v"), SCENE, "left")
    none = F.array().cast("array<string>")
    e, v = F.coalesce("e", none), F.coalesce("v", none)
    names = F.coalesce(F.nullif(F.array_join(e, ", "), F.lit("")), F.lit("no dominant entities"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    text = F.concat(
        F.format_string("From %.2fs to %.2fs, the scene shows ", "start_sec", "end_sec"), names, F.lit(" with "), n("objects_total"),
        F.lit(" object signals and "), n("faces_total"), F.lit(" face detections."),
    )
    moments = F.array(F.format_string("Scene duration is %.2f seconds.", F.col("end_sec") - F.col("start_sec")), F.concat(F.lit("Detected "), n("unique_labels"), F.lit(" unique labels.")))
    notable = F.when(F.size(v) > 0, F.array(F.concat(F.lit("Notable event: "), F.get(v, F.lit(0)), F.lit(".")))).otherwise(none)
    return rows.select(*SCENE, "start_sec", "end_sec", text.alias("narrative"), F.concat(moments, notable).alias("key_moments"), e.alias("mentioned_entities"), v.alias("mentioned_events"))


def unfaithful(narratives: DataFrame, entities: DataFrame, events: DataFrame) -> DataFrame:
    """Scenes whose narrative mentions entities or events that the packet doesn't have, with those."""
    allowed_e = entities.groupBy(*SCENE).agg(F.collect_set("name").alias("ok_e"))
    allowed_v = events.groupBy(*SCENE).agg(F.collect_set("event").alias("ok_v"))
    none = F.array().cast("array<string>")
    rows = narratives.join(allowed_e, SCENE, "left").join(allowed_v, SCENE, "left")
    extra = lambda said, ok: F.array_sort(F.array_except(F.coalesce(said, none), F.coalesce(ok, none)))
    rows = rows.select(*SCENE, extra("mentioned_entities", "ok_e").alias("entities"), extra("mentioned_events", "ok_v").alias("events"))
    return rows.where((F.size("entities") > 0) | (F.size("events") > 0))


def synopsis(narratives: DataFrame, text: str = "narrative") -> DataFrame:
    """(job_id, synopsis, scene_count, artifact): scenes in order of time, each with its span, joined by blanks."""
    part = F.struct("start_sec", "scene_id", F.concat(F.format_string("[%.2f-%.2fs] ", "start_sec", "end_sec"), F.col(text)).alias("part"))
    ordered = F.array_sort(F.collect_list(part))
    out = narratives.groupBy("job_id").agg(F.trim(F.array_join(F.transform(ordered, lambda x: x["part"]), " ")).alias("synopsis"), F.count(F.lit(1)).alias("scene_count"))
    return out.withColumn("artifact", ids.summary_key(F.col("job_id")))


def synopsis_by(narratives: DataFrame, refine: Callable[[str, dict], str], text: str = "narrative") -> DataFrame:
    """The same fold with any client: one group per job, each step sees the text so far."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        said = ""
        for row in pdf.sort_values(["start_sec", "scene_id"], kind="stable").to_dict("records"):
            said = refine(said, row).strip()
        return pd.DataFrame([(pdf["job_id"].iloc[0], said, len(pdf))], columns=["job_id", "synopsis", "scene_count"])

    rows = narratives.select(*SCENE, "start_sec", "end_sec", text)
    return rows.groupBy("job_id").applyInPandas(run, "job_id string, synopsis string, scene_count long")


def narratives_by(packets: DataFrame, generate: Callable[[str], dict], retries: int = 2) -> DataFrame:
    """Narratives of (job_id, scene_id, packet, allowed_entities, allowed_events) by any client.

    Output that breaks its contract or claims what the packet lacks is generated again, up
    to ``retries`` times; then the row has the error instead of text.
    """

    def attempt(row: dict) -> tuple:
        error = ""
        for _ in range(retries + 1):
            out = generate(row["packet"])
            if not isinstance(out, dict) or not out.get("narrative_paragraph") or not out.get("key_moments"):
                error = "incomplete output"
                continue
            if wrong := contracts.found(out, contracts.NARRATIVE):
                error = "; ".join(f"{path}: {reason}" for path, reason in wrong)
                continue
            extra = [x for x in out.get("mentioned_entities", []) if x not in row["allowed_entities"]]
            extra += [x for x in out.get("mentioned_events", []) if x not in row["allowed_events"]]
            if not extra:
                return out["narrative_paragraph"], list(out["key_moments"]), None
            error = f"unsupported: {', '.join(extra)}"
        return None, None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [attempt(r) for r in pdf.to_dict("records")]
            yield pdf[SCENE].assign(narrative=[f[0] for f in found], key_moments=[f[1] for f in found], error=[f[2] for f in found])

    kinds = "job_id string, scene_id long, narrative string, key_moments array<string>, error string"
    return packets.select(*SCENE, "packet", "allowed_entities", "allowed_events").mapInPandas(run, kinds)


#: The sections of a prompt, in order; texts are our own.
INSTRUCTIONS = ("You describe one scene of a recording.", "Use only what the packet and its evidence show.", "Write one short paragraph in order of time.", "Answer with JSON: narrative_paragraph, key_moments, mentioned_entities, mentioned_events.")


def prompt(packet: Column, version: str = "v1") -> Column:
    return F.concat_ws("\n\n", *map(F.lit, INSTRUCTIONS), F.concat(F.lit(f"Profile {version}. Packet:\n"), packet))


def messages(refs: DataFrame, packets: DataFrame, version: str = "v1") -> DataFrame:
    """Prompt, then text and image of each piece of evidence by frame and modality, as one array per scene."""
    part = F.struct("frame_id", "modality", F.concat_ws(" ", F.lit("Evidence"), "evidence_id", "json_artifact_key").alias("text"), "image_uri")
    listed = refs.groupBy(*SCENE).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    flat = F.flatten(F.transform("parts", lambda p: F.array(F.struct(F.lit("text").alias("type"), p["text"].alias("value")), F.struct(F.lit("image").alias("type"), p["image_uri"].alias("value")))))
    head = F.array(F.struct(F.lit("text").alias("type"), prompt(F.col("packet"), version).alias("value")))
    return packets.join(listed, SCENE, "left").select(*SCENE, F.coalesce(F.concat(head, flat), head).alias("messages"))


def trace(enabled: bool, stage: str, model: str) -> Column:
    """A map of tracing facts, or null."""
    facts = F.create_map(F.lit("stage"), F.lit(stage), F.lit("model"), F.lit(model), F.lit("job_id"), F.col("job_id"))
    return facts if enabled else F.lit(None).cast("map<string,string>")
