from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from framelake import config
from framelake.functions.geometry import Box
from framelake.operators import identity, normalize, plugins, results, tasklog
from framelake.sources import sinks
from framelake.sources.media import Media
from framelake.sources.store import ArtifactStore


def test_store(spark, tmp_path):
    store = ArtifactStore(f"file://{tmp_path}/objects")
    store.put("jobs/j/a.json", b"{}")
    assert store.exists("jobs/j/a.json") and not store.exists("jobs/j/b.json") and store.get("jobs/j/a.json") == b"{}"
    assert [r.key for r in store.keys(spark).collect()] == ["jobs/j/a.json"]
    assert store.sign("jobs/j/a.json").endswith("jobs/j/a.json?exp=3600")
    gone = store.delete_listed(spark.createDataFrame([("jobs/j/a.json",), ("jobs/none",)], "key string"))
    assert [r.key for r in gone.collect()] == ["jobs/j/a.json"] and not store.exists("jobs/j/a.json")
    with pytest.raises(ValueError):
        ArtifactStore("file:///x", url_ttl=0)


def test_enrichers(spark):
    frames = spark.createDataFrame([("j", 1, b"abc"), ("j", 2, None)], "job_id string, frame_id long, content binary")
    found = plugins.Registry()
    found.register("actions", lambda c: F.when(c.isNotNull(), F.lit('[{"label": "walk"}]')))
    got = {r.frame_id: r for r in normalize.enrichment(found.enrich(frames)).collect()}
    assert got[1].actions[0].label == "walk" and got[2].actions == [] and got[1].ocr_blocks == [] and got[1].camera_motion is None
    with pytest.raises(ValueError):
        found.register("odd", lambda c: c)
    sized = plugins.run_model(frames, "size", lambda: lambda pdf: pd.DataFrame({"frame_id": pdf.frame_id, "n": pdf.content.map(lambda b: len(b or b""))}), "frame_id long, n long")
    assert {tuple(r) for r in sized.collect()} == {(1, 3), (2, 0)}


def test_answers(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ("[1]",), ("{",), ("3",), (None,)], "t string")
    assert [r[0] is not None for r in rows.select(plugins.json_object(F.col("t"))).collect()] == [True, False, False, False, False]
    parts = spark.range(1).select(plugins.text_of(F.array(F.lit(" a"), F.lit(None), F.lit("b "))), plugins.text_of(F.lit(None).cast("array<string>"))).first()
    assert list(parts) == ["ab", ""]


def test_identity_pipeline_keeps_sources_apart(spark):
    m = Media(spark, "/root/testdata/sf0.001")
    samples = m.observations.drop("source").withColumn("vec_id", F.col("vec_id"))
    faces, people = identity.identify(m.faces, m.observations.drop("source"), samples)
    alone, _ = identity.identify(m.faces, m.observations.drop("source"))
    key = lambda t: sorted((r.job_id, r.frame_id, r.face_id, r.identity_id) for r in t.collect())
    assert key(faces) == key(alone) and people.count() > 0
    box = Box(*map(F.lit, (-5, 2, 30, 40)))
    assert spark.range(1).select(identity.crop_box(box, F.lit(20), F.lit(20))).first()[0] == [0, 2, 20, 20]


def test_missing_settings_and_warnings():
    env = {k: "x" for k in (*config.STORE_KEYS, *config.CLIENT_KEYS)}
    plain = config.Settings.load({})
    assert config.missing_settings(plain, env) == {"storage": [], "narratives": [], "embeddings": ["embedding_model"], "identities": []}
    assert config.startup_warnings(plain, env) == [] and not config.queue_mode(plain)
    busy = config.Settings.load({f"X_{k}": v for k, v in {"SCENE_PIPELINE": "on", "IDENTITY_PIPELINE": "1", "IDENTITY_MODEL": "odd", "CORPUS_INGEST": "true", "EXECUTION_MODE": "queue", "SAMPLE_FPS": "0.5", "EMBEDDING_MODEL": "m"}.items()}, prefix="X_")
    found = config.missing_settings(busy, {})
    assert found == {"storage": list(config.STORE_KEYS), "narratives": ["CLIENT_KEY"], "embeddings": ["CLIENT_KEY"], "identities": ["identity_model", "sample_fps"]}
    assert config.queue_mode(busy) and len(config.startup_warnings(busy, {})) == 5
    with pytest.raises(ValueError):
        config.identity_model(busy)
    assert config.identity_model(config.Settings(identity_model="odd")) == "fallback"
    assert config.Settings.load({"FRAMELAKE_EXECUTION_MODE": "other"}).execution_mode == "in_process"


def test_bundles_are_written_or_named(spark, tmp_path):
    rows = spark.createDataFrame([("j1", {"a": "1"}, " x/y.json"), ("j2", {"b": None}, None)], "job_id string, bundle map<string,string>, filename string")
    keys = ["jobs/j1/corpus/graph/x_y.json", "jobs/j2/corpus/graph/bundle.json"]
    assert sorted(r.key for r in sinks.write_bundles(rows, "graph").collect()) == keys
    assert not list(tmp_path.iterdir())
    assert sorted(r.key for r in sinks.write_bundles(rows, "graph", f"file://{tmp_path}").collect()) == keys
    assert [(tmp_path / k).read_text() for k in keys] == ['{"a":"1"}', '{"b":null}']


def test_results_after_retries(spark):
    tasks = spark.createDataFrame([(1, "a", 1, "x"), (2, "b", 3, "y")], "task_id long, job_id string, attempts int, error string")
    out = {r.task_id: r for r in tasklog.after_retry(tasks, F.timestamp_seconds(F.lit(0)), base=7).collect()}
    assert (out[1].status, out[1].stage, out[1].job_status, out[1].next_attempt_at.timestamp()) == ("retry", "waiting_scene_ai", "processing", 7.0)
    assert (out[2].status, out[2].stage, out[2].job_status, out[2].next_attempt_at) == ("dead_letter", None, "failed", None)
    states = spark.createDataFrame([("a", "completed", None), ("b", "failed", "y")], "job_id string, status string, error string")
    assert results.job_status(states, "c").count() == 0
    assert [tuple(r) for r in results.job_status(states, "b").collect()] == [("b", "failed", "y")]
