"""Sequences in ranges, trackers in segments, committed objects, whole jobs and frame documents."""

from __future__ import annotations

import random
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from framelake import shared
from framelake.operators import jobs, results, scenes, sequences, tracking
from framelake.sources import objects
from framelake.sources.media import Media

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_sequences_equal_plain_version(spark, parts):
    r = random.Random(parts)
    rows = [(job, i, r.randrange(-5, 6)) for job, n in (("a", 400), ("b", 1), ("c", 30)) for i in r.sample(range(1000), n)]
    ranges = sequences.in_ranges(spark.createDataFrame(rows, "job_id string, seq long, v long"), ["job_id"], ["seq"], parts)
    got = sequences.running(sequences.previous(ranges, ["job_id"], ["seq"], "v", "before"), ["job_id"], ["seq"], F.col("v"), "total")
    want, before, total = {}, {}, {}
    for job, i, v in sorted(rows):
        total[job] = total.get(job, 0) + v
        want[job, i] = (before.get(job), total[job])
        before[job] = v
    assert {(x.job_id, x.seq): (x.before, x.total) for x in got.collect()} == want


def test_no_window_of_a_whole_job(spark):
    shown = plan(scenes.cuts_from_scores(spark.createDataFrame([("j", 1, 1.0, 2.0)], "job_id string, seq long, ts_sec double, score double"), 1.0))
    windows = [x for x in shown.splitlines() if "Window [" in x]
    # Those by job alone go over one row for each range.
    assert windows and all("__part" in x for x in windows)


def test_scenes_are_numbered_by_time(spark):
    rows = [("a", float(x), float(x + 1)) for x in (5, 3, 9, 3, 0)] + [("b", 2.0, 3.0)]
    got = scenes.numbered_scenes(spark.createDataFrame(rows, "job_id string, start_sec double, end_sec double"))
    assert sorted((x.job_id, x.start_sec, x.scene_id) for x in got.collect()) == [("a", 0.0, 0), ("a", 3.0, 1), ("a", 5.0, 2), ("a", 9.0, 3), ("b", 2.0, 0)]


def boxes(n: int) -> list[tuple]:
    """One long job with gaps of all lengths, and a short one."""
    r, out, frame = random.Random(4), [], 0
    for _ in range(n):
        frame += r.choice([1, 1, 1, 2, 3, 4, 9])
        out += [("long", frame, i, r.choice("ab"), x := 10 * r.randrange(5), 0, x + 9, 9) for i in range(r.randrange(1, 4))]
    return [*out, *(("short", i, 0, "a", 0, 0, 9, 9) for i in range(6))]


def test_segments_of_a_long_job_equal_one_tracker(spark):
    df = spark.createDataFrame(boxes(600), "job_id string, frame_id long, det_index long, label string, x1 long, y1 long, x2 long, y2 long")
    whole = {tuple(r) for r in tracking.object_tracks(df).collect()}
    for least in (0, 100):
        assert {tuple(r) for r in tracking.object_tracks(df, whole=least).collect()} == whole
    cut = tracking.segments(df, tracking.MAX_GAP).groupBy("job_id").agg(F.max("segment").alias("n")).collect()
    assert dict(map(tuple, cut))["long"] > 50 and dict(map(tuple, cut))["short"] == 0
    m = Media(spark, "/root/testdata/sf0.01")
    assert {tuple(r) for r in tracking.face_tracks(m.faces, whole=0).collect()} == {tuple(r) for r in tracking.face_tracks(m.faces).collect()}


# --- objects --------------------------------------------------------------------


def files(root: Path) -> dict[str, bytes]:
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file() and not p.relative_to(root).parts[0].startswith("_")}


def rows_of(spark, n: int, bad: int | None = None):
    return spark.createDataFrame([(f"jobs/j/o{i}.json", None if i == bad else b"%d" % i) for i in range(n)], "key string, content binary")


def test_committed_objects(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert objects.committed(spark, root, "one") is None
    objects.write_objects(rows_of(spark, 50).union(rows_of(spark, 2)), root, "one")
    assert files(tmp_path) == {f"jobs/j/o{i}.json": b"%d" % i for i in range(50)}
    assert objects.committed(spark, root, "one").count() == 50
    (tmp_path / "jobs/j/o7.json").unlink()
    # Committed once, a name isn't written again.
    objects.write_objects(rows_of(spark, 50), root, "one")
    assert len(files(tmp_path)) == 49
    assert not (tmp_path / "_staged").exists() or not any((tmp_path / "_staged").iterdir())
    objects.write_objects(rows_of(spark, 0), root, "none")
    assert objects.committed(spark, root, "none").count() == 0


def test_a_failed_write_leaves_no_objects(spark, tmp_path):
    root = f"file://{tmp_path}"
    objects.write_objects(rows_of(spark, 3), root, "before")
    with pytest.raises(Exception, match="no content"):
        objects.write_objects(rows_of(spark, 400, bad=399), root, "failing")
    assert files(tmp_path) == {f"jobs/j/o{i}.json": b"%d" % i for i in range(3)}
    assert objects.committed(spark, root, "failing") is None
    objects.write_objects(rows_of(spark, 400), root, "failing")
    assert len(files(tmp_path)) == 400


def test_a_task_that_runs_again_writes_the_same_objects(tmp_path):
    w = objects.ObjectWriter(f"file://{tmp_path}", "x")

    def breaks():
        yield ("a/1", b"1")
        raise OSError("lost")

    with pytest.raises(OSError):
        w.write(breaks())
    assert files(tmp_path) == {}
    w.write(iter([("a/1", b"1"), ("a/2", "zwei")]))  # its message is lost
    again = w.write(iter([("a/1", b"1"), ("a/2", "zwei")]))
    w.commit([again, None])
    assert files(tmp_path) == {"a/1": b"1", "a/2": b"zwei"}
    other = objects.ObjectWriter(f"file://{tmp_path}", "y")
    other.abort([other.write(iter([("a/2", b"2"), ("a/3", b"3")]))])
    assert set(files(tmp_path)) == {"a/1", "a/2"}
    for key in ("", "/etc/x", "a/../b", "_staged/x"):
        with pytest.raises(ValueError):
            w.write(iter([(key, b"")]))
    with pytest.raises(ValueError):
        w.write(iter([("k", b"1"), ("k", b"2")]))


def test_narrative_objects_are_written(spark, tmp_path):
    m = Media(spark, SF)
    t = jobs.Tables(m.scenes, m.frames, m.detections, m.segments, m.faces)
    made = jobs.narrative_artifacts(jobs.told(t, jobs.scene_packets(t)), jobs.corpus_of(t)).withColumnRenamed("body", "content")
    objects.write_objects(made, f"file://{tmp_path}", "narratives")
    assert len(files(tmp_path)) == 3 * m.scenes.count() == objects.committed(spark, f"file://{tmp_path}", "narratives").count()


# --- documents and whole jobs ---------------------------------------------------


def test_frame_documents_take_one_exchange(spark):
    m = Media(spark, SF)
    flat = (spark.createDataFrame(x.limit(5).collect(), x.schema) for x in (m.frames, m.detections, m.faces, m.segments))
    shown = plan(results.frame_documents(*flat))
    assert shown.count("Exchange hashpartitioning") == 1 and "Join" not in shown


def test_documents_of_frames_without_anything(spark):
    m = Media(spark, SF)
    frames = spark.createDataFrame([("x", 1, 2.0)], "job_id string, frame_id long, ts_sec double")
    (d,) = results.frame_documents(frames, m.detections, m.faces, m.segments).collect()
    assert d.analysis.object_detection == [] and d.analysis.enrichment.ocr_blocks == [] and d.analysis.enrichment.quality is None
    assert d.metadata.evidence_anchors == [] and [x.component for x in d.metadata.model_provenance] == ["detector", "segmenter", "face_detector"]


def test_whole_job_deletes_what_stages_share(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_dir", lambda _, purpose: f"file://{tmp_path}/{purpose}-{uuid.uuid4().hex}")
    m = Media(spark, SF)
    with jobs.whole(jobs.Tables(m.scenes, m.frames, m.detections, m.segments, m.faces), m.observations, m.observations.limit(0)) as w:
        assert any(p.name.startswith("job-tracks") for p in tmp_path.iterdir())
        read = plan(w.artifacts) + plan(w.documents)
        assert "events.parquet" not in read and "embeddings.parquet" not in read
        assert w.understanding.packets.violations.count() == 0
    assert not list(tmp_path.iterdir())
