"""Scenarios with known results, and invariants of order-dependent operators."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelake.config import Settings, model_id
from framelake.functions import geometry, ids, timecode
from framelake.operators import corpus, fusion, identity, intervals, narrative, normalize, results, retention, scenes, sequences, tasklog, tracking
from framelake.sources import sinks
from framelake.sources.media import Media

DETECTION = "job_id string, frame_id long, ts_sec double, det_index long, label string, track_id string, confidence double, x1 long, y1 long, x2 long, y2 long"
FACE = "job_id string, frame_id long, ts_sec double, face_id long, identity_id string, video_person_id string, match_confidence double, x1 long, y1 long, x2 long, y2 long"


def fused(spark, detections, faces):
    d = spark.createDataFrame([("j", f, float(f), i, "Person ", t, 0.9, *b) for f, i, t, b in detections], DETECTION)
    a = spark.createDataFrame([("j", f, float(f), i, None, v, c, *b) for f, i, v, c, b in faces], FACE)
    out = fusion.fuse(d, a)
    return out.collect(), fusion.annotated(d, out).collect()


def test_two_tracks_of_one_person_are_fused(spark):
    tracks, marked = fused(
        spark,
        [(0, 1, "person_1", (10, 10, 110, 210)), (1, 1, "person_9", (15, 12, 115, 212))],
        [(0, 1, "video_person_7", 0.95, (30, 30, 70, 90)), (1, 1, "video_person_7", 0.92, (35, 30, 75, 88))],
    )
    (t,) = tracks
    assert t.identity_id == "video_person_7" and t.object_track_ids == ["person_1", "person_9"]
    assert {r.person_track_id for r in marked} == {t.person_track_id} and t.observation_count == 2


def test_person_without_faces(spark):
    (t,), marked = fused(spark, [(0, 1, "person_1", (10, 10, 110, 210))], [])
    assert t.identity_id is None and t.person_track_id.startswith("person_track_") and marked[0].person_identity_id is None


def test_two_identities_on_one_track_are_ambiguous(spark):
    box, face = (10, 10, 110, 210), (30, 30, 70, 90)
    (t,), _ = fused(spark, [(0, 1, "person_11", box), (1, 1, "person_11", box)], [(0, 1, "A", 0.9, face), (1, 1, "B", 0.89, face)])
    assert t.identity_id is None and t.is_identity_ambiguous


def observations(spark, rows):
    return spark.createDataFrame([("j", s, f, i, "keyframe", [float(x) for x in v]) for s, f, i, v in rows], "job_id string, scene_id long, frame_id long, face_id long, source string, embedding array<float>")


def test_close_faces_share_a_cluster(spark):
    got = identity.scene_identities(observations(spark, [(0, 1, 1, [1, 0, 0]), (0, 50, 1, [0.98, 0.02, 0])]), 0.75, 0.02).collect()
    assert {r.scene_person_id for r in got} == {"scene_0_person_1"}


def test_an_ambiguous_face_opens_a_cluster(spark):
    rows = [(0, 1, 1, [1, 0, 0]), (0, 2, 1, [0, 1, 0]), (0, 3, 1, [0.72, 0.70, 0])]
    got = {r.frame_id: r for r in identity.scene_identities(observations(spark, rows), 0.5, 0.05).collect()}
    assert got[3].is_identity_ambiguous and got[3].scene_person_id == "scene_0_person_3" and got[3].match_confidence == 1.0


@pytest.mark.parametrize("vectors, people", [(([1, 0, 0], [0.99, 0.01, 0]), 1), (([1, 0, 0], [0, 1, 0]), 2)])
def test_stitching_scenes(spark, vectors, people):
    assigned = identity.scene_identities(observations(spark, [(i, 1, 1, v) for i, v in enumerate(vectors)]))
    stitched = identity.video_identities(identity.scene_clusters(assigned), 0.8, 0.03)
    summary = identity.video_summary(stitched).collect()
    assert len(summary) == people
    if people == 1:
        assert summary[0].scene_person_ids == ["scene_0_person_1", "scene_1_person_1"]


def test_fallback_embedding_is_repeatable():
    a = identity.fallback_embedding(b"crop", 64)
    assert len(a) == 64 and (a == identity.fallback_embedding(b"crop", 64)).all() and abs(float(a @ a) - 1) < 1e-5


def test_tracker_keeps_a_moving_box():
    t = tracking.Tracker(0.2, 3)
    assert t.frame(0, [("person", (10, 20, 30, 40))]) == t.frame(1, [("person", (12, 21, 32, 41))]) == [1]
    assert t.frame(2, [("car", (12, 21, 32, 41))]) == [2]
    assert t.frame(6, [("person", (12, 21, 32, 41))]) == [3]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.sampled_from("ab"), st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_tracker_invariants(items):
    rows = pd.DataFrame([(f, i, label, x, y, x + 10, y + 10) for i, (f, label, x, y) in enumerate(items)], columns=["frame_id", "i", "label", *tracking.BOX])
    if rows.empty:
        return
    n = tracking.number_rows(tracking.Tracker(0.25), rows, "label", ["frame_id", "i"])
    rows["n"] = n
    assert sorted(set(n)) == list(range(1, n.max() + 1))
    assert not rows.duplicated(["frame_id", "n"]).any()
    assert (rows.groupby("n")["label"].nunique() == 1).all()
    again = tracking.number_rows(tracking.Tracker(0.25), rows.sample(frac=1, random_state=1), "label", ["frame_id", "i"])
    assert (again.sort_index() == n.sort_index()).all()


def test_streaming_tracks_equal_batch_tracks(spark, tmp_path):
    from framelake.streaming import tracking as streaming

    r = random.Random(4)
    rows = [(f"job-{j}", f, float(f), i, r.choice(["person", "car"]), None, 0.5, x := r.randint(0, 60), 0, x + 40, 50) for j in range(4) for f in range(12) for i in range(1, 3)]
    df = spark.createDataFrame(rows, DETECTION)
    for k in range(3):
        df.where(f"frame_id >= {4 * k} and frame_id < {4 * k + 4}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.object_tracks(stream).writeStream.format("memory").queryName("tracks").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda t: sorted((x.job_id, x.frame_id, x.det_index, x.track_num) for x in t.collect())
    assert key(spark.table("tracks")) == key(tracking.object_tracks(df))


def test_streaming_tracks_keep_split_frames(spark, tmp_path):
    from framelake.streaming import tracking as streaming

    rows = [("j", f, float(f), i, "person", None, 0.5, 30 * i + f, 0, 30 * i + f + 40, 50) for f in range(4) for i in range(1, 4)]
    df = spark.createDataFrame(rows, DETECTION)
    for part in ("frame_id < 2 or (frame_id = 2 and det_index = 1)", "(frame_id = 2 and det_index > 1) or frame_id = 3"):
        df.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.object_tracks(stream).writeStream.format("memory").queryName("split_tracks").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda t: sorted((x.job_id, x.frame_id, x.det_index, x.track_num) for x in t.collect())
    assert key(spark.table("split_tracks")) == key(tracking.object_tracks(df))


def plain_clusters(vectors: list, least: float, margin: float) -> tuple[list[tuple], list]:
    """(cluster, confidence, ambiguous) of vectors in their order, and the centroids; float32 throughout."""
    unit = lambda v: v if np.linalg.norm(v) <= 1e-12 else v / np.float32(np.linalg.norm(v))
    out, centroids, counts = [], [], []
    for v in vectors:
        v = unit(np.asarray(v, np.float32))
        sims = sorted(((float(c @ v), -i) for i, c in enumerate(centroids)), reverse=True)
        top, second = (sims[0][0] if sims else 0.0), (sims[1][0] if len(sims) > 1 else 0.0)
        close = bool(sims) and top >= least
        unclear = close and top - second <= margin
        if close and not unclear:
            i = -sims[0][1]
            centroids[i] = unit((centroids[i] * counts[i] + v) / (counts[i] + 1))
            counts[i] += 1
            out.append((i, top, False))
        else:
            centroids.append(v), counts.append(1)
            out.append((len(centroids) - 1, 1.0, unclear))
    return out, list(zip(counts, centroids))


def test_noisy_identities_equal_plain_version(spark):
    """All faces of a table, with clusters that move, margins that decide and ambiguous faces."""
    m = Media(spark, "/root/testdata/sf0.01")
    assigned = identity.scene_identities(m.noisy_observations)
    scenes_of: dict = {}
    for r in m.noisy_observations.collect():
        scenes_of.setdefault((r.job_id, r.scene_id), []).append((r.frame_id, r.face_id, r.embedding))
    want, clusters = {}, {}
    for (job, scene), rows in scenes_of.items():
        rows.sort()
        found, centroids = plain_clusters([v for *_, v in rows], identity.SCENE_SIMILARITY, identity.SCENE_MARGIN)
        for (frame, face, _), (c, s, unclear) in zip(rows, found):
            want[job, scene, frame, face] = (f"scene_{scene}_person_{c + 1}", s, unclear)
        clusters.setdefault(job, []).extend((scene, f"scene_{scene}_person_{i + 1}", v) for i, (_, v) in enumerate(centroids))
    got = {(r.job_id, r.scene_id, r.frame_id, r.face_id): (r.scene_person_id, r.match_confidence, r.is_identity_ambiguous) for r in assigned.collect()}
    near = lambda a, b: a[0] == b[0] and abs(a[1] - b[1]) < 1e-5 and a[2] == b[2]
    assert got.keys() == want.keys() and all(near(got[k], want[k]) for k in want)
    assert sum(0 < x[1] < 0.99 for x in want.values()) > 50
    # Scenes have two or three faces, jobs many: most ambiguous ones turn up in stitching.
    unclear_faces = sum(x[2] for x in want.values())
    stitched = {(r.job_id, r.scene_id, r.scene_person_id): (r.video_person_id, r.video_confidence, r.is_video_ambiguous) for r in identity.video_identities(identity.scene_clusters(assigned)).collect()}
    for job, rows in clusters.items():
        rows.sort(key=lambda r: r[:2])
        found, _ = plain_clusters([v for *_, v in rows], identity.VIDEO_SIMILARITY, identity.VIDEO_MARGIN)
        for (scene, name, _), (c, s, unclear) in zip(rows, found):
            assert near(stitched[job, scene, name], (f"video_person_{c + 1}", s, unclear))
            unclear_faces += unclear
    assert unclear_faces >= 5


def plain_tracks(rows: list[tuple], least: float, gap: int) -> list[int]:
    """Track numbers of (frame, label, box) rows in order."""
    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
        return w * h / (area(a) + area(b) - w * h) if w > 0 and h > 0 else 0.0

    tracks, out, used, frame = {}, [], set(), None
    for f, label, box in rows:
        used, frame = (used, frame) if f == frame else (set(), f)
        found = [(iou(box, b), -n) for n, (lab, b, at) in tracks.items() if lab == label and f - at <= gap and n not in used and iou(box, b) > 0]
        best = max(found, default=(0.0, 0))
        n = -best[1] if found and best[0] >= least else len(tracks) + 1
        tracks[n] = (label, box, f)
        used.add(n)
        out.append(n)
    return out


def test_tracks_of_a_table_equal_plain_version(spark):
    m = Media(spark, "/root/testdata/sf0.01")
    for rows, index, label, least, found in ((m.detections, "det_index", "label", tracking.OBJECT_IOU, tracking.object_tracks), (m.faces, "face_id", None, tracking.FACE_IOU, tracking.face_tracks)):
        jobs: dict = {}
        for r in rows.collect():
            jobs.setdefault(r.job_id, []).append((r.frame_id, r[index], r[label] if label else "", (r.x1, r.y1, r.x2, r.y2)))
        want = {}
        for job, boxes in jobs.items():
            boxes.sort()
            for (frame, i, *_), n in zip(boxes, plain_tracks([(f, x, b) for f, _, x, b in boxes], least, tracking.MAX_GAP)):
                want[job, frame, i] = n
        assert {(r.job_id, r.frame_id, r[index]): r.track_num for r in found(rows).collect()} == want
        assert len(set(want.values())) > 10


def test_writing_one_job_keeps_the_others(spark, tmp_path):
    for job in ("a", "b", "a"):
        path = sinks.write_json(spark.createDataFrame([(job, 1)], "job_id string, n int"), str(tmp_path), "packet")
    assert {(r.job_id, r.n) for r in spark.read.json(path).collect()} == {("a", 1), ("b", 1)}


def test_streaming_task_states_equal_batch_states(spark, tmp_path):
    from framelake.streaming import tasks

    ops = ["enqueue", "claim", "retry", "claim", "success", "enqueue", "claim"]
    log = spark.createDataFrame([(f"t{k}", i + 1, op, None) for k in range(3) for i, op in enumerate(ops[: 3 + k * 2])], "task_id string, seq long, op string, owner string")
    for k in (1, 2):
        log.where(f"seq % 2 = {k % 2} or seq < 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    whole = log.coalesce(1)
    whole.write.parquet(str(tmp_path / "all"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "all"))
    q = tasks.task_states(stream).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    shown = lambda t: sorted((x.task_id, x.status, x.attempts) for x in t.collect())
    assert shown(spark.table("states")) == shown(tasklog.latest_state(log))


def test_task_log_folds_like_single_steps(spark):
    """Random histories with repeated appends, owners and unknown operations against one step at a time."""
    r = random.Random(4)
    ops = [*tasklog.OPS, "claim", "none"]
    rows = [(f"t{k}", i + 1, r.choice(ops), r.choice([None, "a", "b"])) for k in range(80) for i in range(r.randrange(1, 25))]
    log = spark.createDataFrame(rows + rows[::7], "task_id string, seq long, op string, owner string").repartition(5)
    want = {}
    for t in {x[0] for x in rows}:
        own = pd.DataFrame([x for x in rows if x[0] == t], columns=["task_id", "seq", "op", "owner"])
        state = tasklog.fold(own, 2)
        if state[0] is not None:
            want[t] = (*state, int(own["seq"].max()))
    got = {x.task_id: (x.status, x.attempts, x.lease_owner, x.last_seq) for x in tasklog.latest_state(log, 2).collect()}
    assert got == want and len({x[0] for x in want.values()}) >= 4


def test_rows_meet_their_scenes_across_time_buckets(spark):
    r = random.Random(5)
    times = [0.0, 59.999, 60.0, 120.0, 3600.0] + [round(r.uniform(0, 4000), 1) for _ in range(200)]
    rows = [(j, i, t) for j in ("a", "b") for i, t in enumerate(times)] + [("a", 900, None), (None, 901, 5.0)]
    bounds = [("a", 0, 0.0, 60.0), ("a", 1, 60.0, 120.0), ("a", 2, 100.0, 3600.0), ("b", 0, 59.999, 59.999), ("b", 1, 70.0, 65.0), ("c", 0, 0.0, 9.0)]
    got = scenes.in_scenes(spark.createDataFrame(rows, "job_id string, frame_id long, ts_sec double"), spark.createDataFrame(bounds, "job_id string, scene_id long, start_sec double, end_sec double"))
    want = sorted((j, s, i) for j, i, t in rows for k, s, a, z in bounds if j == k and t is not None and a <= t <= z)
    assert sorted((x.job_id, x.scene_id, x.frame_id) for x in got.collect()) == want
    assert got.columns == ["job_id", "frame_id", "ts_sec", "scene_id", "start_sec", "end_sec"]


BOUNDS = "job_id string, scene_id long, start_sec double, end_sec double"


def test_sweep_pairs_rows_with_all_their_scenes(spark):
    r = random.Random(8)
    times = [0.0, 60.0, 60.0, 120.0] + [round(r.uniform(0, 400), 1) for _ in range(300)]
    rows = [(j, i, t, f"{j}{i}", 9) for j in ("a", "b", "d") for i, t in enumerate(times)] + [("a", 900, None, "x", 9), (None, 901, 5.0, "y", 9), ("a", 902, math.nan, "z", 9)]
    bounds = [(j, k, a, a + r.choice([0.0, 5.0, 90.0, 400.0])) for j in ("a", "b", "c") for k, a in enumerate(round(r.uniform(-20, 400), 1) for _ in range(40))]
    bounds += [("a", 90, 0.0, 60.0), ("a", 90, 0.0, 60.0), ("a", 91, 60.0, 60.0), ("b", 92, 70.0, 65.0), ("b", 93, None, 5.0), (None, 94, 0.0, 9.0)]
    frames = spark.createDataFrame(rows, "job_id string, frame_id long, ts_sec double, name string, scene_id int")
    want = sorted((j, s, i, n) for j, i, t, n, _ in rows for k, s, a, z in bounds if j == k and None not in (j, t, a) and a <= t <= z)
    for parts, pairs in ((7, 1 << 16), (1, 10)):
        got = intervals.in_intervals(frames, spark.createDataFrame(bounds, BOUNDS), parts, pairs)
        assert sorted((x.job_id, x.scene_id, x.frame_id, x.name) for x in got.collect()) == want
    assert got.columns == ["job_id", "frame_id", "ts_sec", "name", "scene_id", "start_sec", "end_sec"]
    assert intervals.in_intervals(frames.limit(0), spark.createDataFrame(bounds, BOUNDS)).count() == 0
    assert intervals.in_intervals(frames, spark.createDataFrame([], BOUNDS)).count() == 0


def test_sweep_of_a_million_frames_and_a_scene_of_three_hours(spark):
    n, hours = 1_000_000, 3 * 3600.0
    frames = spark.range(n).select(F.lit("j").alias("job_id"), F.col("id").alias("frame_id"), (F.col("id") * hours / n).alias("ts_sec"))
    bounds = [("j", 0, 0.0, hours)] + [("j", k, 5.0 * k, 5.0 * k + 7) for k in range(1, 2000)]
    scenes_ = spark.createDataFrame(bounds, BOUNDS)
    got = {x.scene_id: (x.n, x.s) for x in intervals.in_intervals(frames, scenes_, 16).groupBy("scene_id").agg(F.count("*").alias("n"), F.sum("frame_id").alias("s")).collect()}
    at = np.arange(n) * hours / n
    runs = {k: (int(np.searchsorted(at, a)), int(np.searchsorted(at, z, side="right"))) for _, k, a, z in bounds}
    assert got == {k: (b - a, (a + b - 1) * (b - a) // 2) for k, (a, b) in runs.items()}
    met = intervals.crossing(sequences.in_ranges(frames, ["job_id"], ["ts_sec"], 16), scenes_)
    per = {x.scene_id: x["count"] for x in met.groupBy("scene.scene_id").count().collect()}
    assert per[0] <= 16 and sum(per.values()) <= len(bounds) + 3 * 16


def test_first_rows_of_groups(spark):
    from framelake.operators.firsts import first_k

    r = random.Random(6)
    rows = [(r.choice("aab"), r.randrange(50), r.randrange(3)) for _ in range(400)] + [("c", 1, 1)]
    order = F.struct("n", "v")
    df = spark.createDataFrame(rows, "k string, n int, v int").repartition(6)
    cut = first_k(df, ["k"], order, order, 5, "l")
    got = {x.k: [(y.n, y.v) for y in x.l] for x in cut.collect()}
    assert got == {k: sorted((n, v) for x, n, v in rows if x == k)[:5] for k in "abc"}
    assert "WindowGroupLimit" in cut._jdf.queryExecution().executedPlan().toString()
    assert first_k(df.limit(0), ["k"], order, order, 5, "l").count() == 0


def test_poller_waits_for_a_retry_that_is_due_later(spark, tmp_path):
    import time

    from framelake.streaming import tasks

    begun = time.time()
    due, done = {1: begun - 60, 2: begun + 6, 3: begun + 9000}, {}
    when = F.timestamp_seconds

    def table():
        rows = [(i, "retry", t) for i, t in due.items() if i not in done]
        df = spark.createDataFrame(rows, "id long, status string, at double")
        return df.select("id", "status", when("at").alias("next_attempt_at"), F.lit(None).cast("timestamp").alias("lease_expires_at"))

    def execute(rows):
        done.update({x.id: time.time() for x in rows.collect()})

    q = tasks.poller(spark, table, execute, str(tmp_path / "cp"), poll_seconds=1.0)
    try:
        while len(done) < 2 and time.time() < begun + 60 and q.isActive:
            time.sleep(0.5)
    finally:
        q.stop()
    assert set(done) == {1, 2} and done[2] >= begun + 6


def test_task_transitions():
    state, seen = (None, 0, None), []
    for op in ("enqueue", "claim", "retry", "claim", "retry"):
        state = tasklog.step(state, op, None, 2)
        seen.append(state[0])
    assert seen == ["queued", "processing", "retry", "processing", "dead_letter"]
    assert tasklog.step(("succeeded", 1, None), "success", None, 2) == ("succeeded", 1, None)
    assert tasklog.step(("processing", 1, "me"), "success", "you", 2)[0] == "processing"
    assert tasklog.step(("dead_letter", 2, None), "fail", None, 2)[0] == "dead_letter"


def test_enqueue_is_idempotent_and_payloads_decode(spark):
    tasks = spark.createDataFrame([("a", "processing"), ("b", "succeeded")], "idempotency_key string, status string")
    new = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4)], "idempotency_key string, seq long")
    assert sorted(r.seq for r in tasklog.enqueue(new, tasks).collect()) == [2, 4]
    raw = '{"job_id": "j", "source_key": "jobs/j/input/source.mp4", "scenes": [[0, 1.5], [3], null, [2, 4]], "frame_results": [{"frame_id": "1"}, null]}'
    got = tasklog.decoded_payload(spark.createDataFrame([(raw,), ("junk",)], "payload string")).collect()
    assert got[0].scenes == [[0.0, 1.5], [2.0, 4.0]] and len(got[0].frames) == 1 and got[1].scenes == []


def test_job_states(spark):
    log = [("a", 1, "create", "cv", None), ("a", 2, "stage", "corpus", None), ("a", 3, "fail", None, "x"), ("a", 4, "stage", "late", None), ("b", 1, "create", "cv", None), ("b", 2, "complete", None, None), ("c", 1, "create", "cv", None)]
    got = {r.job_id: r for r in tasklog.job_state(spark.createDataFrame(log, "job_id string, seq long, op string, stage string, error string")).collect()}
    assert (got["a"].status, got["a"].stage, got["a"].error) == ("failed", "corpus", "x")
    assert (got["b"].status, got["c"].status) == ("completed", "processing")


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_geometry_and_timecodes(spark):
    box = lambda *b: geometry.Box(*map(F.lit, b))
    coords = [one(spark, geometry.round_coord(F.lit(x)))[0] for x in (10.6, 10.4, -0.4, -1.6, 5.0, 2.5)]
    assert coords == [11, 10, 0, -2, 5, 2]
    assert one(spark, geometry.iou(box(0, 0, 10, 10), box(20, 20, 30, 30)))[0] == 0
    assert one(spark, geometry.affinity(box(0, 0, 0, 10), box(0, 0, 9, 9)))[0] == 0
    arrays = [F.array(*map(F.lit, b)) for b in ((0.0, 0.0, 2.5, 3.0), (0.0, 0.0, 0.0, 3.0), (1.0, 2.0))]
    assert list(one(spark, *(geometry.coerced_box(a) for a in arrays))) == [[0, 0, 2, 3], None, None]
    assert one(spark, timecode.format_timecode(F.lit(3723.5)))[0] == "01:02:03.500"
    assert one(spark, timecode.format_timecode(F.lit(59.9996)))[0] == "00:00:60.000"
    texts = ("00:01:02.500", "junk", "a:b:c", "-1:00:00", None)
    assert [one(spark, timecode.parse_timecode(F.lit(t).cast("string")))[0] for t in texts] == [62.5, 0.0, 0.0, 0.0, 0.0]


def test_ids_and_keys(spark):
    import hashlib

    want = "chunk_" + hashlib.sha1(b"j::3::None").hexdigest()[:16]
    assert one(spark, ids.deterministic_id("chunk", F.lit("j"), F.lit(3), F.lit(None).cast("string")))[0] == want
    number = int(hashlib.sha1(b"j:1:car:0").hexdigest()[:8], 16)
    assert one(spark, ids.fallback_track_number(F.lit("j"), F.lit(1), F.lit("car"), F.lit(0)))[0] == number
    names = {"Clip.MOV": "mov", "clip": "mp4", "a.b.t-g": "tg", None: "mp4"}
    for name, extension in names.items():
        assert one(spark, ids.source_extension(F.lit(name).cast("string")))[0] == extension
    job, n = F.lit("j"), F.lit(4)
    keys = one(spark, ids.frame_key(job, "segmentation", n), ids.scene_key(job, "packet", n), ids.corpus_key(job, "retrieval", F.lit("a/b.json")), ids.source_key(job, F.lit(".MP4")))
    assert list(keys) == ["jobs/j/frames/seg/frame_4.jpg", "jobs/j/scene/packets/scene_4.json", "jobs/j/corpus/rag/a_b.json", "jobs/j/input/source.mp4"]


def test_track_number_order(spark):
    rows = spark.createDataFrame([(7.0, 3, True), (None, 3, True), (float("nan"), 3, True), (None, 3, False), (None, None, False)], "own double, tracked long, has_ids boolean")
    got = rows.select(tracking.track_number(F.col("own"), F.col("tracked"), F.lit(0), F.lit("j"), F.lit(1), F.lit("car"), F.col("has_ids")).alias("n")).collect()
    assert [r.n for r in got[:4]] == [7, 1, 1, 3] and got[4].n > 100


def test_samples(spark):
    s = spark.createDataFrame([("j", 0, 0.0, 1.0), ("j", 1, 2.0, 3.0), ("j", 2, 5.0, 4.0)], "job_id string, scene_id long, start_sec double, end_sec double")
    got = scenes.tracking_samples(s, fps=10, sample_fps=2, most=3).orderBy("frame_id").collect()
    assert [r.frame_id for r in got] == [0, 1, 2, 1_000_000, 1_000_001, 1_000_002]
    assert [r.ts_sec for r in got[:4]] == [0.0, 0.5, 1.0, 2.0] and [r.source_index for r in got[:4]] == [0, 5, 10, 20]
    four = scenes.tracking_samples(s.limit(1).withColumn("end_sec", F.lit(10.0)), fps=10, sample_fps=5, most=4)
    assert [r.sample_index for r in four.orderBy("sample_index").collect()] == [0, 1, 2, 3]


CHUNKS = "job_id string, scene_id long, start_sec double, end_sec double, narrative string, chunks array<struct<chunk_id:string,text:string,artifact_keys:array<string>,source_entity_ids:array<string>>>"


def test_chunks(spark):
    rows = [("a", 0, 0.0, 1.0, "told", [("", " text ", ["k"], ["e"]), ("x", " ", [], [])]), ("b", 0, 0.0, 1.0, "told", [("x", " \n", [], [])]), ("c", 0, 0.0, 1.0, " told ", []), ("d", 0, 0.0, 1.0, None, None)]
    got = {r.job_id: r for r in corpus.chunk_records(spark.createDataFrame(rows, CHUNKS)).collect()}
    assert set(got) == {"a", "c"}
    assert got["a"].text == "text" and got["a"].source_entity_ids == ["e"] and got["c"].text == "told" and got["c"].source_entity_ids is None
    frames = spark.createDataFrame([("e", 11, 3.5)], "job_id string, frame_id long, ts_sec double")
    d = spark.createDataFrame([("e", 11, 3.5, i, x, None, 0.5, 0, 0, 1, 1) for i, x in enumerate(("car", "person"))], DETECTION)
    a = spark.createDataFrame([("e", 11, 3.5, 1, "face_1", None, 0.5, 0, 0, 1, 1)], FACE)
    (chunk,) = corpus.frame_chunks(frames, d, a).collect()
    assert chunk.text == "Frame 11 at 00:00:03.500 includes objects [car, person] and faces [face_1]."


def test_synopsis_orders_by_time_and_clients_retry(spark):
    rows = spark.createDataFrame([("j", 0, 10.0, 12.0, "later"), ("j", 1, 0.0, 2.0, "first")], "job_id string, scene_id long, start_sec double, end_sec double, narrative string")
    want = "[0.00-2.00s] first [10.00-12.00s] later"
    assert narrative.synopsis(rows).first().synopsis == want
    said = narrative.synopsis_by(rows, lambda text, r: f"{text} [{r['start_sec']:.2f}-{r['end_sec']:.2f}s] {r['narrative']}")
    assert said.first().synopsis == want
    packets = spark.createDataFrame([("j", 0, "{}", ["car"], [])], "job_id string, scene_id long, packet string, allowed_entities array<string>, allowed_events array<string>")

    def client(packet, tries=[]):
        tries.append(1)
        return {"narrative_paragraph": "text", "key_moments": ["m"], "mentioned_entities": ["dog" if len(tries) == 1 else "car"], "mentioned_events": []}

    assert narrative.narratives_by(packets, client, 1).first().narrative == "text"
    assert "dog" in narrative.narratives_by(packets, lambda p: {"narrative_paragraph": "t", "key_moments": ["m"], "mentioned_entities": ["dog"]}, 1).first().error


def test_model_output(spark):
    faces = spark.createDataFrame([("j", 0, [0.95, 0.5, 0.9], [[1.0, 2.0, 3.4, 4.6], [0.0] * 4, [5.0, 6.0, 7.0, 8.0]])], "job_id string, frame_id long, probs array<double>, boxes array<array<double>>")
    got = normalize.kept_faces(faces).orderBy("face_id").collect()
    assert [(r.face_id, r.coordinates) for r in got] == [(1, [1, 2, 3, 5]), (2, [5, 6, 7, 8])]
    raw = spark.createDataFrame([("j", 0, [[[0.4, 1.6]], [[2.0, 2.0]]], [1], {1: "dog"})], "job_id string, frame_id long, polygons array<array<array<double>>>, class_ids array<int>, names map<int,string>")
    (s,) = normalize.segmentations(raw).collect()
    assert (s.object_id, s.class_name, s.mask_polygon) == (1, "dog", [[0, 2]])
    boxes = spark.createDataFrame([("j", 0, [[0.0, 0.0, 2.0, 2.0]], [7], [0.5], None, {1: "dog"})], "job_id string, frame_id long, boxes array<array<double>>, class_ids array<int>, confs array<double>, box_ids array<double>, names map<int,string>")
    (d,) = normalize.detections(boxes).collect()
    assert (d.label, d.box, d.box_id) == ("7", [0, 0, 2, 2], None)
    assert normalize.model_provenance(faces, {"detection": ("m", ""), "face": ("f", "2")}).count() == 2


def test_urls_and_retention(spark):
    files = F.create_map(F.lit("a"), F.lit("jobs/j/x"), F.lit("b"), F.lit(""), F.lit("c"), F.lit("http://x"))
    assert one(spark, results.to_urls(files))[0] == {"a": "https://objects.example/jobs/j/x?exp=3600", "c": "http://x"}
    assert one(spark, results.to_urls(F.lit(None).cast("map<string,string>")))[0] == {}
    with pytest.raises(ValueError):
        results.signed(F.lit("x"), ttl=0)
    table = [one(spark, retention.source_action(F.lit(c), F.lit(v)))[0] for c, v in ((True, True), (False, True), (True, False))]
    assert table == ["delete", "retain", "preserve"]


def test_documents_round_trip(spark, tmp_path):
    from framelake.sources import ingest, sinks
    from framelake.sources.media import Media

    m = Media(spark, "/root/testdata/sf0.001")
    docs = results.frame_documents(m.frames, m.detections, m.faces, m.segments)
    path = sinks.write_json(docs, str(tmp_path), "frame")
    back = ingest.frame_documents(spark, path)
    assert ingest.detections(back).count() == 801 and ingest.faces(back).count() == 199 and ingest.segments(back).count() == 408
    first = {(r.job_id, r.frame_id, r.det_index): (r.label, r.x1) for r in m.detections.collect()}
    assert {(r.job_id, r.frame_id, r.det_index): (r.label, r.x1) for r in ingest.detections(back).collect()} == first
    images = spark.createDataFrame([("jobs/j/frames/original/frame_0.jpg", b"abc")], "key string, content binary")
    assert sinks.write_images(images, f"file://{tmp_path}/store").count() == 1
    assert ingest.uploads(spark, str(tmp_path / "store"), 10).count() >= 0
    with pytest.raises(ValueError):
        sinks.write_checked(docs, docs.select("job_id"), str(tmp_path), "packet")


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# c\nFRAMELAKE_MAX_EVENTS='3'\nFRAMELAKE_EMBEDDING_DIM=4\nFRAMELAKE_SAMPLE_FPS=x\n")
    s = Settings.load({"FRAMELAKE_MAX_EVENTS": "5", "FRAMELAKE_FAILURE_POLICY": "odd"}, str(tmp_path / ".env"))
    assert (s.max_events, s.embedding_dim, s.sample_fps, s.failure_policy) == (5, 16, 4.0, "fail_job")
    assert model_id(" Default ") == "fallback"
    with pytest.raises(ValueError):
        model_id("odd")


def test_similarity(spark):
    a = F.array(*map(F.lit, (0.6, 0.8)))
    assert abs(one(spark, identity.similarity(a, a))[0] - 1) < 1e-9
    assert np.isclose(identity.unit(np.zeros(3)).sum(), 0)
