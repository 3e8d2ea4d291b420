"""Every query with SQL against DuckDB at the smallest size, and the shapes of plans."""

from __future__ import annotations

import pytest

from framelake.operators import fusion, jobs, scenes
from framelake.plans.queries import ORACLE_SQL, QUERIES, _tables
from framelake.sources.media import Media
from tests.oracle import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    assert compare(spark, SF, QUERIES[name], ORACLE_SQL[name]) == ""


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_shapes(spark):
    m = Media(spark, SF)
    best = plan(fusion.best_person(m.faces, fusion.persons(m.detections)))
    assert "CartesianProduct" not in best and "BroadcastNestedLoopJoin" not in best
    inside = plan(scenes.in_scenes(m.frames, m.scenes))
    assert "BroadcastNestedLoopJoin" not in inside
    assert "WindowGroupLimit" in plan(QUERIES["scene_entity_topk"](spark, SF))
    read = plan(m.detections.select("job_id", "frame_id"))
    assert "props" not in read and "value" not in read


def test_references_are_checked_in_small_parts(spark):
    """Joins and counts of references are dealt over at least 256 parts, so a task's sorts are small."""
    joined = plan(QUERIES["evidence_violations"](spark, SF))
    assert joined.count("256), REPARTITION_BY_NUM") >= 5


def test_entities_are_counted_once(spark):
    """What is made of a packet's entities reads them, and doesn't count them again."""
    p = jobs.scene_packets(_tables(Media(spark, SF)))
    assert "Window" not in plan(p.totals) and plan(p.events).count("Union") == 1


def test_corpus_stages_are_written_once(spark):
    """Relations, events and chunks read what the stage before them wrote, not the tables."""
    t = _tables(Media(spark, SF))
    c = jobs.corpus_of(t)
    for rows in (c.entities, c.events, c.relations, c.scene_chunks):
        assert not [f for f in rows.inputFiles() if "events.parquet" in f]


def test_view_sizes(spark):
    m = Media(spark, SF)
    assert [getattr(m, t).count() for t in ("base", "scenes", "detections", "faces", "segments")] == [1000, 90, 801, 199, 408]


IDENTIFIED = ["faces_identified", "scene_identities_exact", "scene_identity_summary", "video_identities_exact", "video_identity_summary", "whole_job"]


@pytest.fixture(scope="module")
def copied_vectors(spark, tmp_path_factory):
    """The smallest tables with embeddings that are copies of one another, null, not finite, zero or absent."""
    folder = tmp_path_factory.mktemp("copied")
    for t in TABLES:
        if t != "embeddings":
            (folder / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    odd = {0: None, 1: [float("nan")] * 64, 2: [float("inf")] * 64, 3: [0.0] * 64}
    rows = [(i, odd.get(i % 29, [1.0, float(i % 2)] * 32), 0) for i in range(500) if i % 31]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", IDENTIFIED)
def test_people_stay_apart_when_vectors_are_copies(spark, copied_vectors, name):
    assert compare(spark, copied_vectors, QUERIES[name], ORACLE_SQL[name]) == ""
