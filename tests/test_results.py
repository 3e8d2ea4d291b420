"""Contracts of answers, canonical JSON, checked writes and pages against plain versions."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from framelake.functions.canonical import canonical_json
from framelake.operators import contracts, jobs, results
from framelake.sources import checked, objects
from framelake.sources.media import Media

SF = "/root/testdata/sf0.001"


def test_contract_problems_equal_those_of_parsed_answers(spark):
    r = random.Random(3)
    values = ["text", "", "é ", 7, 1.5, True, None, [], ["a"], ["a", "b", ""], ["a", 1, None, {"x": []}], [["a"]], {"a": "b"}, {}]
    fields = [*contracts.NARRATIVE, "other"]
    answers = [{f: r.choice(values) for f in r.sample(fields, r.randrange(len(fields) + 1))} for _ in range(400)]
    good = {"narrative_paragraph": "p", "key_moments": ["m"], "more": 1}
    rows = [(i, json.dumps(a), a) for i, a in enumerate([*answers, good, [], [good], "text", 3, None, True])]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "i long, t string")
    got = {x.i: [tuple(p) for p in x.p] for x in df.select("i", contracts.problems(F.col("t"), contracts.NARRATIVE).alias("p")).collect()}
    assert got == {i: contracts.found(a, contracts.NARRATIVE) for i, _, a in rows}
    assert got[400] == [] and sum(not p for p in got.values()) < 100


def test_contract_of_texts_that_are_no_json(spark):
    rows = [(None,), ("",), ("{",), ('{"a": 1} x',), ('{"a": 1}, "end": ""} x',), ('{"narrative_paragraph": "p", "narrative_paragraph": "q", "key_moments": ["m"]}',)]
    found = spark.createDataFrame(rows, "t string").select(contracts.told(contracts.problems(F.col("t"), contracts.NARRATIVE)).alias("p")).collect()
    assert [x.p for x in found] == ["$: not JSON"] * 6
    assert spark.createDataFrame(rows, "t string").where("false").select(contracts.problems(F.col("t"), contracts.NARRATIVE)).count() == 0


def test_canonical_json_equals_dumps(spark):
    r = random.Random(5)

    def value(depth: int):
        kind = r.randrange(9 if depth else 6)
        if kind < 6:
            return [None, True, r.randrange(-(10**18), 10**18), r.choice([0.1, 1e10, 1e22, 5e-324, -0.0, 1 / 3, 123456.789]), "".join(chr(r.choice([9, 34, 92, 233, 0x2028, 0x1F600, 65])) for _ in range(5)), ""][kind]
        return [value(depth - 1) for _ in range(r.randrange(4))] if kind < 8 else {f"k{r.randrange(9)}é": value(depth - 1) for _ in range(4)}

    found = [value(4) for _ in range(300)]
    rows = [(i, json.dumps(v, ensure_ascii=i % 2 == 0, indent=i % 3 or None)) for i, v in enumerate(found)] + [(300, None), (301, "{"), (302, "")]
    got = {x.i: x.c for x in spark.createDataFrame(rows, "i long, t string").select("i", canonical_json(F.col("t")).alias("c")).collect()}
    assert got == {i: json.dumps(v, sort_keys=True, separators=(",", ":")) for i, v in enumerate(found)} | {300: None, 301: None, 302: None}


def rules() -> dict:
    return {"odd": F.col("n") % 2 == 1, "large": F.col("n") > 95}


def test_checked_writes_set_bad_rows_aside(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = spark.range(100).select(F.format_string("jobs/j/%d.json", "id").alias("key"), F.format_string('{"n": %d}', "id").alias("content"), F.nullif(F.col("id"), F.lit(1)).alias("n"))
    # Row 1 has no number, and a rule that is null holds: 49 odd rows and two large even ones are bad.
    assert checked.write_checked_objects(rows, rules(), root, "one") == (49, 51, {"odd": 49, "large": 4})
    assert json.loads((tmp_path / "jobs/j/2.json").read_text()) == {"n": 2} and not (tmp_path / "jobs/j/3.json").exists()
    aside = json.loads((tmp_path / "quarantine/jobs/j/97.json").read_text())
    assert aside == {"key": "jobs/j/97.json", "broken": ["odd", "large"], "content": '{"n": 97}'}
    assert checked.write_checked_objects(rows, rules(), root, "one") == (49, 51, {})
    assert checked.write_checked_objects(rows.limit(0), rules(), root, "none")[:2] == (0, 0)
    with pytest.raises(Exception, match="no content"):
        checked.write_checked_objects(rows.withColumn("content", F.when(F.col("n") < 50, F.col("content"))), rules(), root, "broken")
    assert objects.committed(spark, root, "broken") is None


def test_checked_writes_read_their_rows_once(spark):
    m = Media(spark, SF)
    documents = results.frame_documents(m.frames, m.detections, m.faces, m.segments)
    keyed = documents.select("*", F.lit("k").alias("key"), F.lit("c").alias("content"))
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan")
    assert scans(checked.sorted_out(keyed, results.document_rules())) == scans(keyed)
    assert checked.sorted_out(keyed, results.document_rules()).where(F.size("broken") > 0).count() == 0


def test_pages_hold_everything_within_their_bound(spark):
    r = random.Random(6)
    items = [(j, k, i, "é" * r.randrange(0, 25)) for j, n in (("a", 900), ("b", 3), ("c", 40)) for k in ("x", "y") for i in range(n)]
    df = spark.createDataFrame(items, "job_id string, kind string, pos long, body string").repartition(7)
    paged = results.pages(df, 100).cache()
    assert paged.where("bytes > 100").isEmpty()
    found = {(x.job_id, x.page): x for x in paged.collect()}
    read = []
    for job in ("a", "b", "c"):
        token = None
        while True:
            (p,) = results.page(paged, job, token).collect() if token is None or token % 40 == 0 else [found[job, token]]
            assert p.n_items == len(p["items"]) and p.bytes == sum(len(x.body.encode()) for x in p["items"])
            read += [(job, x.kind, x.pos, x.body) for x in p["items"]]
            token = p.next_page
            if token is None:
                break
    assert read == sorted(items)
    assert {x.job_id: (x.n_items, x.kinds) for x in results.page_summary(paged).collect()} == {j: (2 * n, {"x": n, "y": n}) for j, n in (("a", 900), ("b", 3), ("c", 40))}
    assert results.pages(df.limit(0)).count() == 0
    (long,) = results.pages(spark.createDataFrame([("a", "x", 0, "z" * 500)], df.schema), 100).collect()
    assert (long.page, long.next_page, long.bytes) == (0, None, 500)


def test_pages_of_whole_jobs_equal_the_flat_items(spark):
    m = Media(spark, SF)
    with jobs.whole(jobs.Tables(m.scenes, m.frames, m.detections, m.segments, m.faces), m.observations) as w:
        items = jobs.result_items(w).cache()
        paged = results.pages(items, 20_000)
        again = paged.select("job_id", F.explode("items").alias("i")).select("job_id", "i.kind", "i.pos", "i.body")
        assert again.exceptAll(items).isEmpty() and items.exceptAll(again).isEmpty()
        kinds = {x.kind: x.n for x in items.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert kinds["frame"] == m.frames.count() and kinds["packet"] == kinds["narrative"] == m.scenes.count() and len(kinds) == 11
        assert items.groupBy("job_id", "kind", "pos").count().where("count > 1").isEmpty()
