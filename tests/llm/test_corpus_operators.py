"""Deduplication, mixing, quality and the pipeline against plain versions, and their edge cases."""

from __future__ import annotations

import math
import random
import uuid
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framelake.llm import bpe, common, exact_dedup, fixed_blocks, hyperminhash, mixing, nbsvm
from framelake.llm.graph import components
from framelake.llm.queries import tokenizer_path
from tests.llm import plain

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, kept string, digest string, taken int, size int"


def sentence(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n)]


def texts() -> list[tuple]:
    """(doc_id, text, source): near and exact copies, shared passages, short, empty, null and long texts."""
    r = random.Random(7)
    base, passage, out = sentence(r, 160), sentence(r, 70), []
    for i in range(40):
        w = list(base)
        for _ in range(i % 9):
            k = r.randrange(len(w))
            w[k : k + r.randint(0, 1)] = sentence(r, 1) if i % 2 else []
        out.append((100 + i, " ".join(w), "near"))
    for i in range(10):
        a = sentence(r, 30 + i * 7)
        out.append((200 + i, " ".join(a[:20] + passage[i % 3 : 49 + i] + a[20:]), "passage"))
    out += [(300 + i, t, None) for i, t in enumerate(["", None, " \t\n", "one", "One", "a b c d", "A  b\tc d", "a b c d e", "a b c d e f", "é ü ç"])]
    out += [(400 + i, " ".join(base), "copy") for i in range(5)]
    out += [(500, "x" * 30_000, "long"), (501, "w " * 20_000, "long"), (502, " ".join(passage * 4), "long")]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "clash", "clash", 2, 3) for i, t, s in rows], SCHEMA)


def same(df, want) -> None:
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_near_dedup(spark):
    rows = texts()
    want = plain.near([(i, t) for i, t, _ in rows])
    got = hyperminhash.near_dedup(frame(spark, [*rows, rows[3], (None, "a b c d e", "x")])).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    assert hyperminhash.near_dedup(frame(spark, rows).limit(0)).count() == 0


def test_near_dedup_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain.near([(r.doc_id, r.text) for r in docs.collect()])
    same(hyperminhash.near_dedup(docs).select("doc_id", "n_shingles", "component_id", "kept"), [(i, n, c, i == c) for i, (n, c) in want.items()])


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (95, 90), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketch_estimates():
    import numpy as np

    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64) << np.uint64(1))
    b = np.unique(np.concatenate([a[:800], rng.integers(0, 1 << 63, 100, dtype=np.uint64) << np.uint64(1)]))
    x, y = hyperminhash.registers([a, b])
    used, equal = (x > 0) | (y > 0), (x == y) & (x > 0)
    assert abs(equal.sum() / used.sum() - 800 / 1000) < 0.1
    assert (hyperminhash.band_keys(np.stack([x, x]))[0] == hyperminhash.band_keys(np.stack([x, x]))[1]).all()
    one = hyperminhash.registers([a[:1], a[:0]])
    assert (one[1] == 0).all() and (one[0] > 0).sum() == 1


def near_group(r: random.Random, first_id: int, n: int) -> list[tuple]:
    """Texts that grew from one by edits of two words each: some near to many others, some to none."""
    out = [sentence(r, 120)]
    while len(out) < n:
        w = list(r.choice(out[-200:]))
        for _ in range(r.choice([1, 1, 2, 4])):
            w[r.randrange(len(w))] = sentence(r, 1)[0]
        out.append(w)
    return [(first_id + i, " ".join(w), "near") for i, w in enumerate(out)]


def test_near_dedup_of_a_doc_id_with_two_texts(spark):
    r = random.Random(8)
    a, b = sentence(r, 100), sentence(r, 100)
    docs = [(5, " ".join(a), "s"), (5, " ".join(b), "s"), (6, " ".join([*a[:99], "x"]), "s"), (7, " ".join([*b[:99], "y"]), "s"), (9, "alone", "s"), (5, " ".join(b), "s")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in hyperminhash.near_dedup(frame(spark, docs)).collect())
    assert got == [(5, 5, True)] * 3 + [(6, 5, False), (7, 5, False), (9, 9, True)]
    # The text that document 5 shares with 2 goes, its other one stays.
    kept = hyperminhash.keep_one(frame(spark, [*docs[:4], (2, " ".join(a), "s")])).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(2, docs[0][1]), (5, docs[1][1])]


def test_near_dedup_misses_no_link(spark):
    """Recall against all pairs: many pairs at and above the threshold, and a large group around one text."""
    r = random.Random(12)
    rows = [row for share in (0.855, 0.87, 0.9, 0.95) for row in overlapping(r, int(share * 1000) * 1000, 150, share)]
    rows += [*near_group(random.Random(5), 10_000, 1500), *texts()]
    want = plain.near([(i, t) for i, t, _ in rows])
    same(hyperminhash.near_dedup(frame(spark, rows)).select("doc_id", "n_shingles", "component_id"), [(i, *w) for i, w in want.items()])
    assert 50 < len({c for i, (_, c) in want.items() if 10_000 <= i < 11_500}) < 1400
    assert sum(i != c for i, (_, c) in want.items() if i > 100_000) >= 550


def overlapping(r: random.Random, first_id: int, pairs: int, share: float) -> list[tuple]:
    """Pairs of texts of 200 words, the second with the end replaced so that about this share of shingles is common."""
    out = []
    for i in range(pairs):
        a = sentence(r, 200)
        common = -int(-196 * 2 * share // (1 + share))
        out += [(first_id + 2 * i, " ".join(a), "s"), (first_id + 2 * i + 1, " ".join(a[: common + 4] + sentence(r, 196 - common)), "s")]
    return out


def test_bands_follow_the_threshold(spark):
    assert hyperminhash.banding(85) == (4, 4, 16)
    for percent in range(5, 101):
        merge, band, bands = hyperminhash.banding(percent)
        assert band * bands * merge <= hyperminhash.BUCKETS and (1 - (percent / 100) ** band) ** bands <= 1e-5
    for percent in (0, 1, 4, 101):
        with pytest.raises(ValueError):
            hyperminhash.near_dedup(frame(spark, []), percent)
    got = hyperminhash.near_dedup(frame(spark, overlapping(random.Random(11), 0, 60, 0.52)), 50)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: i // 2 * 2 for i in range(120)}


def test_substring_dedup(spark):
    rows = texts()
    docs = [(i, t) for i, t, _ in rows] + [(None, rows[45][1]), (rows[45][0], rows[45][1])]
    same(fixed_blocks.digest(frame(spark, [(i, t, "s") for i, t in docs])), plain.cut(docs))
    versions = [(i, t) for i, t, _ in rows[:20]] + [(rows[5][0], "other"), (rows[6][0], None)]
    assert fixed_blocks.digest(frame(spark, [(i, t, "s") for i, t in versions])).count() == 22
    assert fixed_blocks.digest(frame(spark, rows).limit(0)).count() == 0


def test_substring_dedup_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    same(fixed_blocks.digest(docs), plain.cut([(r.doc_id, r.text) for r in docs.collect()]))


def test_substring_dedup_of_a_passage_in_every_document(spark):
    """More copies in one batch than are settled there, at any offset, with some documents whole copies."""
    r = random.Random(17)
    passage = sentence(r, 90)
    docs = [(i, " ".join(sentence(r, i % 40) + passage + sentence(r, i % 7))) for i in range(300)] + [(300 + i, " ".join(passage[i % 30 :])) for i in range(60)]
    for parts in (1, 7):
        same(fixed_blocks.digest(frame(spark, [(i, t, "s") for i, t in docs]).repartition(parts)), plain.cut(docs))


def test_repeats_are_maximal_runs(spark):
    r = random.Random(18)
    a, b, own = sentence(r, 60), sentence(r, 70), sentence(r, 100)
    docs = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(own[:10] + a + own[10:30] + b + own[30:]))]
    got = {x.doc_id: [(s.first, s.last) for s in x.repeats] for x in fixed_blocks.cut_repeats(frame(spark, [(i, t, "s") for i, t in docs])).collect()}
    assert got == {1: [], 2: [], 3: [(10, 69), (90, 159)]}


def test_packing_keeps_positions_of_repeated_rows():
    import numpy as np

    doc, position = np.array([5, 5, 5, 5, 5, 5, 9]), np.array([100, 300, 100, 300, 0, 70_000, 1])
    hashes = np.arange(7, dtype=np.uint64)
    rows = list(fixed_blocks._pack(doc, position, hashes, 1, 8))
    got = fixed_blocks._unpack(pa.table([pa.array(c, k) for c, k in zip(zip(*rows), fixed_blocks._PACKED_KINDS)], fixed_blocks._PACKED_NAMES), 8)
    assert [x.tolist() for x in got] == [doc.tolist(), position.tolist(), hashes.tolist()]


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_substring_dedup_of_repeated_rows(spark, parts):
    r = random.Random(3)
    shared, own = sentence(r, 400), sentence(r, 1500)
    long = " ".join(own[:300] + shared + own[300:])
    docs = [(1, " ".join(shared)), (2, long), (2, long), (2, long), (2, " ".join(own[:700])), (3, long)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        same(fixed_blocks.digest(frame(spark, [(i, t, "s") for i, t in docs[:4]]).coalesce(1)), plain.cut(docs[:4]))
        whole = [(i, n, gone) for i, n, gone, _ in plain.cut(docs[:4] + docs[5:])]
        same(fixed_blocks.digest(frame(spark, [(i, t, "s") for i, t in docs[:4] + docs[5:]]).coalesce(1)).drop("kept_sha256"), whole)
        assert fixed_blocks.digest(frame(spark, [(i, t, "s") for i, t in docs]).coalesce(1)).count() == len(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_exact_dedup(spark):
    rows = texts()
    docs = [(i, t) for i, t, _ in rows] + [(rows[3][0], rows[3][1]), (None, rows[3][1]), (None, "only here")]
    same(exact_dedup.exact_dedup(frame(spark, [(i, t, "s") for i, t in docs])), plain.exact(docs))
    assert exact_dedup.exact_dedup(frame(spark, rows).limit(0)).count() == 0


def test_rows_without_doc_id_stay_apart(spark):
    docs = frame(spark, [(None, "a b", "s"), (None, "c d", "s"), (None, "a b", "s"), (1, "c d", "s"), (2, "e", "s"), (2, "e", "s")])
    kept = exact_dedup.keep_distinct(docs)
    assert sorted(repr((r.doc_id, r.text)) for r in kept.collect()) == sorted(map(repr, [(None, "a b"), (1, "c d"), (2, "e")]))
    assert sorted(r.text for r in mixing.sample(docs.where("doc_id is null").distinct()).collect()) == ["a b", "c d"]


def test_digest_index_is_persistent(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = frame(spark, [(1, "a", "s"), (2, "b", "s"), (3, "a", "s")])
    assert {r.doc_id: r.kept for r in index.ingest(first).collect()} == {1: False, 2: True, 3: True}
    again = exact_dedup.DigestIndex(spark, index.name)
    got = {r.doc_id: (r.kept, r.keep_id) for r in again.ingest(frame(spark, [(9, "a", "s"), (10, "c", "s"), (11, "c", "s")])).collect()}
    assert got == {9: (False, 3), 10: (False, 11), 11: (True, 11)}
    assert again.read().count() == 3
    place = spark.sql(f"describe extended {index.name}").where("col_name = 'Location'").first()["data_type"]
    moved = exact_dedup.DigestIndex.attach(spark, index.name + "_moved", place, 4)
    assert [r.kept for r in moved.ingest(frame(spark, [(20, "b", "s")])).collect()] == [False]
    plan = again.read().select("digest").hint("merge").join(again.read().select("digest").withColumnRenamed("digest", "d"), F.col("digest") == F.col("d"), "left_anti")
    assert "Exchange hashpartitioning" not in plan._jdf.queryExecution().executedPlan().toString()


def test_a_batch_may_come_again(spark):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    index.ingest(frame(spark, [(1, "a", "s")]), batch="first")
    second = frame(spark, [(2, "a", "s"), (3, "b", "s"), (4, "b", "s"), (None, "c", "s")])
    verdicts = lambda df: sorted(repr((r.doc_id, r.keep_id, r.group_size, r.kept)) for r in df.collect())
    once = verdicts(index.ingest(second, batch="second"))
    assert once == sorted(map(repr, [(2, 1, 1, False), (3, 4, 2, False), (4, 4, 2, True), (None, None, 1, True)]))
    assert verdicts(index.ingest(second, batch="second")) == once
    assert index.read().count() == 3
    # A batch of which only a part had been appended is completed.
    index.ingest(second.where("doc_id = 3"), batch="third")
    third = frame(spark, [(8, "d", "s"), (9, "e", "s")])
    index.add(exact_dedup.digests(third.where("doc_id = 8")), "fourth")
    assert verdicts(index.ingest(third, batch="fourth")) == sorted(map(repr, [(8, 8, 1, True), (9, 9, 1, True)]))


def test_the_query_probes_an_index_that_is_not_shuffled(spark, monkeypatch):
    plans, unseen = [], exact_dedup.DigestIndex.unseen
    monkeypatch.setattr(exact_dedup.DigestIndex, "unseen", lambda self, g: plans.append(self.read().count()) or plans.append(unseen(self, g)._jdf.queryExecution().executedPlan().toString()) or unseen(self, g))
    tables = len(spark.catalog.listTables())
    docs = frame(spark, [(i, f"t{i % 30}", "s") for i in range(100)])
    assert exact_dedup.exact_dedup(docs).where("kept").count() == 30
    assert plans[0] == 0 and plans[2] > 0
    for plan in plans[1::2]:
        assert "SortMergeJoin" in plan and "LeftAnti" in plan and plan.count("Exchange hashpartitioning") == 1
    assert len(spark.catalog.listTables()) == tables


def test_digest_index_broadcasts_little_of_a_large_index(spark, monkeypatch):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = index.ingest(frame(spark, [(i, f"t{i}", "s") for i in range(3000)]))
    assert first.where("kept").count() == 3000
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df) or broadcast(df))
    small = frame(spark, [(5000, "t7", "s"), (5001, "new", "s"), (5002, "new", "s")])
    got = {r.doc_id: (r.keep_id, r.kept) for r in index.ingest(small).collect()}
    assert got == {5000: (7, False), 5001: (5002, False), 5002: (5002, True)}
    assert index.ingest(small.limit(0)).count() == 0
    many = [(6000 + i, f"t{i % 7 if i < 40 else i}", "s") for i in range(2000)]
    got = index.ingest(frame(spark, many)).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in got) == [(i, int(t[1:]), False) for i, t, _ in many]
    assert sent and max(df.count() for df in sent) <= 7


def test_mixing(spark):
    rows = texts()
    got = mixing.mix(frame(spark, rows))
    want = plain.mixed(rows)
    key = lambda r: (r[0], r[1], r[2], r[3], round(r[4], 6), r[5])
    assert sorted(map(repr, (key(tuple(r)) for r in got.collect()))) == sorted(map(repr, map(key, want)))
    assert mixing.mix(frame(spark, rows).limit(0)).count() == 0
    assert mixing.mix(frame(spark, [(1, None, None), (None, "a b", "s"), (None, "a b", "s")])).count() == 3
    sampled = mixing.sample(frame(spark, rows)).select("text").collect()
    assert sum(len(plain.WORD.findall(r.text)) for r in sampled) == sum(r[5] for r in want)


@pytest.mark.parametrize("sizes", [[5], [1, 100], [0, 0], [10, 10, 10, 10], [1, 1, 1, 1000]])
def test_water_filling_keeps_the_budget(spark, sizes):
    rows = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = mixing.water_fill(rows).collect()
    assert abs(sum(r.target for r in got) - sum(sizes)) < 1e-6
    assert all(r.target <= 3 * r.source_size + 1e-9 for r in got)


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = nbsvm.classify(docs, labels)
    held = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("share"), F.count("*").alias("n")).first()
    assert held.n > 50 and held.share >= 0.97
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in nbsvm.classify(docs.repartition(5), labels.repartition(3)).collect()}


def test_quality_edge_cases(spark):
    rows = texts()
    docs = frame(spark, [*rows, (None, "x y", "s")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in nbsvm.classify(docs, none).collect()} == {0.5}
    labels = spark.createDataFrame([(r[0], r[0] % 2) for r in rows] + [(None, 1), (7777, 0), (101, None), (102, 5)], "doc_id long, quality int")
    got = nbsvm.classify(docs, labels).collect()
    assert len(got) == len(rows) + 1 and all(0 <= r.score <= 1 for r in got)
    assert nbsvm.classify(docs.limit(0), labels).count() == 0


def plain_nbsvm(rows: list[set], y: list[int], weight: dict) -> tuple[dict, list[float]]:
    """Log-count ratios by counting, and margins of the hinge-loss optimum by projected gradient steps on the whole dual."""
    import numpy as np

    counts = {s: {f: nbsvm.SMOOTHING for f in range(nbsvm.SIZE)} for s in (1, -1)}
    for found, s in zip(rows, y):
        for f in found:
            counts[s][f] += 1
    total = {s: sum(c.values()) for s, c in counts.items()}
    ratio = {f: math.log(counts[1][f] / total[1]) - math.log(counts[-1][f] / total[-1]) for found in rows for f in found}
    norm = [math.sqrt(sum(ratio[f] ** 2 for f in found)) for found in rows]
    gram = np.array([[1 + sum(ratio[f] ** 2 for f in a & b) / (na * nb) for b, nb in zip(rows, norm)] for a, na in zip(rows, norm)])
    q = gram * np.outer(y, y)
    cost, alpha, step = np.array([weight[s] for s in y]), np.zeros(len(y)), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(60_000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, cost)
    return ratio, list(gram @ (alpha * y))


def test_quality_model_equals_plain_solution(monkeypatch):
    import numpy as np

    monkeypatch.setattr(nbsvm, "EPOCHS", 5000)
    monkeypatch.setattr(nbsvm, "CLOSE", 1e-10)
    r = random.Random(1)
    words = sentence(r, 60)
    docs = [" ".join(r.choice(words[:40] if k % 3 else words[20:]) for _ in range(12)) for k in range(24)]
    y = np.array([1 if k % 3 else -1 for k in range(24)])
    y[[4, 9]] *= -1
    rows = list(nbsvm.features(pa.array(docs)))
    ratio = nbsvm._ratios(rows, y)
    n = {s: int((y == s).sum()) for s in (1, -1)}
    want, margins = plain_nbsvm([set(x.tolist()) for x in rows], y.tolist(), {s: nbsvm.COST * 24 / (2 * n[s]) for s in n})
    assert all(abs(ratio[f] - v) < 1e-12 for f, v in want.items())
    w, bias = nbsvm._descend(rows, y, ratio, 1)
    model = nbsvm.Model(w * ratio, ratio**2, bias, 1.3, -0.2)
    assert max(abs(model.margin(x) - m) for x, m in zip(rows, margins)) < 1e-6
    assert max(abs(model.score(x) - 1 / (1 + math.exp(-1.3 * m + 0.2))) for x, m in zip(rows, margins)) < 1e-6


def test_quality_sample_stays_bounded(spark, monkeypatch):
    sizes, fit = [], nbsvm.fit
    monkeypatch.setattr(nbsvm, "fit", lambda rows, label: sizes.append(len(rows)) or fit(rows, label))
    docs = spark.range(3000).select((F.col("id") % 3 + 1).alias("doc_id"), F.concat(F.lit("some text "), "id").alias("text"))
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, quality int")
    nbsvm.train(docs, labels, sample_rows=50)
    assert sizes and max(sizes) <= 50


def test_stages_keep_columns_with_names_of_their_own(spark):
    names = ["__text", "__digest", "__keep_id", "__id", "__hash", "__size", "__taken", "__copy", "__text_hash", "__own", "__copies"]
    docs = frame(spark, [*texts()[:12], (None, "x", None)]).withColumns({n: F.lit(n) for n in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        assert all(r[n] == n for r in got.collect() for n in names)


def test_pipeline_equals_plain_version(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = nbsvm.train(docs, labels)
    scored = {r.doc_id: r.score for r in nbsvm.score(docs, model).collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if scored[r.doc_id] >= nbsvm.THRESHOLD]
    keep = {i for i, _, _, kept, _ in plain.exact([(i, t) for i, t, _ in rows]) if kept}
    rows = [r for r in rows if r[0] in keep]
    groups = plain.near([(i, t) for i, t, _ in rows])
    rows = [r for r in rows if groups[r[0]][1] == r[0]]
    copies = []
    text = {i: t for i, t, _ in rows}
    for i, _, size, _, _, taken in plain.mixed(rows):
        while taken > 0:
            part = text[i] if taken >= size else " ".join(plain.WORD.findall(text[i])[:taken])
            copies.append((i, part))
            taken -= size
    want = bpe.digest(bpe.encode(spark.createDataFrame(copies, "doc_id long, text string"), tokenizer_path()))
    same(corpus_pipeline.run(spark, SF), map(tuple, want.collect()))


def test_pipeline_stages_keep_columns(spark):
    docs = frame(spark, [*texts(), (None, "x", None)])
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_intermediate_tables_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark, purpose: f"file://{tmp_path}/{purpose}-{uuid.uuid4().hex}")
    left = lambda: sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir())
    text = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "other words")], "doc_id long, text string")
    out = hyperminhash.near_dedup(docs)
    assert left() == ["near-named", "near-sketches"]
    assert sorted((r.doc_id, r.component_id) for r in out.collect()) == [(1, 1), (2, 1), (3, 3)]
    with pytest.raises(ZeroDivisionError), common.scratch(spark):
        common.written(docs, "failed")
        raise ZeroDivisionError
    with common.scratch(spark):
        hyperminhash.keep_one(docs).count()
        with common.scratch(spark):
            rows = common.written(fixed_blocks.cut_repeats(docs), "outer", kept=True)
        assert rows.count() == 3 and "outer" in left() and "repeats" not in left()
    assert left() == ["near-named", "near-sketches"]


def test_a_local_session_gets_a_folder_of_its_own():
    local, remote = (SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=m)) for m in ("local[2]", "spark://host:7077"))
    assert common.shared_dir(local, "a").startswith("file:///tmp/spark-framelake-")
    with pytest.raises(ValueError):
        common.shared_dir(remote, "a")


def boilerplate(n: int) -> list[tuple]:
    """One text of 170 words and two paragraphs of 20 in each document, either shared with one neighbour: much is common to all, nothing links."""
    r = random.Random(31)
    shared, parts = " ".join(sentence(r, 170)), [" ".join(sentence(r, 20)) for _ in range(n + 1)]
    return [(i, f"{shared} {parts[i]} {parts[i + 1]}", "s") for i in range(n)]


def test_comparisons_of_a_hot_key_grow_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(hyperminhash, "PLACE", 64)
    counted = {}
    for n in (500, 1000, 2000):
        docs = frame(spark, boilerplate(n))
        classes = hyperminhash.written(hyperminhash._classes(hyperminhash.sketches(docs)), "test-classes")
        sets = hyperminhash.written(hyperminhash._sets(docs, classes.select("id", "doc_id", "f1", "f2")), "test-sets")
        split = hyperminhash._prefixes(classes.select("id", F.col("id").alias("label")), sets, 85)
        counted[n] = split.groupBy("key").count().agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0]
    assert 0 < counted[500] and counted[2000] < 4.4 * counted[500] and counted[2000] < 100 * 2000
    same(hyperminhash.near_dedup(docs).select("doc_id", "component_id"), [(i, i) for i in range(2000)])


@pytest.mark.parametrize("place", [64, 2048])
def test_near_dedup_of_texts_made_of_common_paragraphs(spark, monkeypatch, place):
    """Documents of paragraphs that hundreds share, so that rare shingles don't split them all; links against all pairs."""
    monkeypatch.setattr(hyperminhash, "PLACE", place)
    r = random.Random(17)
    pool = [" ".join(sentence(r, 12)) for _ in range(24)]
    rows = [(i, " ".join(pool[j] for j in sorted(r.sample(range(24), 16))), "s") for i in range(900)]
    want = plain.near([(i, t) for i, t, _ in rows])
    same(hyperminhash.near_dedup(frame(spark, rows)).select("doc_id", "n_shingles", "component_id"), [(i, *w) for i, w in want.items()])
