"""URL filters, importance resampling and hard negatives: SQL, plain versions and defined cases."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest

from framelake.llm import hard_negatives, resampling, url_filters
from framelake.llm.common import written
from framelake.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_url_filters", "op12_resampling", "op13_hard_negatives"])
def test_equals_sql(spark, name):
    assert compare(spark, SF, QUERIES[name], ORACLE_SQL[name]) == ""


# --- 11 -------------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, HOST string")


def test_urls_and_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/a?b", "http://x.example.com/en/1", "http://x.example.com/english", "https://com/", "http://x.com?q=/en/",
            "http://a.net/es/", "http://a.net/es", "http://anet/es/", "http://é.org/ß#x", "x://y.net/fr/://z.com/", "http://www.example.com/fr/"]
    got = {r.page_id: r for r in url_filters.judged(pages(spark, [(i, u, None, "x") for i, u in enumerate(urls)])).collect()}
    assert len(got) == len(urls)
    of = lambda i: (got[i].host, got[i].path, got[i].rule, got[i].verdict)
    assert [of(i) for i in range(4)] == [("", "", None, "allow")] * 4
    assert of(4) == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert of(5) == ("x.example.com", "/en/1", "example.com/en/", "block")
    assert of(6) == ("x.example.com", "/english", "com/", "allow")
    assert of(7) == ("com", "/", "com/", "allow")
    assert of(8)[:3] == ("x.com", "", None)
    assert of(9) == ("a.net", "/es/", "net/es/", "block")
    assert of(10)[2] is None and of(11)[:3] == ("anet", "/es/", None)
    assert of(12)[:3] == ("é.org", "/ß", None)
    assert of(13) == ("y.net", "/fr/://z.com/", "net/fr/", "block")
    assert of(14) == ("www.example.com", "/fr/", "com/", "allow")
    assert url_filters.judged(pages(spark, [])).count() == 0
    assert {r.verdict for r in url_filters.judged(pages(spark, [(1, "http://a.b/", None, "")]), rules=()).collect()} == {"allow"}
    with pytest.raises(ValueError):
        url_filters.judged(pages(spark, []), rules=(("a", "/", "maybe"),))


def test_registered_domains(spark):
    names = {"a.b.example.com": "example.com", "example.com": "example.com", "com": "com", "x.foo.co.uk": "foo.co.uk", "foo.co.uk": "foo.co.uk", "co.uk": "co.uk", "a.b.foo.de": "foo.de", "10": "10"}
    df = spark.createDataFrame([(h,) for h in names], "host string")
    assert {r.host: r.d for r in df.select("host", url_filters.domain_of(df.host).alias("d")).collect()} == names


def test_links_carry_trust_and_distrust(spark):
    rows = [
        (1, "http://good.org/a", '<a href="http://friend.info/x">f</a> <A HREF = //Other.Info/y>', ""),
        (2, "http://friend.info/", "", ""), (3, "http://other.info/", "", ""),
        (4, "http://bad.org/x", '<a href="http://friend.info/">', ""),
        (5, "http://linker.info/", "<a href='https://bad.org/p'> <a href='/here'> <a href='http://bad.org'>", ""),
        (6, "http://alone.info/", "mailto:x@y <a href=relative//no.example>", ""),
    ]
    edges = {(r.src, r.dst) for r in url_filters.host_edges(pages(spark, rows)).collect()}
    assert edges == {("good.org", "friend.info"), ("good.org", "other.info"), ("bad.org", "friend.info"), ("linker.info", "bad.org")}
    rules = (("good.org", "/", "allow"), ("bad.org", "/", "block"))
    got = {r.page_id: r for r in url_filters.judged(pages(spark, rows), rules, threshold=20).collect()}
    assert got[2].trust > 0 and got[2].distrust == 0 and got[2].verdict == "allow"
    assert got[5].distrust > 0 and got[5].trust == 0 and got[5].verdict == "block" and got[5].rule is None
    assert got[6].trust == got[6].distrust == 0 and got[6].verdict == "allow"


def test_walk_equals_plain_version(spark):
    rng = random.Random(5)
    hosts = [f"h{i}" for i in range(40)]
    # One host has most of the edges on either side.
    edges = {("h0", h) for h in hosts[1:]} | {(h, "h1") for h in hosts if h != "h1"} | {tuple(rng.sample(hosts, 2)) for _ in range(60)}
    seeds = {(h, k): rng.randrange(10**9) for h in hosts for k in ("trust", "distrust", "neutral") if rng.random() < 0.5}
    table = written(spark.createDataFrame(sorted(edges), "src string, dst string"), "test-edges")
    found = url_filters.walked(spark.createDataFrame([(h, k, m) for (h, k), m in seeds.items()], "host string, kind string, mass long"), table, rounds=7)
    now = dict(seeds)
    for _ in range(7):
        new = Counter({x: m * 30 // 100 for x, m in seeds.items()})
        for kind in ("trust", "neutral", "distrust"):
            out = {}
            for a, b in edges:
                a, b = (b, a) if kind == "distrust" else (a, b)
                out.setdefault(a, []).append(b)
            for a, targets in out.items():
                for b in targets:
                    if (a, kind) in now:
                        new[(b, kind)] += now[(a, kind)] * 70 // (100 * len(targets))
        now = new
    assert {(r.host, r.kind): r.mass for r in found.collect() if r.mass} == {x: m for x, m in now.items() if m}


def test_url_filters_run_no_python(spark):
    plan = url_filters.judged(pages(spark, [(1, "http://a.b/", None, "")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# --- 12 -------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs_of(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain_resampling(docs, target):
    s, t = (Counter(b for text in texts for b in runs_of(text)[1]) for texts in ([d[1] for d in docs], target))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + 10_000) / ((s[b] + 1) * (sum(t.values()) + 10_000)))) for b in s}
    out = []
    for doc_id, text in docs:
        words, runs = runs_of(text)
        h = int(sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in runs)
        out.append([doc_id, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    drawn = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for i, x in enumerate(drawn[: 5 * len(drawn) // 100]):
        x[4] = i + 1
    return sorted((tuple(x[:5]) for x in out), key=repr)


def test_resampling_equals_plain_version(spark):
    rng = random.Random(3)
    vocabulary = ["Alpha", "beta", "gämma", "DELTA9", "7", "ε", "zeta-eta", "ÄÖ"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 2, 3, 19, 20, 50]))) for i in range(300)]
    docs += [(None, text(30)), (7, docs[7][1]), (7, text(25)), (301, None), (302, ""), (303, " .,;\n"), (304, text(60_000))]
    target = [text(40), None, "beta beta"]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, BUCKET string, row int")
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = sorted((tuple(r) for r in resampling.resample(df, aim).collect()), key=repr)
    assert got == plain_resampling(docs, target)
    assert resampling.resample(df.where("false"), aim).count() == 0
    assert sorted((tuple(r) for r in resampling.resample(df, aim.where("false")).collect()), key=repr) == plain_resampling(docs, [])


def test_ranks_over_many_ties(spark):
    # All scores but one are equal, so parts are cut by id and row.
    rows = spark.range(5000).selectExpr("id as row", "id % 100 as doc_id", "cast(if(id = 77, 9, 3) as long) as score")
    got = [r.row for r in resampling.ranked(rows, 1234).orderBy("rank").collect()]
    want = [r[0] for r in sorted(((i, i % 100, 9 if i == 77 else 3) for i in range(5000)), key=lambda x: (-x[2], x[1], x[0]))]
    assert got == want[:1234]
    assert resampling.ranked(rows, 0).count() == 0


# --- 13 -------------------------------------------------------------------------


def plain_negatives(rows):
    use = []
    for n, (i, v, label) in enumerate(rows):
        if v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((n, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    order = lambda s: (-s[0], s[2] is None, s[2] or 0, s[1])
    out = []
    for n, i, label, v in use:
        if i is None or i % 50:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), m, j, other) for m, j, other, w in use if m != n]
        for p in sorted((s for s in scored if s[3] == label), key=order)[:5]:
            good = sorted((s for s in scored if s[3] != label and 50 * p[0] <= 100 * s[0] <= 95 * p[0]), key=order)
            out += [(i, p[2], k, s[2], p[0], s[0]) for k, s in enumerate(good[:3], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("tile_bytes", [32 << 20, 4096])
def test_hard_negatives_equal_plain_version(spark, tile_bytes):
    rng = random.Random(9)
    vector = lambda n=8: [rng.choice([-0.5, 0.25, 0.1, 1.0, rng.gauss(0, 1)]) for _ in range(n)]
    common = vector()
    rows = [(i, common if rng.random() < 0.3 else vector(), rng.randrange(10)) for i in range(700)]
    rows += [(50, rows[50][1], rows[50][2]), (100, vector(), 3), (None, vector(), 1), (801, None, 2), (802, vector(), None), (803, [1.0, float("nan")], 1), (804, [float("inf")], 1), (805, [None, 1.0], 2), (850, [], 4), (900, vector(3), 5)]
    df = spark.createDataFrame([(i, v, c, 0) for i, v, c in rows], "vec_id long, embedding array<double>, label int, ROW int").coalesce(1)
    got = sorted((tuple(r) for r in hard_negatives.mined(df, tile_bytes=tile_bytes).collect()), key=repr)
    assert got == plain_negatives(rows)
    assert hard_negatives.mined(df.where("false")).count() == 0


def test_scores_stay_exact():
    import numpy as np

    rng = np.random.default_rng(1)
    for most in (1 << 10, 1 << 28, 1 << 40):
        a, b = rng.integers(-most, most, (5, 7)), rng.integers(-most, most, (6, 7))
        want = [[max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(p, q)))) for q in b] for p in a]
        assert hard_negatives.scores(a, b).tolist() == want
