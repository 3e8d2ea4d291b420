from __future__ import annotations

import random

from framelake.llm import licenses

ROWS = [
    (1, "Some text. Licensed under CC BY-NC 4.0. CC BY", "x"),
    (2, None, "x"),
    (3, "", "x"),
    (4, "word " * 40 + "Released under the\nMIT License. " + "word " * 90, "x"),
    (4, "word " * 40 + "Released under the\nMIT License. " + "word " * 90, "x"),
    (5, "this work is licensed under the GNU general public licence version 3", "x"),
    (6, "all rights. reserved, cc! by general public", "x"),
    (7, "all rights", "x"),
    (8, "reserved by the general; public license é all rights reserved", "x"),
    (None, "apache license, version 2.0 under the", "x"),
]


def brute(text: str | None) -> tuple:
    w = licenses.words(text or "")
    places = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    found, best = set(), 0.0
    for template, label in licenses.TEMPLATES:
        t, length = set(template.split()), max(licenses.BLOCK, 2 * len(template.split()))
        if len(t & set(w)) < licenses.THRESHOLD * len(t) - 1e-9:
            continue
        for start in range(max(len(w), 1)):
            share = len(t & set(w[start : start + length])) / len(t)
            if share >= licenses.THRESHOLD:
                found.add(label)
                best = max(best, share)
    starts = [i for i, _ in places]
    base = {label for _, label in places}
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if places else best)


def check(docs):
    got = licenses.digest(licenses.scan(docs)).collect()
    want = sorted(repr((r.doc_id, *brute(r.text))) for r in docs.collect())
    assert sorted(repr(tuple(r)) for r in got) == want


def test_edge_cases(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, labels string")
    check(docs)
    assert licenses.digest(licenses.scan(docs.limit(0))).count() == 0


def test_whole_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def brute_matches(text: str, templates, threshold: float) -> list[tuple]:
    """(label, start, end, containment) of the first best block of each run of starts, by trying every start."""
    w, out = licenses.words(text), []
    for template, label in templates:
        own = licenses.words(template)
        t, length = set(own), max(licenses.BLOCK, 2 * len(own))
        share = [len(t.intersection(w[s : s + length])) / len(t) for s in range(len(w))]
        s = 0
        while s < len(w):
            e = s
            while e < len(w) and share[e] >= threshold - 1e-9:
                e += 1
            if e > s:
                best = max(range(s, e), key=lambda i: (share[i], -i))
                out.append((label, best, min(best + length, len(w)), share[best]))
            s = max(e, s + 1)
    return sorted(out, key=repr)


def test_every_start_is_searched(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    short, wide, long = ([f"{p}{i}" for i in range(n)] for p, n in (("s", 6), ("w", 32), ("l", 90)))
    templates = [(" ".join(short), "short"), (" ".join(wide), "wide"), (" ".join(long), "long"), ("the end of the text", "common")]
    texts = [" ".join([word() for _ in range(k)] + t + [word() for _ in range(60)]) for t in (wide, long) for k in range(0, 20)]
    for k in range(20):
        spread = [x for s in short for x in (s, *(word() for _ in range(r.randint(2, 6))))]
        texts.append(" ".join([word() for _ in range(k)] + spread + [word() for _ in range(9)] + r.sample(short, 5)))
        vocabulary = [*short, *wide[:8], "the", "end", "of", "text"]
        texts.append(" ".join(r.choice(vocabulary) if r.random() < 0.5 else word() for _ in range(150)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {row.doc_id: sorted(map(tuple, row.matches), key=repr) for row in licenses.scan(docs, templates, (("no such phrase", "none"),)).collect()}
    assert got == {i: brute_matches(t, templates, licenses.THRESHOLD) for i, t in enumerate(texts)}
    assert all(any(m[0] == ("wide" if i < 20 else "long") and m[3] == 1.0 for m in got[i]) for i in range(40))
