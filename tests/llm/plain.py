"""Plain versions of operators, for small tables."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str | None) -> set:
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def near(docs: list[tuple]) -> dict:
    """doc_id -> (n_shingles, component_id) of (doc_id, text) rows."""
    sets = {i: shingles(t) for i, t in docs}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, n in collections.Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def cut(docs: list[tuple]) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256) of (doc_id, text) rows."""
    first: dict = {}
    for i, t in docs:
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            if i is not None:
                g = tuple(w[k : k + 50])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in docs:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = " ".join(x for x, y in zip(w, gone) if not y)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def exact(docs: list[tuple]) -> list[tuple]:
    groups = collections.defaultdict(list)
    for i, t in docs:
        groups[t or ""].append(i)
    out = []
    for i, t in docs:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return out


def mixed(docs: list[tuple], seed: str = "mix-1") -> list[tuple]:
    """(doc_id, source, size, source_size, target, taken) of (doc_id, text, source) rows, by clamping in rounds."""
    rows = [(i, s, len(WORD.findall(t or ""))) for i, t, s in docs]
    names = sorted({s for _, s, _ in rows if s is not None}) + [None] * any(s is None for _, s, _ in rows)
    size = {s: sum(n for _, x, n in rows if x == s) for s in names}
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(size.values()), set()
    while True:
        left = total - sum(3 * size[s] for s in capped)
        level = left / sum(weight[s] for s in names if s not in capped) if len(capped) < len(names) else 0
        over = {s for s in names if s not in capped and level * weight[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    target = {s: 3.0 * size[s] if s in capped else level * weight[s] for s in names}
    out = []
    for s in names:
        mine = sorted(((hashlib.md5(f"{seed}:{'null' if i is None else i}".encode()).hexdigest(), -1 if i is None else i, n) for i, x, n in rows if x == s))
        whole, rest = divmod(int(target[s]), size[s]) if size[s] else (0, 0)
        for _, i, n in mine:
            part = min(n, rest)
            rest -= part
            out.append((None if i == -1 else i, s, n, size[s], target[s], whole * n + part))
    return out
