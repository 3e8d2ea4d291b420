"""BPE, and counts that follow edits, against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from framelake.llm import bpe, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = ["a", "b", " ", "  ", "\n", "\t", "'s", "'re", "é", "1", "22", "!", "<|endoftext|>", "<|endoftext", "|>", "漢", "😀", "\x00", "\x1c", "\r\n", "The", " the", "　", "\x85"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as f:
        return bpe.ByteBPE(f.read())


def ids(library, text: str) -> bytes:
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def texts(n: int, seed: int = 1) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_encode_and_decode(library, own):
    for text in [*texts(3000), "", "a" * 5000, "ab" * 3000, "!" * 5000]:
        packed = ids(library, text)
        assert own.encode(text) == packed, repr(text)
        assert own.decode(packed) == library.decode(np.frombuffer(packed, "<u4").tolist(), skip_special_tokens=False)


def test_every_character(library, own):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][::7]
    for i in range(0, len(points), 20):
        text = "".join(f"a{chr(c)}b 1{chr(c)}2 {chr(c)} x" for c in points[i : i + 20])
        assert own.encode(text) == ids(library, text)


def test_edits_keep_counts_exact(library, own):
    r = random.Random(3)
    count = lambda part: len(own.encode(part)) // 4
    for text in texts(300, 5):
        text *= r.randint(1, 8)
        tree = token_counts.build(text, count)
        for _ in range(6):
            a = r.randint(0, len(text))
            b, new = min(len(text), a + r.randint(0, 12)), "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 4)))
            want = text[:a] + new + text[b:]
            text, _ = token_counts.edit(text, tree, a, b, new, count)
            assert text == want
            assert tree.total.tolist() == [len(text), len(ids(library, text)) // 4], (text, a, b, new)
        again = token_counts.Tree.unpack(tree.pack(), tree.levels[0].shape[1])
        assert all((x == y).all() for x, y in zip(tree.levels, again.levels))


def apply(own, library, text: str, edits: list[tuple]) -> int:
    """Edits a text, holding its counts against the library; the most characters that one edit encoded."""
    counts = token_counts._Counts(own)
    tree, most = token_counts.build(text, counts.__getitem__, own), 0
    assert tree.total.tolist() == [len(text), len(ids(library, text)) // 4]
    for start, end, insert in edits:
        want = text[:start] + insert + text[end:]
        text, encoded = token_counts.edit(text, tree, start, end, insert, counts.__getitem__, own)
        assert text == want
        assert tree.total.tolist() == [len(text), len(ids(library, text)) // 4], (start, end, insert)
        most = max(most, encoded)
    again = token_counts.Tree.unpack(tree.pack(), tree.levels[0].shape[1])
    assert all((x == y).all() for x, y in zip(tree.levels, again.levels)) and (tree.goes_on == again.goes_on).all()
    return most


def test_edits_inside_earlier_insertions_encode_little(library, own):
    r = random.Random(4)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(20_000)]
    bulk, counts = " ".join(words), token_counts._Counts(own)
    tree = token_counts.build("start  end", counts.__getitem__, own)
    text, _ = token_counts.edit("start  end", tree, 6, 6, bulk, counts.__getitem__, own)
    assert tree.levels[0].shape[1] > 19_000
    for at in (7, 50_000, len(text) - 8):
        text, encoded = token_counts.edit(text, tree, at, at + 1, "x", counts.__getitem__, own)
        assert encoded < 40 and tree.total.tolist() == [len(text), len(ids(library, text)) // 4]
    typed = [(3 + k, 3 + k, c) for k, c in enumerate("word by word, it's typed here " * 20)]
    assert apply(own, library, "abc def ghi", typed) < 40


def test_edits_of_texts_without_blanks_encode_little(library, own):
    r = random.Random(6)
    cjk = "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(20_000))
    for text in (cjk, "ab" * 10_000, "a1" * 10_000, "".join(r.choice("abcdefgh'!=-019é") for _ in range(20_000)), "=" * 5000 + "'s" * 20 + "s" * 5000):
        edits = [(p := r.randrange(len(text)), p + r.randint(0, 3), r.choice(["", "x", "'s", "b'", " ", "字", "<|endoftext|>", "1!"])) for _ in range(12)]
        # Tokens of a run of one character all shift with its first one.
        assert apply(own, library, text, edits) < (60_000 if text[0] == "=" else 1000), text[:20]


def test_random_edits_near_cuts(library, own):
    r = random.Random(9)
    alphabet = ["a", "b", "the", "ing", "'", "'s", "'re", "!", "=", "1", "22", "é", "字", " ", "<|endoftext|>", "\x1c", "\n"]
    for k in range(25):
        text = "".join(r.choice(alphabet[: r.randint(2, len(alphabet))]) for _ in range(r.randint(200, 1200)))
        n = len(text)
        edits = [(p := r.randint(0, n // 2), p + r.randint(0, 40), "".join(r.choice(alphabet) for _ in range(r.randint(0, 6)))) for _ in range(10)]
        apply(own, library, text, [e for e in edits if e[1] < n // 3])


ROWS = [(1, "Hello, world! <|endoftext|> it's", 3), (2, None, 3), (3, "", 3), (4, "ü" * 9000, 3), (4, "ü" * 9000, 3), (None, "x  y\n\n z ", 3)]


def test_queries(spark, library):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, n_tokens int")
    want = []
    for key, text, _ in ROWS:
        packed = ids(library, text or "")
        want.append((key, len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = bpe.digest(bpe.encode(docs, PATH))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert bpe.digest(bpe.encode(docs.limit(0), PATH)).count() == 0
    counted = token_counts.count(docs, PATH)
    assert sorted(map(repr, ((r.doc_id, r.n_tokens) for r in counted.collect()))) == sorted(repr(w[:2]) for w in want)
    edits = spark.createDataFrame([(1, 2, 0, 5, "Bye"), (1, 1, None, None, "!"), (4, 1, 100, 200, None), (9, 1, 0, 0, "x"), (2, 1, 5, 3, "new")], "doc_id long, seq int, start int, end int, insert string")
    after = {}
    for r in token_counts.apply_edits(counted, edits, PATH).collect():
        after[r.doc_id] = r
        assert r.n_tokens == len(ids(library, r.text)) // 4
    assert after[1].text == "Bye, world! <|endoftext|> it's!" and after[2].text == "new" and len(after[4].text) == 8900
    assert after[3].encoded_chars == 0 and after[4].encoded_chars > 0


def test_count_query_on_a_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    by = {r.doc_id: r for r in token_counts.digest(docs, PATH).collect()}
    for r in docs.collect():
        text, n = r.text or "", len(r.text or "")
        assert by[r.doc_id].n_tokens == len(ids(library, text)) // 4
        for a, b, new in ((n // 2, n // 2, " inserted words,"), (n // 4, n // 4 + 7, ""), (3 * n // 4, 3 * n // 4 + 5, "X")):
            text = text[:a] + new + text[max(a, b) :]
        assert by[r.doc_id].n_tokens_after == len(ids(library, text)) // 4
        assert by[r.doc_id].text_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert by[r.doc_id].encoded_chars < 400 or n < 2000
