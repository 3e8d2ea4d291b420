"""Token counts that follow edits.

Each document keeps a segment tree over its pre-tokens: every leaf has the
characters and tokens of a short run of pre-tokens, every node above the sums of
FANOUT below it. An edit replaces a range of characters. The tree is descended to
the leaves that hold the character before the range and the one after it; only
the text from the start of the one to the end of the other is split and encoded
anew. The new leaves, one for each run, take the place of the old ones, and the
sums above are updated.

Leaves end where no pre-token goes on, between a character other than white space
and white space. A run without white space of more than LONG characters has
several leaves: it is also cut between two of its tokens where what follows is
split the same with or without what is before. Tokens next to each other stay as
they are if each pair of neighbours does, so an edit near such a cut encodes the
next leaf too, as context; if the token at the cut comes out as it was, all
beyond it hold, else more leaves are taken in.

Defined cases: a null text counts as empty; edits of one document apply in the
order of ``seq``, each to the text its predecessors left; a range is cut to the
text (null bounds mean its end), a null insertion is empty; edits of documents
that aren't there are ignored; a document without edits keeps its counts;
repeated document rows each get all edits of their doc_id; null doc_ids get
none; a long text is held whole in a worker, with 8 bytes for each leaf; a run
of nothing but white space, or with an apostrophe in every three characters, is
one leaf, however long; an empty table gives no
rows. Other columns are not looked at.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.bpe import BITS, ByteBPE, _tokenizer

FANOUT = 16
#: Rows sent back to the JVM at once.
ROWS = 256
#: Longer runs without white space are cut, into leaves of at least LEAF characters.
LONG, LEAF = 256, 64
#: A piece is white space with the run of other characters after it; the vocabulary's pattern doesn't count the four separators as space.
_PIECES = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+").findall
_RUNS = re.compile(r"\s ").search
#: Words of more bytes are left to the vocabulary's own merging.
SHORT = 24
_NONE = 1 << 60


def pieces(text: str) -> list[str]:
    """The text in parts that pre-tokens never cross."""
    if text[:1] == " " or text[-1:] == " " or _RUNS(text):
        return _PIECES(text)
    first, *rest = text.split(" ")
    # White space inside a part is a boundary too, but a part may hold several pre-tokens.
    return [first, *map(" ".__add__, rest)] if first else [" " + r for r in rest]


def _kind(c: str) -> str:
    major = unicodedata.category(c)[0]
    return major if major in "LN" else "P"


def _may_cut(text: str, p: int) -> bool:
    """Whether the text from p is split the same with or without what is before it, and the other way round."""
    before, after = text[p - 1], text[p]
    if before.isspace() or after.isspace() or "'" in text[max(0, p - 3) : p]:
        return False
    return after != "'" or _kind(before) != "P"


def cut_piece(piece: str, bpe: ByteBPE) -> list[tuple[int, int, bool]]:
    """(characters, tokens, whether it goes on from the leaf before) of the leaves of a long piece."""
    ids = np.frombuffer(bpe.encode(piece), "<u4")
    raw = np.frombuffer(piece.encode(), np.uint8)
    whole = np.append((raw & 0xC0) != 0x80, True)
    chars = np.concatenate([[0], np.cumsum(whole[:-1])])
    ends = np.cumsum(bpe.lengths[ids])
    out, at, done = [], 0, 0
    for k, end in enumerate(ends[:-1].tolist()):
        p = int(chars[end])
        if whole[end] and p - at >= LEAF and len(piece) - p >= LEAF and _may_cut(piece, p):
            out.append((p - at, k + 1 - done, at > 0))
            at, done = p, k + 1
    return [*out, (len(piece) - at, len(ids) - done, at > 0)]


def _leaves(text: str, of_part, bpe: ByteBPE | None) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of the leaves of a text, and which of them go on from the one before."""
    parts = pieces(text) or [""]
    chars = np.fromiter(map(len, parts), np.int64, len(parts))
    if bpe is None or chars.max() <= LONG:
        return np.stack([chars, np.fromiter(map(of_part, parts), np.int64, len(parts))]), np.zeros(len(parts), bool)
    found = [leaf for part in parts for leaf in ([(len(part), of_part(part), False)] if len(part) <= LONG else cut_piece(part, bpe))]
    chars, tokens, goes_on = zip(*found)
    return np.array([chars, tokens], np.int64), np.array(goes_on)


class Tree:
    """Sums of characters and tokens; levels from the leaves up, each FANOUT times smaller."""

    def __init__(self, leaves: np.ndarray, goes_on: np.ndarray | None = None):
        self.levels = [leaves]
        self.goes_on = np.zeros(leaves.shape[1], bool) if goes_on is None else goes_on
        self._sum(0)

    def _sum(self, leaf: int) -> None:
        """Makes the sums above from the leaf on anew; leaves before it are as they were."""
        old, self.levels = self.levels, self.levels[:1]
        while self.levels[-1].shape[1] > FANOUT:
            below, leaf = self.levels[-1], leaf // FANOUT
            k = len(self.levels)
            kept = old[k][:, :leaf] if k < len(old) else below[:, :0]
            first = kept.shape[1] * FANOUT
            self.levels.append(np.concatenate([kept, np.add.reduceat(below[:, first:], np.arange(0, below.shape[1] - first, FANOUT), axis=1)], axis=1))

    @property
    def total(self) -> np.ndarray:
        return self.levels[-1].sum(axis=1)

    def find(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf starts."""
        node, start = 0, 0
        for k in range(len(self.levels) - 1, -1, -1):
            below = self.levels[k][0]
            first = node * FANOUT if k < len(self.levels) - 1 else 0
            sums = np.cumsum(below[first : first + FANOUT])
            i = int(np.searchsorted(sums, position - start, side="right"))
            i = min(i, len(sums) - 1)
            start += int(sums[i - 1]) if i else 0
            node = first + i
        return node, start

    def replace(self, first: int, last: int, leaves: np.ndarray, goes_on: np.ndarray) -> None:
        """Puts the leaves in the place of those from ``first`` to ``last``."""
        old = self.levels[0]
        if leaves.shape[1] == last + 1 - first:
            old[:, first : last + 1], self.goes_on[first : last + 1] = leaves, goes_on
            for k in range(1, len(self.levels)):
                first, last = first // FANOUT, last // FANOUT
                below = self.levels[k - 1][:, first * FANOUT : (last + 1) * FANOUT]
                self.levels[k][:, first : last + 1] = np.add.reduceat(below, np.arange(0, below.shape[1], FANOUT), axis=1)
            return
        self.levels[0] = np.concatenate([old[:, :first], leaves, old[:, last + 1 :]], axis=1)
        self.goes_on = np.concatenate([self.goes_on[:first], goes_on, self.goes_on[last + 1 :]])
        self._sum(first)

    def pack(self) -> bytes:
        return b"".join([self.levels[0].astype("<i4").tobytes(), np.packbits(self.goes_on).tobytes()])

    @classmethod
    def unpack(cls, packed: bytes, leaves: int) -> Tree:
        flat = np.frombuffer(packed, "<i4", 2 * leaves).astype(np.int64).reshape(2, leaves)
        return cls(flat, np.unpackbits(np.frombuffer(packed, np.uint8, offset=8 * leaves), count=leaves).astype(bool))


def build(text: str, of_part, bpe: ByteBPE | None = None) -> Tree:
    """The tree of a text; ``of_part`` counts the tokens of a part. Long runs are cut only with a vocabulary."""
    return Tree(*_leaves(text, of_part, bpe))


def edit(text: str, tree: Tree, start: int | None, end: int | None, insert: str | None, count, bpe: ByteBPE | None = None) -> tuple[str, int]:
    """The edited text and the characters encoded for it; updates the tree."""
    n = len(text)
    start = n if start is None else min(max(start, 0), n)
    end = n if end is None else min(max(end, start), n)
    insert = insert or ""
    first, begin = tree.find(max(start - 1, 0))
    last, at = tree.find(min(end, max(n - 1, 0)))
    sizes, goes_on = tree.levels[0][0], tree.goes_on
    stop = at + int(sizes[last])
    encoded, n_leaves = 0, len(goes_on)

    def wider(left: bool) -> None:
        nonlocal first, last, begin, stop
        if left:
            first -= 1
            begin -= int(sizes[first])
        else:
            last += 1
            stop += int(sizes[last])

    # At a cut inside a run the next leaf is context.
    if goes_on[first]:
        wider(True)
    if last + 1 < n_leaves and goes_on[last + 1]:
        wider(False)
    step = 1
    while True:
        region = text[begin:start] + insert + text[end:stop]
        encoded += len(region)
        wrong = []
        if goes_on[first] or last + 1 < n_leaves and goes_on[last + 1]:
            new = bpe.encode(region)
            if goes_on[first]:
                old = bpe.encode(text[begin : begin + int(sizes[first])])
                wrong += [True] * (old[:4] != new[:4])
            if last + 1 < n_leaves and goes_on[last + 1]:
                old = bpe.encode(text[stop - int(sizes[last]) : stop])
                wrong += [False] * (old[-4:] != new[-4:])
        if not wrong:
            break
        # A run of one character may be split anew to its end; doubling keeps that in proportion.
        for left in wrong:
            for _ in range(step):
                if goes_on[first] if left else last + 1 < n_leaves and goes_on[last + 1]:
                    wider(left)
        step *= 2
    leaves, flags = _leaves(region, count, bpe)
    flags[0] = goes_on[first]
    tree.replace(first, last, leaves, flags)
    return text[:start] + insert + text[end:], encoded


class _Counts(dict):
    """Tokens of recurring parts."""

    LIMIT = 1 << 19

    def __init__(self, bpe: ByteBPE):
        self.bpe, self.words = bpe, _WordCounts(bpe, self.LIMIT)

    def __missing__(self, part: str) -> int:
        if any(s in part for s in self.bpe.special):
            return len(self.bpe.encode(part)) // 4
        n = sum(map(self.words.__getitem__, self.bpe.words(part)))
        if len(part) <= 64:
            if len(self) >= self.LIMIT:
                self.clear()
            self[part] = n
        return n


class _WordCounts(dict):
    """Tokens of recurring pre-tokens."""

    def __init__(self, bpe: ByteBPE, limit: int):
        self.bpe, self.limit = bpe, limit

    def __missing__(self, word: str) -> int:
        symbols = list(map(self.bpe.of_byte.__getitem__, word.encode()))
        n = self._merged(symbols) if len(symbols) <= SHORT else len(self.bpe.merge(word))
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = n
        return n

    def _merged(self, symbols: list[int]) -> int:
        """How many symbols are left; the first of the pairs with the lowest rank is merged until there is none."""
        rank_of, results = self.bpe.merges.get, self.bpe.results
        ranks = [rank_of(x << BITS | y, _NONE) for x, y in zip(symbols, symbols[1:])]
        while ranks and (rank := min(ranks)) != _NONE:
            i = ranks.index(rank)
            symbols[i] = new = results[rank]
            del symbols[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(symbols[i - 1] << BITS | new, _NONE)
            if i < len(ranks):
                ranks[i] = rank_of(new << BITS | symbols[i + 1], _NONE)
        return len(symbols)


_COUNTS: dict[int, _Counts] = {}


def _counter(shared) -> tuple:
    """The counting function and the vocabulary of this worker."""
    bpe = _tokenizer(shared)
    if id(bpe) not in _COUNTS:
        _COUNTS.clear()
        _COUNTS[id(bpe)] = _Counts(bpe)
    return _COUNTS[id(bpe)].__getitem__, bpe


def _broadcast(df: DataFrame, tokenizer_path: str):
    with open(tokenizer_path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


STATE = "text string, leaves int, tree binary, n_tokens long"


def count(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, text, leaves, tree, n_tokens): the state of every document."""
    shared = _broadcast(docs, tokenizer_path)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_part, bpe = _counter(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                trees = [build(t, of_part, bpe) for t in b.column(1).to_pylist()]
                columns = [b.column(0), b.column(1), pa.array([t.levels[0].shape[1] for t in trees], pa.int32())]
                columns += [pa.array([t.pack() for t in trees], pa.binary()), pa.array([int(t.total[1]) for t in trees], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "leaves", "tree", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {STATE}")


EDIT = "array<struct<seq:bigint,start:bigint,end:bigint,insert:string>>"


def apply_listed(state: DataFrame, tokenizer_path: str) -> DataFrame:
    """The state after the edits in its column ``edits`` (EDIT), with ``encoded_chars``, the characters encoded for them."""
    shared = _broadcast(state, tokenizer_path)
    ordered = F.array_sort(F.coalesce("edits", F.from_json(F.lit("[]"), EDIT)))
    rows = state.select("doc_id", "text", "leaves", "tree", "n_tokens", ordered.alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_part, bpe = _counter(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                texts, trees, sizes = [], [], []
                for text, leaves, tree, edits in zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 5))):
                    tree, encoded = Tree.unpack(tree, leaves), 0
                    for e in edits:
                        text, chars = edit(text, tree, e["start"], e["end"], e["insert"], of_part, bpe)
                        encoded += chars
                    texts.append(text), trees.append(tree), sizes.append(encoded)
                columns = [b.column(0), pa.array(texts, pa.string()), pa.array([t.levels[0].shape[1] for t in trees], pa.int32()), pa.array([t.pack() for t in trees], pa.binary())]
                columns += [pa.array([int(t.total[1]) for t in trees], pa.int64()), pa.array(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "leaves", "tree", "n_tokens", "encoded_chars"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {STATE}, encoded_chars long")


def apply_edits(state: DataFrame, edits: DataFrame, tokenizer_path: str) -> DataFrame:
    """The state after the edits (doc_id, seq, start, end, insert)."""
    listed = edits.groupBy("doc_id").agg(F.collect_list(F.struct(*(F.col(c).cast("long").alias(c) for c in ("seq", "start", "end")), "insert")).alias("edits"))
    return apply_listed(state.join(listed, "doc_id", "left"), tokenizer_path)


def sample_edits(n: str = "n") -> str:
    """SQL for three edits of a text of n characters: an insertion, a deletion and a replacement."""
    return (
        f"array(named_struct('seq', 1L, 'start', {n} div 2, 'end', {n} div 2, 'insert', ' inserted words,'), "
        f"named_struct('seq', 2L, 'start', {n} div 4, 'end', {n} div 4 + 7, 'insert', ''), "
        f"named_struct('seq', 3L, 'start', 3 * {n} div 4, 'end', 3 * {n} div 4 + 5, 'insert', 'X'))"
    )


def digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Counts every document, edits each in three places and follows the counts."""
    state = count(docs, tokenizer_path)
    key = F.struct(F.col("doc_id").alias("id"), F.col("n_tokens").alias("n_before"))
    edited = state.withColumn("n", F.length("text").cast("long")).withColumn("edits", F.expr(sample_edits()))
    after = apply_listed(edited.withColumn("doc_id", key), tokenizer_path)
    return after.select(
        F.col("doc_id.id").alias("doc_id"),
        F.col("doc_id.n_before").alias("n_tokens"),
        F.col("n_tokens").alias("n_tokens_after"),
        "encoded_chars",
        F.sha2("text", 256).alias("text_sha256"),
    )
