"""Byte-level BPE encoding and decoding.

A text is cut at special tokens, then into pre-tokens by the vocabulary's
pattern. Each pre-token is a doubly linked list of symbols; a priority queue
holds the ranks of possible merges, and entries whose symbols have changed since
they were queued are skipped. Decoding concatenates the vocabulary's strings.

Defined cases: a null or empty text has no ids and decodes to the empty string;
ids that don't form UTF-8 decode with replacement characters; unknown ids raise.
Repeated rows and null doc_ids pass through; an empty table gives no rows; a long
text is held whole in a worker, as 4 bytes for each id and its queue for each
pre-token. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the split pattern that belongs to this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Any white space before a space; also true of some characters that the pattern doesn't count as space.
SPACE_RUN = re.compile(r"\s ").search
#: Parts kept with their ids by each Python worker; the memory is emptied when full.
MEMORY = 1 << 18
#: Longer parts are encoded anew each time.
MEMORY_CHARS = 64
#: Bits of an id in the key of a pair; NONE is no id.
BITS = 20
NONE = (1 << BITS) - 1
#: Rows of a batch sent back to the JVM at once.
ROWS = 512


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, to the byte."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Memory(dict):
    """Part of a text to packed ids."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        found = self.encode(word)
        if len(word) <= MEMORY_CHARS:
            if len(self) >= MEMORY:
                self.clear()
            self[word] = found
        return found


class ByteBPE:
    """A vocabulary with its merges, read from the text of a tokenizer JSON file."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        vocab, to_byte = spec["model"]["vocab"], byte_symbols()
        self.strings = {i: bytes(map(to_byte.__getitem__, s)) for s, i in vocab.items()}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings |= {i: s.encode() for s, i in special.items()}
        self.of_byte = [0] * 256
        for s, b in to_byte.items():
            self.of_byte[b] = vocab[s]
        self.merges, self.results = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left] << BITS | vocab[right]] = rank
            self.results.append(vocab[left + right])
        self.special = {s: struct.pack("<I", i) for s, i in special.items()}
        longest_first = sorted(special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if special else None
        self.words = regex.compile(PATTERN).findall
        self.of_word = _Memory(lambda word: struct.pack(f"<{len(ids := self.merge(word))}I", *ids))
        self.of_piece = _Memory(lambda piece: self._by_words(" " + piece))
        size = max(self.strings) + 1
        self.flat = np.frombuffer(b"".join(self.strings.get(i, b"") for i in range(size)), np.uint8)
        self.lengths = np.array([len(self.strings.get(i, b"")) for i in range(size)])
        self.begins = np.cumsum(self.lengths) - self.lengths

    def merge(self, word: str) -> list[int]:
        symbols = list(map(self.of_byte.__getitem__, word.encode()))
        n, rank_of, results = len(symbols), self.merges.get, self.results
        if n < 2:
            return symbols
        # A last symbol that merges with none ends the list; before[0] is -1, and so leads to it too.
        symbols.append(NONE)
        before, after = list(range(-1, n)), list(range(1, n + 1))
        left = symbols[0]
        queue = []
        for i in range(1, n):
            right = symbols[i]
            rank = rank_of(left << BITS | right)
            if rank is not None:
                queue.append(rank * n + i - 1)
            left = right
        heapq.heapify(queue)
        while queue:
            rank, i = divmod(heapq.heappop(queue), n)
            j = after[i]
            left = symbols[i]
            if left < 0 or rank_of(left << BITS | symbols[j]) != rank:
                continue
            symbols[i] = new = results[rank]
            symbols[j] = -1
            after[i] = k = after[j]
            before[k] = i
            rank = rank_of(new << BITS | symbols[k])
            if rank is not None:
                heapq.heappush(queue, rank * n + i)
            h = before[i]
            rank = rank_of(symbols[h] << BITS | new)
            if rank is not None:
                heapq.heappush(queue, rank * n + h)
        symbols.pop()
        return [s for s in symbols if s >= 0]

    def _by_words(self, text: str) -> bytes:
        return b"".join(map(self.of_word.__getitem__, self.words(text)))

    def _plain(self, text: str) -> bytes:
        """A text without special tokens.

        White space stands only at the start of a pre-token, so one ends before
        every space that follows a character other than white space. If that is
        every space, the text can be cut at its spaces, and the parts recur often.
        """
        if SPACE_RUN(text) or text[:1] == " ":
            return self._by_words(text)
        first, *pieces = text.split(" ")
        if pieces and not pieces[-1]:
            pieces.pop()
            return self._by_words(first) + b"".join(map(self.of_piece.__getitem__, pieces)) + self._by_words(" ")
        return self._by_words(first) + b"".join(map(self.of_piece.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(self.special.get(part) or self._plain(part) for part in self.cut.split(text))

    def decode(self, ids: bytes) -> str:
        """Concatenates the vocabulary's strings."""
        ids = np.frombuffer(ids, "<u4")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        where = np.repeat(self.begins[ids] - ends + lengths, lengths)
        where += np.arange(len(where))
        return self.flat[where].tobytes().decode("utf-8", "replace")


_LOADED: dict[int, ByteBPE] = {}


def _tokenizer(broadcast) -> ByteBPE:
    """One tokenizer for each Python worker."""
    key = hash(broadcast.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBPE(broadcast.value)
    return _LOADED[key]


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """(id, ids, decoded): ids as little-endian unsigned 32-bit integers in one binary value.

    The vocabulary file has a fixed size (about 1.5 MB); the driver reads it once
    and broadcasts it.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
                texts = [bpe.decode(x) for x in ids] if decode else [None] * len(ids)
                out = [part.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "decoded"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
