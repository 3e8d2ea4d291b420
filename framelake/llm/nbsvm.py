"""A quality classifier of Naive Bayes support vectors.

A document's features are indicators of its n-grams: pairs of bytes, words and
pairs of words hashed to buckets, and classes of how often a pair holds the same
word twice and of how many n-grams are distinct. Each indicator is scaled by its log-count
ratio between the classes, the vector is brought to unit length, and a linear
model with hinge loss is fitted by dual coordinate descent. A logistic curve,
fitted on sampled documents that the linear model hasn't seen, turns margins
into scores from 0 to 1.

The model is fitted on a bounded sample of the labelled documents, SAMPLE_ROWS
by default (documented parameter ``sample_rows``): those whose hashed doc_id is
smallest. Every document is scored on its whole text.

Defined cases: a null or empty text has no features and gets the score of the
bias alone; labels that are null or neither 0 nor 1, and labels without a
document, are ignored; repeated label rows count repeatedly; without rows of
both classes the score is the share of label 1 (0.5 without labels). A null
doc_id has no label and is not held out. A doc_id in many rows takes no more than
its part of the sample. Repeated rows get equal scores; an empty table gives no
rows; a text of n bytes takes about 40 n of memory in a worker. Only doc_id and
text are looked at, whatever else the tables have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import fresh_names, scratch, written
from framelake.llm.tokens import chunks, split_words, window_hashes

SAMPLE_ROWS = 4096
#: Most bytes of feature numbers, four for each feature of a document, that go to the driver.
SAMPLE_BYTES = 128 << 20
WORD_BITS = 17
PAIRS = 1 << 16
REPEATS = PAIRS + (1 << WORD_BITS)
SIZE = REPEATS + 32
SMOOTHING = 1.0
COST = 4.0
EPOCHS = 20
#: Descent ends when no step of a whole epoch is larger.
CLOSE = 1e-3
THRESHOLD = 0.3


def held_out(id_col: str = "doc_id") -> Column:
    """One fold in five is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct feature numbers of each text, ascending."""
    seen = np.zeros(SIZE, dtype=bool)
    bucket = np.uint64(64 - WORD_BITS)
    for first, end, data, offsets in chunks(texts):
        words = split_words(data, offsets)
        hashes = words.hashes()
        single = (hashes >> bucket).astype(np.int64) + PAIRS
        starts, text = words.windows(2)
        double = (window_hashes(hashes, starts, 2) >> bucket).astype(np.int64) + PAIRS
        cut = np.searchsorted(text, np.arange(end - first + 1))
        same = np.concatenate([[0], np.cumsum(hashes[starts] == hashes[starts + 1])])
        wide = data.astype(np.int64)
        pairs = wide[:-1] << 8 | wide[1:] if len(wide) else wide
        for i in range(end - first):
            seen[pairs[offsets[i] : max(offsets[i], offsets[i + 1] - 1)]] = True
            seen[single[words.first[i] : words.first[i + 1]]] = True
            seen[double[cut[i] : cut[i + 1]]] = True
            n_pairs = cut[i + 1] - cut[i]
            n_grams = n_pairs + words.first[i + 1] - words.first[i]
            if n_pairs:
                share = (same[cut[i + 1]] - same[cut[i]]) / n_pairs
                seen[REPEATS + (min(max(int(np.ceil(np.log2(share) + 8)), 1), 8) if share else 0)] = True
                seen[REPEATS + 10 + int(20 * np.count_nonzero(seen[PAIRS:REPEATS]) / n_grams)] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            yield found


@dataclass
class Model:
    """margin = sum(weight) / sqrt(sum(square)) + bias over a text's features."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        norm = float(self.square[found].sum())
        return (float(self.weight[found].sum()) / norm**0.5 if norm > 0 else 0.0) + self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -30, 30))))


def _ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = {s: np.full(SIZE, SMOOTHING) for s in (1, -1)}
    for found, s in zip(rows, y):
        counts[s][found] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())


def _descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; the bias is a feature of value 1."""
    values = [ratio[f] / max(float(np.sqrt((ratio[f] ** 2).sum())), 1e-12) for f in rows]
    w, bias, alpha = np.zeros(SIZE), 0.0, np.zeros(len(rows))
    q = np.array([float((v * v).sum()) + 1 for v in values])
    # The rarer class counts for as much as the other.
    cost = np.where(y > 0, COST * len(y) / (2 * max((y > 0).sum(), 1)), COST * len(y) / (2 * max((y < 0).sum(), 1)))
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        most = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1
            new = min(max(alpha[i] - gradient / q[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
                most = max(most, abs(step))
        if most < CLOSE:
            break
    return w, bias


def _logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve by Newton's method, with smoothed targets."""
    n1, n0 = int(label.sum()), int((1 - label).sum())
    t = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, s = p - t, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(d * margin).sum() + 1e-6 * a, d.sum()])
        h = np.array([[(s * margin**2).sum() + 1e-6, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
        if abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def fit(rows: list[np.ndarray], label: np.ndarray, seed: int = 1) -> Model:
    y = np.where(label == 1, 1, -1)
    if len(set(y.tolist())) < 2:
        share = float(np.clip(label.mean(), 0.001, 0.999)) if len(label) else 0.5
        return Model(np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    learn = np.arange(len(rows)) % 5 != 0
    if len(set(y[learn].tolist())) < 2 or len(set(y[~learn].tolist())) < 2:
        learn[:] = True
    own = [r for r, keep in zip(rows, learn) if keep]
    ratio = _ratios(own, y[learn])
    w, bias = _descend(own, y[learn], ratio, seed)
    model = Model((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), bias, 1.0, 0.0)
    rest = [i for i in range(len(rows)) if not learn[i]] or range(len(rows))
    model.slope, model.shift = _logistic(np.array([model.margin(rows[i]) for i in rest]), np.array([label[i] for i in rest]))
    return model


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits on the driver; it gets the feature numbers of at most ``sample_rows`` documents, and of so many of these, in the order of a hash, as have ``sample_bytes`` of them.

    Texts are turned into features where they lie; only keys and sizes are sorted.
    """
    label = F.col(label_col).cast("int").alias("label")
    usable = labels.select("doc_id", label).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)
    # At most sample_rows pairs of numbers, so this side may be broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [f.astype("<i4").tobytes() for f in features(b.column(1))]
            columns = [b.column(0), b.column(2), b.column(3), pa.array([len(f) for f in found], pa.int64()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "text_hash", "bytes", "found"])

    texts = texts.select(F.col("doc_id").cast("long"), "text", "label", F.xxhash64("text").alias("text_hash"))
    key = ["doc_id", "label", "text_hash"]
    with scratch(docs.sparkSession):
        made = written(texts.mapInArrow(run, "doc_id long, label int, text_hash long, bytes long, found binary"), "quality-features")
        # A doc_id may be in many rows, so the bound holds once more after the join.
        sizes = made.select(*key, "bytes").orderBy(F.xxhash64("doc_id"), *key).limit(sample_rows).collect()
        total, kept = 0, []
        for r in sizes:
            total += r.bytes
            if total > sample_bytes and kept:
                break
            kept.append((r.doc_id, r.label, r.text_hash))
        chosen = F.broadcast(docs.sparkSession.createDataFrame(sorted(set(kept)), "doc_id long, label int, text_hash long"))
        # As many rows of a key as the sample has of it.
        times = {k: kept.count(k) for k in set(kept)} if len(set(kept)) < len(kept) else {}
        once = made.join(chosen, key, "left_semi").dropDuplicates(key).collect()
    rows = [r for r in once for _ in range(times.get((r.doc_id, r.label, r.text_hash), 1))]
    rows.sort(key=lambda r: (_spread(r.doc_id), r.doc_id, r.label, bytes(r.found)))
    return fit([np.frombuffer(r.found, "<i4").astype(np.int64) for r in rows], np.array([r.label for r in rows], dtype=np.int64))


def _spread(x: int) -> int:
    """An order of the sample that doesn't depend on how documents were numbered."""
    return (x * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row; the model has a fixed size of about 1.6 MB."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [shared.value.score(f) for f in features(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose score reaches THRESHOLD, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    (text,) = fresh_names(docs, "text")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [shared.value.score(f) >= THRESHOLD for f in features(b.column(len(names)))]
            yield pa.RecordBatch.from_arrays(b.columns[: len(names)], names).filter(pa.array(keep, pa.bool_()))

    return docs.withColumn(text, F.coalesce("text", F.lit(""))).mapInArrow(run, docs.schema)
