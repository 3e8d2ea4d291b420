"""Hard negatives for anchors, by sorted integer scores.

A component x counts as floor(256 * x); a score is the inner product of two such
vectors. For an anchor, its positives are the first rows of its label by score
(highest first, ties by smaller id), and for each of them the first rows of other
labels whose score lies between two shares of the positive's.

Anchors are a stated query set against all rows. Both are dealt into tiles of
bounded bytes; each pair of an anchor tile and a row tile meets in one place, by
one exchange, where anchors come first and rows follow by id. There a block of
anchors has its scores with the whole tile by one matrix product, sorts each
anchor's, searches every positive's upper limit in them and reads on. A first pass
finds positives, a second negatives; a tile returns as many of each as are wanted
in all, and windows over an anchor keep the first of all tiles.

Scores are exact: products run in double precision while these hold every sum, else
in 64-bit integers, else in unbounded ones. Components and scores beyond 64 bits
stop at the nearest 64-bit value.

Defined cases: rows with a null label, a null vector, or a null or non-finite
component take no part; shorter vectors count as if zeros followed, so an empty one
scores 0; rows that repeat take part one by one, each an "other row" of the rest; a
null id is no anchor, keeps its label and comes last in ties; an anchor without
positives, or a positive without negatives within the limits, gives no rows; an
empty table gives none; other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import partitions, scratch, written

SCALE = 256
#: Ids divisible by this are anchors.
ANCHOR_EVERY = 50
#: Where the id is divisible by this, the label moves on by one.
RELABEL_EVERY = 7
LABELS = 10
POSITIVES = 5
NEGATIVES = 3
#: Percent of a positive's score that a negative's has at least and at most.
AT_LEAST, AT_MOST = 50, 95
#: Bytes of the vectors of a tile, and of the scores of a block of anchors with one.
TILE_BYTES = 32 << 20
#: Fewest rows of a tile when the cluster has more partitions than tiles.
LEAST_ROWS = 1024
LOW, HIGH = -(2**63), 2**63 - 1


def vectors(embeddings: DataFrame, relabel_every: int = RELABEL_EVERY, labels: int = LABELS) -> DataFrame:
    """(row, id, label, v) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    moved = F.when(F.col("vec_id") % relabel_every == 0, (F.col("label").cast("long") + 1) % labels).otherwise(F.col("label").cast("long"))
    rows = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"), moved.alias("label"), scaled.alias("v"))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b, exact up to the range of 64 bits."""
    largest = [float(np.abs(x.astype(np.float64)).max(initial=0.0)) for x in (a, b)]
    bound = largest[0] * largest[1] * max(a.shape[1], 1)
    if bound < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2.0**62:
        return a @ b.T
    wide = a.astype(object) @ b.astype(object).T
    return np.clip(wide, LOW, HIGH).astype(np.int64)


class _Side:
    """Rows of one side of a tile, as arrays."""

    def __init__(self, t: pa.Table, dim: int):
        t = t.combine_chunks()
        self.row = t.column("row").to_numpy()
        self.label = t.column("label").to_numpy()
        self.id = t.column("id")
        self.v = t.column("v").combine_chunks().flatten().to_numpy().reshape(len(t), dim)
        self.asked = t.column("asked").to_pylist()


def _first_same(anchors: _Side, at: slice, rows: _Side, k: int) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, 0, index in rows, score) of the first other rows of an anchor's label."""
    found = scores(anchors.v[at], rows.v)
    for i, line in enumerate(found, at.start):
        same = np.flatnonzero((rows.label == anchors.label[i]) & (rows.row != anchors.row[i]))
        for j in same[np.argsort(~line[same], kind="stable")[:k]]:
            yield i, 0, int(j), int(line[j])


def _first_within(anchors: _Side, at: slice, rows: _Side, k: int, least: int, most: int) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, positive's number, index in rows, score) of the first rows of other labels within each positive's limits."""
    found = scores(anchors.v[at], rows.v)
    for i, line in enumerate(found, at.start):
        other = np.flatnonzero(rows.label != anchors.label[i])
        # The complement ascends where scores fall; rows come by id, and a stable sort keeps that order among ties.
        other = other[np.argsort(~line[other], kind="stable")]
        falling = ~line[other]
        for number, score in enumerate(anchors.asked[i] or ()):
            low, high = -(-least * score // 100), most * score // 100
            if low > high or high < LOW or low > HIGH:
                continue
            first = int(np.searchsorted(falling, ~min(high, HIGH)))
            for j in other[first : first + k]:
                if line[j] < low:
                    break
                yield i, number, int(j), int(line[j])


def _met(anchors: DataFrame, rows: DataFrame, anchor_tiles: int, row_tiles: int, dim: int, found) -> DataFrame:
    """(anchor, number, row, id, score) of what ``found`` returns for each pair of tiles; ``anchors`` have what is asked of them in ``asked``."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))).alias("v")
    left = anchors.select(own(anchor_tiles).alias("a"), every(row_tiles).alias("r"), F.lit(0).alias("side"), "row", "id", "label", padded, "asked")
    right = rows.select(every(anchor_tiles).alias("a"), own(row_tiles).alias("r"), F.lit(1).alias("side"), "row", "id", "label", padded, F.lit(None).cast("array<long>").alias("asked"))
    block = max(1, TILE_BYTES // (8 * (1 + TILE_BYTES // (8 * max(dim, 1)))))

    def tile(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cut = int(np.searchsorted(t.column("side").to_numpy(), 1))
        a, b = _Side(t.slice(0, cut), dim), _Side(t.slice(cut), dim)
        for first in range(0, len(a.row), block):
            if got := list(found(a, slice(first, min(first + block, len(a.row))), b)):
                i, number, j, score = (np.array(x, dtype=np.int64) for x in zip(*got))
                columns = [pa.array(a.row[i]), pa.array(number), pa.array(b.row[j]), b.id.take(pa.array(j)).combine_chunks(), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "number", "row", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            while len(held) and (held.column("a")[0], held.column("r")[0]) != (held.column("a")[len(held) - 1], held.column("r")[len(held) - 1]):
                a, r = held.column("a").to_numpy(), held.column("r").to_numpy()
                end = int(np.flatnonzero((a != a[0]) | (r != r[0]))[0])
                yield from tile(held.slice(0, end))
                held = held.slice(end)
        if held is not None and len(held):
            yield from tile(held)

    dealt = left.unionByName(right).repartition("a", "r").sortWithinPartitions("a", "r", "side", F.col("id").asc_nulls_last(), "row")
    return dealt.mapInArrow(run, "anchor long, number long, row long, id long, score long")


def _firsts(found: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor and number, with their rank."""
    order = Window.partitionBy("anchor", "number").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(
    embeddings: DataFrame, anchor_every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, at_least: int = AT_LEAST, at_most: int = AT_MOST,
    relabel_every: int = RELABEL_EVERY, tile_bytes: int = TILE_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    spark = embeddings.sparkSession
    with scratch(spark):
        rows = written(vectors(embeddings, relabel_every), "negatives-rows")
        anchors = rows.where(F.col("id") % anchor_every == 0)
        n, dim = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
        tile = max(1, tile_bytes // (8 * max(dim, 1)))
        tiles = lambda count: max(1, -(-count // tile))
        row_tiles = max(tiles(n), min(partitions(spark), n // LEAST_ROWS))
        anchor_tiles = tiles(anchors.count())
        unasked = anchors.withColumn("asked", F.lit(None).cast("array<long>"))
        same = _met(unasked, rows, anchor_tiles, row_tiles, dim, lambda a, at, b: _first_same(a, at, b, positives))
        same = written(_firsts(same, positives).select("anchor", (F.col("rank") - 1).alias("number"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-same")
        # At most ``positives`` rows for each anchor.
        asked = same.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("number", "positive_score"))), lambda x: x.positive_score).alias("asked"))
        ready = anchors.join(asked, anchors["row"] == asked["anchor"]).select("row", "id", "label", "v", "asked")
        other = _met(ready, rows, anchor_tiles, row_tiles, dim, lambda a, at, b: _first_within(a, at, b, negatives, at_least, at_most))
        other = _firsts(other, negatives).select("anchor", "number", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        named = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
        out = other.join(same, ["anchor", "number"]).join(named, "anchor")
        return written(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives", kept=True)


def oracle() -> str:
    return f"""
with e as materialized (
  select row_number() over () as r, vec_id, case when vec_id % {RELABEL_EVERY} = 0 then (label + 1) % {LABELS} else label end as label,
         list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (
  select a.r as a, a.vec_id as anchor_id, e.r, e.vec_id, a.label = e.label as same, cast(list_dot_product(a.v, e.v) as bigint) as score
  from e a join e on a.r <> e.r where a.vec_id % {ANCHOR_EVERY} = 0),
pos as (select a, r as p, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by a order by score desc, vec_id nulls last, r) <= {POSITIVES})
select anchor_id, positive_id, cast(row_number() over (partition by a, p order by score desc, vec_id nulls last, r) as integer) as rank, vec_id as negative_id, positive_score, score as negative_score
from s join pos using (a) where not same and {AT_LEAST} * positive_score <= 100 * score and 100 * score <= {AT_MOST} * positive_score
qualify rank <= {NEGATIVES}
"""
