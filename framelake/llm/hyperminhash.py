"""Near-duplicate documents by HyperMinHash.

A document's set holds its distinct shingles of five words (A-Z lower-cased; a
shorter document is one shingle). Its sketch has 256 buckets; each keeps the
smallest hash that fell into it, compressed to a count of leading zeros and ten
mantissa bits. Runs of buckets are merged (the smallest hash again), and these are
banded into keys, empty ones filled from others by a fixed probing order. How
many follows from the threshold: at 85 percent, runs of four and 16 keys of four
registers. Pairs that share a key pass filters
by size, by a bound from shingles that no other candidate has, and by a Jaccard
estimate corrected for chance collisions, and are then verified on the full
sets.

Equal sets form a class, compared once, with an id of its own. The members of a
key with more than SMALL of them are dealt into chunks of about CHUNK. Within a
chunk, members gather around leaders, and pairs of a leader and a follower are
verified and merged; a second turn deals them anew, so that chunks merge too. Only
then are keys that still have several components compared in full, if they have
PLACE members at most; the members of larger ones are split by the rarest shingles
of their sets: at 85 percent, two linked sets share one of the rarest 15 percent of either
(prefix filter), so only members with such a shingle in common meet, under length
and position filters. At a shingle that many have, members outside its most
frequent component are compared with all others, chunk by chunk. So every link
between components is found, while a large group of near copies, or of texts that
share much but less than the threshold, neither meets in one task nor pairs up.

A pair at the threshold shares no key with probability below 1e-5, and an
estimate five standard deviations too low is as rare; nothing else drops pairs.
A threshold too low for that many keys is refused.

Defined cases: a null or empty text, or one without words, has an empty set, is
linked with nothing and is kept; repeated rows (same doc_id and text) are the same
document; rows that share a doc_id but not the text are documents of their own,
each linked by its text, that bring the same number into their components; a null
doc_id is a document of its own that links with nothing (component_id null,
kept); a text of n bytes takes about 40 n of memory in a worker; an empty table
gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import fresh_names, joined_by_key, scratch, written
from framelake.llm.graph import components
from framelake.llm.tokens import chunks, mix, split_words, window_hashes

SHINGLE = 5
BUCKET_BITS = 8
BUCKETS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
#: Most buckets merged for banding, and most merged registers in a band.
MERGE = 4
BAND = 4
#: Most of the pairs at the threshold that may share no key.
MISSED = 1e-5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Keys with at most so many members compare them pair by pair at once.
SMALL = 16
#: Members of a larger key that are compared in one place, on average.
CHUNK = 512
#: Most members of a key that still has several components after the turns for all of them to be compared in one place.
PLACE = 2048
#: Turns of gathering around leaders.
TURNS = 2
#: Standard deviations by which an estimate may be too low.
MARGIN = 5.0
#: Fixed value of the method: share of equal registers of independent sets, for one register of 2**-MANTISSA_BITS.
COLLISION = 0.169919487159739093975315012348630288992889


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    for first, end, data, offsets in chunks(texts):
        words = split_words(data, offsets, lower=True)
        hashes, counts = words.hashes(), words.counts
        starts, text = words.windows(SHINGLE)
        shingles = window_hashes(hashes, starts, SHINGLE)
        cut = np.searchsorted(text, np.arange(end - first + 1))
        short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
        whole = dict(zip(short.tolist(), window_hashes(hashes, words.first[short], counts[short]) ^ counts[short].astype(np.uint64)))
        for i in range(end - first):
            yield np.array([whole[i]], dtype=np.uint64) if i in whole else np.unique(shingles[cut[i] : cut[i + 1]])


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BUCKETS) of 16 bits: leading zeros, then the mantissa, plus one; 0 is an empty bucket."""
    out = np.zeros((len(sets), BUCKETS), dtype=np.uint16)
    if not sum(map(len, sets)):
        return out
    hashes = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    # Hashes ascend within a set, so the first one of each bucket is its smallest.
    slot = row * BUCKETS + bucket
    first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    rest = hashes[first] << np.uint64(BUCKET_BITS)
    zeros = (53 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1]).astype(np.uint64)
    mantissa = rest << zeros << np.uint64(1) >> np.uint64(64 - MANTISSA_BITS)
    out.reshape(-1)[slot[first]] = (zeros << np.uint64(MANTISSA_BITS) | mantissa) + np.uint64(1)
    return out


def banding(percent: int) -> tuple[int, int, int]:
    """(buckets merged, registers in a band, bands) by which a pair at the threshold misses all bands with probability MISSED at most."""
    if not 0 < percent <= 100:
        raise ValueError(f"a threshold of {percent} percent")
    for band in range(BAND, 0, -1):
        miss = 1 - (percent / 100) ** band
        bands = math.ceil(math.log(MISSED) / math.log(miss)) if miss > 0 else 1
        merge = MERGE
        while merge > 1 and band * bands * merge > BUCKETS:
            merge //= 2
        if band * bands * merge <= BUCKETS:
            return merge, band, bands
    raise ValueError(f"{BUCKETS} registers are too few to find pairs at {percent} percent")


@functools.cache
def _probes(merged_bits: int) -> np.ndarray:
    merged = 1 << merged_bits
    return (mix(np.arange(128 * merged, dtype=np.uint64)) >> np.uint64(64 - merged_bits)).astype(np.int64).reshape(128, merged)


def band_keys(regs: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """(sets, bands) keys; meaningless for empty sets."""
    merge, band, bands = banding(percent)
    merged_bits = BUCKET_BITS - (merge - 1).bit_length()
    runs = regs.reshape(len(regs), 1 << merged_bits, merge)
    first = (runs > 0).argmax(axis=2)
    merged = np.take_along_axis(runs, first[:, :, None], 2)[:, :, 0].astype(np.uint64)
    merged = np.where(merged > 0, merged | first.astype(np.uint64) << np.uint64(16), 0).astype(np.uint64)
    full = merged.copy()
    for probe in _probes(merged_bits):
        row, col = np.nonzero(full == 0)
        if not len(row):
            break
        full[row, col] = merged[row, probe[col]]
    row, col = np.nonzero(full == 0)
    full[row, col] = merged[row, (merged[row] > 0).argmax(axis=1)]
    wide = full[:, : band * bands].reshape(len(regs), bands, band)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), wide.shape[:2])
    for j in range(band):
        keys = mix(keys ^ wide[:, :, j])
    return keys


def sketches(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, h, n, f1, f2, keys): hash of the text, set size, fingerprint and band keys of each row."""
    banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, sets = 0, []
            for s in shingle_sets(b.column(2)):
                sets.append(s)
                if len(sets) == 512:
                    yield _sketched(b.slice(at, 512), sets, percent)
                    at, sets = at + 512, []
            if sets:
                yield _sketched(b.slice(at), sets, percent)

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, h long, n long, f1 long, f2 long, keys array<long>")


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    return int(s.sum().astype(np.int64)), int(mix(s).sum().astype(np.int64)) if len(s) else 0


def _longs(rows: np.ndarray) -> pa.ListArray:
    """Rows of as many 64-bit values each."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.reshape(-1).view(np.int64)))


def _sketched(rows: pa.RecordBatch, sets: list[np.ndarray], percent: int) -> pa.RecordBatch:
    keys = _longs(band_keys(registers(sets), percent))
    prints = [_fingerprint(s) for s in sets]
    columns = [rows.column(0), rows.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, keys], ["doc_id", "h", "n", "f1", "f2", "keys"])


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, n, shingles, regs: four registers in each long) of the classes wanted (id, doc_id, f1, f2), from the text of one of their documents."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(wanted, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f1, f2 = b.column(2).to_pylist(), b.column(3).to_pylist()
            for i, s in enumerate(shingle_sets(b.column(1))):
                # A doc_id that occurs with several texts meets the classes of all of them.
                if _fingerprint(s) == (f1[i], f2[i]):
                    lists = [_longs(s[None, :]), _longs(registers([s]).view(np.int64))]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([len(s)], pa.int64()), *lists], ["id", "n", "shingles", "regs"])

    found = rows.select("id", "text", "f1", "f2").mapInArrow(run, "id long, n long, shingles array<long>, regs array<long>")
    return found.dropDuplicates(["id"])


# --- comparing members of keys ---------------------------------------------

#: What is known of a member where it is compared; members of one place are those with the same key and part.
MEMBER = ["key", "part", "side", "rank", "band", "id", "label", "n", "alone", "keys", "regs"]


class _Members:
    """Members in the order of their places, as arrays."""

    def __init__(self, t: pa.Table):
        for name in MEMBER[:-2]:
            setattr(self, name, t.column(name).to_numpy())
        flat = lambda name: t.column(name).combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        self.keys = flat("keys")
        self.regs = np.ascontiguousarray(flat("regs")).view(np.uint16)
        new = np.concatenate([[True], (self.key[1:] != self.key[:-1]) | (self.part[1:] != self.part[:-1])]) if len(t) else np.zeros(0, bool)
        self.first = np.flatnonzero(new)
        self.place = np.cumsum(new) - 1
        self.size = np.diff([*self.first, len(t)])

    def open(self, i, j, percent: int) -> np.ndarray:
        """False only for pairs of one component and pairs that can't be links by their sizes and the shingles that no other candidate has."""
        ni, nj = self.n[i], self.n[j]
        most = np.minimum(ni - self.alone[i], nj - self.alone[j])
        return (self.label[i] != self.label[j]) & (100 * most >= percent * (ni + nj - most))

    def estimates(self, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Jaccard estimates corrected for chance collisions, and how far below the truth they may be."""
        out, slack, t = np.zeros(len(i)), np.zeros(len(i)), percent / 100
        for at in range(0, len(i), 4096):
            a, b = i[at : at + 4096], j[at : at + 4096]
            x, y = self.regs[a], self.regs[b]
            used = np.count_nonzero(x | y, axis=1)
            equal = used - np.count_nonzero(x != y, axis=1)
            na, nb = self.n[a].astype(np.float64), self.n[b].astype(np.float64)
            ratio = na / nb
            chance = COLLISION * 2.0 ** (BUCKET_BITS - MANTISSA_BITS) * 4 * ratio / (1 + ratio) ** 2
            out[at : at + 4096] = (equal - chance) / used
            # The variance of one hash for all buckets, for a union of the size it has at the threshold.
            union = np.maximum((na + nb) / (1 + t), 2.0)
            variance = t * (1 - t) * ((1 + 1 / (union - 1)) / used - 1 / (union - 1))
            slack[at : at + 4096] = MARGIN * np.sqrt(np.maximum(variance, 0.0)) + 1 / used
        return out, slack

    def likely(self, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that may be links, each only at the first band key that both have; at keys of no band, wherever they meet."""
        keep = self.open(i, j, percent)
        i, j = i[keep], j[keep]
        keep = (self.band[i] < 0) | ((self.keys[i] == self.keys[j]).argmax(axis=1) == self.band[i]) if len(i) else keep[:0]
        i, j = i[keep], j[keep]
        guess, slack = self.estimates(i, j, percent)
        keep = guess >= percent / 100 - slack
        return i[keep], j[keep]

    def pairs(self, small: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Likely links within small places, all pairs of them."""
        for step in range(1, int(self.size[small].max(initial=0))):
            i = np.flatnonzero(small[self.place[:-step]] & (self.place[:-step] == self.place[step:])) if step < len(self.place) else np.zeros(0, np.int64)
            if not len(i):
                return
            yield self.likely(i, i + step, percent)

    def stars(self, place: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Leaders and followers within a place: a member that follows none leads those after it that resemble it."""
        left = np.arange(self.first[place], self.first[place] + self.size[place])
        while len(left) > 1:
            lead, left = left[0], left[1:]
            left = left[self.label[left] != self.label[lead]]
            near = np.flatnonzero(self.open(lead, left, percent))
            guess, _ = self.estimates(np.full(len(near), lead), left[near], percent)
            near = near[guess >= percent / 100]
            if len(near):
                yield np.full(len(near), lead), left[near]
                left = np.delete(left, near)

    def across(self, place: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Likely links between the left and right members of a place; side is 0 for left ones, 1 for right ones that are left ones elsewhere, else 2."""
        own = np.arange(self.first[place], self.first[place] + self.size[place])
        left, right = own[self.side[own] == 0], own[self.side[own] > 0]
        for i in left:
            j = right[(self.side[right] == 2) | (self.id[right] > self.id[i])]
            yield self.likely(np.full(len(j), i), j, percent)


def _compared(members: DataFrame, percent: int, how: str) -> DataFrame:
    """(a, b) pairs that are likely links, of members dealt by key and part: ``pairs`` are all in a place, ``stars`` only those of leaders where a place isn't small, ``across`` those of its two sides."""

    def found(m: _Members) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if how == "pairs":
            yield from m.pairs(m.size > 0, percent)
            return
        if how == "across":
            for place in range(len(m.first)):
                yield from m.across(place, percent)
            return
        yield from m.pairs(m.size <= SMALL, percent)
        for place in np.flatnonzero(m.size > SMALL):
            yield from m.stars(int(place), percent)

    def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
        m = _Members(t)
        pairs = [(m.id[i], m.id[j]) for i, j in found(m) if len(i)]
        if pairs:
            i, j = (np.concatenate(x) for x in zip(*pairs))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            key, part = held.column("key").to_numpy(), held.column("part").to_numpy()
            # The last place may go on in the next batch; no place has many more than CHUNK members a side.
            whole = int(np.flatnonzero((key != key[-1]) | (part != part[-1]))[-1]) + 1 if len(key) and (key[0], part[0]) != (key[-1], part[-1]) else 0
            if whole:
                yield from emit(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and len(held):
            yield from emit(held)

    dealt = members.select(*MEMBER).repartition("key", "part").sortWithinPartitions("key", "part", "side", "rank", "id")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links, by their full sets."""
    one = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _classes(sketched: DataFrame) -> DataFrame:
    """(id, doc_id, f1, f2, n, keys, copies) of each set; the ids hold once they are written."""
    of = sketched.where("n > 0 and doc_id is not null").groupBy("f1", "f2", "n")
    of = of.agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("copies"))
    return of.withColumn("id", F.monotonically_increasing_id())


def _dealt(member: DataFrame, facts: DataFrame, turn: int, most: int = CHUNK) -> DataFrame:
    """Members with what is known of them, in chunks that change from turn to turn."""
    chunk = F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("size") / most))
    rows = member.withColumn("part", chunk).withColumn("side", F.lit(0)).withColumn("rank", F.xxhash64("id", F.lit(-turn)))
    return rows.join(facts, "id")


def _sides(member: DataFrame, facts: DataFrame) -> DataFrame:
    """Members outside their key's most frequent component, each chunk beside every chunk of all members."""
    counts = member.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), F.first("size").alias("size"))
    most = counts.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.max("c").alias("c"), F.first("size").alias("size"))
    plan = written(most.select("key", "main", "size", F.ceil((F.col("size") - F.col("c")) / CHUNK).alias("lefts"), F.ceil(F.col("size") / CHUNK).alias("rights")), "near-sides")
    rows = joined_by_key(member.drop("size"), plan, ["key"], "size").withColumn("minor", F.col("label") != F.col("main"))
    own = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rows.where("minor").withColumn("l", own("lefts", 7)).withColumn("r", every("rights")).withColumn("side", F.lit(0))
    right = rows.withColumn("r", own("rights", 8)).withColumn("l", every("lefts")).withColumn("side", F.when(F.col("minor"), 1).otherwise(2))
    both = left.unionByName(right).withColumn("part", F.col("l") * F.col("rights") + F.col("r")).withColumn("rank", F.lit(0).cast("long"))
    return both.drop("main", "size", "lefts", "rights", "minor", "l", "r").join(facts, "id")


def _prefixes(now: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, id, label, band, rest, size): members (id, label) at the shingles that a link of theirs must share one of.

    Shingles of a set are ordered by how many of these sets have them, rarest
    first. ``rest`` counts those from a shingle on; two sets have no more in common
    than the smaller rest at the rarest one they share, so shingles with fewer than
    ``percent`` of the set left are keys of no link. Keys of one component only are
    left out.
    """
    ids = written(now.select("id", "label").distinct(), "near-ids")
    each = sets.select("id", "n", "shingles").join(ids, "id").select("id", "label", "n", F.explode("shingles").alias("key"))
    met = written(each.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "near-shingles")
    rest = F.row_number().over(Window.partitionBy("id").orderBy(F.col("c").desc(), F.col("key").desc()))
    found = joined_by_key(each, met, ["key"], "c").withColumn("rest", rest).where(100 * F.col("rest") >= percent * F.col("n"))
    found = written(found.select("key", "id", "label", F.lit(-1).alias("band"), "rest"), "near-prefixes")
    apart = found.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high")
    return written(joined_by_key(found, written(apart.select("key", "size"), "near-open"), ["key"], "size"), "near-left")


def _rest_compared(now: DataFrame, facts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) likely links between different components, of members (id, label) of open keys."""
    split = _prefixes(now, sets, percent)
    known = lambda members: members.withColumn("alone", F.col("n") - F.col("rest"))  # noqa: E731  what can't be in common from here on
    zero = F.lit(0).cast("long")
    small = split.where(F.col("size") <= SMALL).withColumns({"part": zero, "side": F.lit(0), "rank": zero}).join(facts, "id")
    large = split.where(F.col("size") > SMALL)
    found = _compared(known(small), percent, "pairs")
    return found if large.isEmpty() else found.unionByName(_compared(known(_sides(large, facts)), percent, "across")).distinct()


def link_classes(docs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, label) of every class that shares a key with another; label is the smallest reachable."""
    every = classes.select("id", F.posexplode("keys").alias("band", "key"))
    shared = written(every.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "near-keys")
    member = written(joined_by_key(every, shared, ["key"], "size"), "near-members")
    pool = written(classes.select("id", "doc_id", "f1", "f2", "n", "keys").join(member.select("id").distinct(), "id"), "near-pool")
    sets = written(_sets(docs, pool.select("id", "doc_id", "f1", "f2")), "near-sets")
    # A shingle of one candidate only can be in no intersection.
    single = sets.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id"))
    alone = single.where("c = 1").groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    facts = pool.select("id", "n", "keys").join(sets.select("id", "regs"), "id").join(alone, "id", "left").fillna(0, ["alone"])
    facts = written(facts.where(100 * (F.col("n") - F.col("alone")) >= percent * F.col("n")), "near-facts")
    member = member.join(facts.select("id"), "id", "left_semi")
    labels = facts.select("id", F.col("id").alias("label"))
    links, large = None, None
    for turn in range(TURNS + 1):
        now = (member if large is None else large).join(labels, "id")
        if turn:
            open_keys = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high")
            open_keys = written(open_keys.select("key", "size"), "near-open")
            if open_keys.isEmpty():
                break
            now = joined_by_key(now.drop("size"), open_keys, ["key"], "size")
        if turn < TURNS:
            pairs = _compared(_dealt(now, facts, turn), percent, "stars")
        else:
            # Keys that fit one place compare all their members there, in time bounded for each; only larger ones are split.
            fits = F.col("size") <= PLACE
            pairs = _compared(_dealt(now.where(fits), facts, turn, PLACE), percent, "pairs")
            if not open_keys.where(~fits).isEmpty():
                pairs = pairs.unionByName(_rest_compared(now.where(~fits), facts, sets, percent)).distinct()
        new = _verified(pairs, sets, percent)
        if turn == TURNS:
            # One link between two components is enough.
            a, b = (labels.select(F.col("id").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
            new = new.join(a, "a").join(b, "b").groupBy(F.least("la", "lb").alias("la"), F.greatest("la", "lb").alias("lb"))
            new = new.agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")
        new = written(new, "near-links")
        links = new if links is None else links.union(new)
        found = components(links)
        labels = facts.select("id").join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("label", "id").alias("label"))
        labels = written(labels, "near-labels")
        large = member.where(F.col("size") > SMALL) if large is None else large
    return labels


def _verdicts(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, h, n, class_id, component_id) for every row."""
    # The verdicts are read from the sketches and the named classes only.
    with scratch(docs.sparkSession):
        sketched = written(sketches(docs, percent), "near-sketches", kept=True)
        classes = written(_classes(sketched), "near-classes")
        labels = link_classes(docs, classes, percent)
        labelled = classes.select("id", "doc_id", "f1", "f2", "n", "copies").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        labelled = written(labelled, "near-labelled")
        lowest = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("classes"))
        named = joined_by_key(labelled, written(lowest, "near-lowest"), ["label"], "classes")
        named = written(named.select("f1", "f2", "n", F.col("doc_id").alias("class_id"), "component_id", "copies"), "near-named", kept=True)
    rows = sketched.select("doc_id", "h", "n", "f1", "f2")
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    alone = rows.where(~linked).withColumns({"class_id": F.col("doc_id"), "component_id": F.col("doc_id")})
    out = joined_by_key(rows.where(linked), named, ["f1", "f2", "n"], "copies")
    columns = ["doc_id", "h", "n", "class_id", "component_id"]
    return out.select(*columns).unionByName(alone.select(*columns))


def near_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept) for every row."""
    out = _verdicts(docs, percent).select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of one document of each group, with all their columns."""
    stays = _verdicts(docs, percent).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    key, text = fresh_names(docs, "id", "text_hash")
    stays = stays.select(F.col("doc_id").alias(key), F.col("h").alias(text)).distinct()
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(text))
    return docs.join(stays, on, "left_semi")
