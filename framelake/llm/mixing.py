"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a size in words; the sources share a budget in
proportion to their weights, but none beyond ``max_epochs`` times its size. What
a clamped source can't take is shared again by weight until no source is above
its cap. A source's target is then spent on whole repetitions of all its
documents plus one more, fractional repetition: documents in the order of a
seeded hash until the target is met, the last of them in part.

Defined cases: a null text has size 0; rows with a null source form a source of
their own, ordered last; a source without words has target 0; a null doc_id
hashes like the text 'null'; repeated rows are documents of their own, and rows
that share a doc_id but not the text go in the order of its hash; texts are
counted where they lie, however long; an empty table gives no rows. Sources are
as many as fit one sort (one row each), documents of a source any number. Other
columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import fresh_names, written

#: Words as Java's and RE2's regular expressions both understand them.
WORD = r"[^\x20\x09-\x0D]+"
#: The order within a source is cut into this many hex digits' worth of slices, so that no sort holds a whole source.
SLICE_DIGITS = 3


def water_fill(sizes: DataFrame, max_epochs: int = 3, weights: int = 3, share: float = 1.0) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target).

    Sources in code point order, null last, weigh 1, 2, .. ``weights``, repeating.
    One row per source: the windows below sort no more than these.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    t = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", (F.col("rank") - 1) % weights + 1)
    t = t.withColumn("cap", max_epochs * F.col("source_size"))
    # The sources that are clamped first come first; the level is the words per
    # unit of weight if all before a source are clamped and it is not.
    t = t.withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    budget = F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    t = t.withColumn("budget", budget * F.lit(share) if share != 1.0 else budget)
    t = t.withColumn("level", (F.col("budget") - before).cast("double") / rest)
    free = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("lambda", F.min(free).over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("lambda") * F.col("weight"), F.col("cap").cast("double")))
    return t.select("source", "source_size", "weight", target.alias("target"))


def _key(seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def mix(docs: DataFrame, seed: str = "mix-1", max_epochs: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every document."""
    placed = _placed(docs, seed, max_epochs)
    return placed.select("doc_id", "source", "size", "source_size", "target", "taken")


def _placed(docs: DataFrame, seed: str, max_epochs: int) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("text_hash"))
    sized = sized.withColumn("key", _key(seed)).withColumn("slice", F.substring("key", 1, SLICE_DIGITS))
    sized = written(sized, "mix-sizes")
    # A hot source is summed slice by slice before its slices are added up.
    slices = sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    totals = slices.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    targets = water_fill(totals, max_epochs)
    up_to = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.withColumn("slice_start", F.coalesce(F.sum("slice_size").over(up_to), F.lit(0)))
    plan = starts.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "slice_size")
    plan = plan.withColumnsRenamed({"source": "s", "slice": "sl"})
    within = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("sl")))
    words = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0)
    left = words - F.col("whole") * F.col("source_size") - F.col("slice_start") - F.col("before")
    placed = placed.withColumn("whole", whole)
    taken = F.col("whole") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))
    return placed.withColumn("taken", taken)


def sample(docs: DataFrame, seed: str = "mix-1", max_epochs: int = 3) -> DataFrame:
    """The mixed documents themselves: whole copies, then the part of a last one, cut after a word.

    Rows that repeat doc_id, text and source are all taken as often as the luckiest of them.
    """
    key, text_hash, source, size, taken, copy = fresh_names(docs, "id", "hash", "source", "size", "taken", "copy")
    found = _placed(docs, seed, max_epochs).where("taken > 0").groupBy("doc_id", "text_hash", "source", "size").agg(F.max("taken").alias("taken"))
    found = found.select(F.col("doc_id").alias(key), F.col("text_hash").alias(text_hash), F.col("source").alias(source), F.col("size").alias(size), F.col("taken").alias(taken))
    on = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(text_hash)) & F.col("source").eqNullSafe(F.col(source))
    joined = docs.join(found, on)
    copies = F.ceil(F.col(taken) / F.col(size)).cast("int")
    joined = joined.withColumn(copy, F.explode(F.sequence(F.lit(1), copies)))
    rest = (F.col(taken) - (F.col(copy) - 1) * F.col(size)).cast("int")
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), 1), F.lit(1), rest), " ")
    text = F.when(rest >= F.col(size), F.col("text")).otherwise(part)
    return joined.withColumn("text", text).select(*docs.columns)
