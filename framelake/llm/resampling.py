"""Target-distribution importance resampling with position-table n-grams.

A text's words are runs of letters and digits, A-Z lower-cased. Words are exploded
with their positions; lead() over a document's positions gives the words that
follow, and so all runs of one to three words. A run's bucket is its crc32 modulo
BUCKETS. The gain of a bucket compares how often it occurs in the target and in the
corpus; a document's weight is the sum of the gains of its runs. Gumbel noise from
a seeded hash of the document's id makes the highest scores a sample without
replacement in proportion to exp(weight / 1000).

Texts are shuffled once by a number of their rows, so that a document's words are
exploded, sorted and hashed where they then lie; the buckets of each place are
written, from which both the corpus's sums and the weights are read. Sums are
combined before they are shuffled. The
table of gains has BUCKETS rows at most and is broadcast. Ranks come from a range
partitioning by score: the number of rows in the parts before, and a row number
within the part; only as many parts are numbered as have drawn rows.

Defined cases: a null or empty text has no features, weighs 0, is no candidate and
keeps its row; rows that repeat are documents of their own that tie, and which of
them goes first makes no difference; a null doc_id counts as the text ``null`` in
the hash and comes after others in ties; an empty target or corpus makes counts of
0, which the formula allows; other columns, whatever their names, aren't looked at.
A text of n bytes is one value of a row, its words one array of a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import partitions, scratch, written

ORDERS = 3
BUCKETS = 10_000
SEED = 42
#: Documents with fewer words aren't drawn.
LEAST_WORDS = 20
#: Percent of the candidates that is drawn.
PERCENT = 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def places(docs: DataFrame, id_column: str = "doc_id", orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(row, doc_id, b1, b2, ...): the buckets of the runs that start at each word of each row, null past the text's end; a row without words has one line of nulls."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.repartition(partitions(docs.sparkSession), "row")
    words = rows.select("row", "doc_id", F.posexplode_outer(F.regexp_extract_all("text", F.lit(WORD), 0)).alias("pos", "w1"))
    follows = Window.partitionBy("row").orderBy("pos")
    words = words.select("row", "doc_id", "w1", *[F.lead("w1", k - 1).over(follows).alias(f"w{k}") for k in range(2, orders + 1)])
    run = lambda k: F.concat(*[x for j in range(1, k + 1) for x in (F.lit(" "), F.col(f"w{j}"))][1:])
    return words.select("row", "doc_id", *[F.pmod(F.crc32(run(k).cast("binary")), F.lit(buckets)).cast("int").alias(f"b{k}") for k in range(1, orders + 1)])


def _bucket_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("row", "doc_id")]


def bucket_sums(found: DataFrame) -> DataFrame:
    """(bucket, n): how often each bucket occurs in all places."""
    each = found.select(F.explode(F.array(*_bucket_columns(found))).alias("bucket"))
    return each.where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of the buckets of the corpus, from the places of both tables; BUCKETS rows at most."""
    s = written(bucket_sums(corpus).withColumnRenamed("n", "s"), "mix-corpus")
    t = written(bucket_sums(target).withColumnRenamed("n", "t"), "mix-target")
    size = lambda df, c: float(df.agg(F.sum(c)).first()[0] or 0)
    real = lambda x: F.col(x).cast("double")
    ratio = (real("t") + 1) * (size(s, "s") + buckets) / ((real("s") + 1) * (size(t, "t") + buckets))
    return s.join(F.broadcast(t), "bucket", "left").fillna(0, ["t"]).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(found: DataFrame, gain: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight) from a table's places and the gains."""
    columns = _bucket_columns(found)
    for c in columns:
        found = found.join(F.broadcast(gain.select(F.col("bucket").alias(c), F.col("gain").alias(f"{c}_gain"))), c, "left")
    there = sum(F.col(c).isNotNull().cast("int") for c in columns)
    worth = sum(F.coalesce(F.col(f"{c}_gain"), F.lit(0).cast("long")) for c in columns)
    return found.groupBy("row", "doc_id").agg(F.count(columns[0]).alias("n_words"), F.sum(there).alias("n_features"), F.sum(worth).alias("weight"))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel variate from the seeded hash of an id, rounded down."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(candidates: DataFrame, draws: int) -> DataFrame:
    """(row, rank) of the first ``draws`` candidates (row, doc_id, score) by score, highest first, then by doc_id and row."""
    spark = candidates.sparkSession
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    # Written, as another run of the partitioning could cut elsewhere.
    parts = candidates.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id())
    parts = written(parts, "mix-parts")
    # One count for each part.
    counts = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = 0, []
    for part in sorted(counts):
        if before < draws:
            offsets.append((part, before))
        before += counts[part]
    first = F.broadcast(spark.createDataFrame(offsets, "part int, before long"))
    placed = parts.join(first, "part")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return placed.select("row", rank.alias("rank")).where(F.col("rank") <= draws)


def resample(docs: DataFrame, target: DataFrame, target_id: str = "item_id", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null for those that aren't drawn."""
    spark = docs.sparkSession
    with scratch(spark):
        found = written(places(docs), "mix-places")
        weighed = weights(found, gains(found, places(target, target_id)))
        weighed = written(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "mix-weights", kept=True)
        candidates = weighed.where(F.col("n_words") >= least_words).select("row", "doc_id", "score")
        draws = percent * candidates.count() // 100
        ranks = written(ranked(candidates, draws), "mix-ranks", kept=True)
    out = weighed.join(ranks, "row", "left")
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def oracle() -> str:
    words = lambda t, i: f"select {i} as id, row_number() over () as row, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as w from {t}"
    runs = " union all ".join(f"select row, array_to_string(w[i : i + {k - 1}], ' ') as g from (select row, w, unnest(range(1, len(w) - {k - 2})) as i from $)" for k in range(1, ORDERS + 1))
    # crc32 a byte at a time, from the table of its polynomial.
    step = "xor(s >> 8, crc[cast(xor(s & 255, b) as integer) + 1])"
    return rf"""
with recursive bits as (
  select range as n, 0 as k, cast(range as bigint) as v from range(256)
  union all select n, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
crct as materialized (select list(v order by n) as crc from bits where k = 8),
d as materialized ({words("documents", "doc_id")}),
b as materialized ({words("benchmark", "item_id")}),
dg as materialized ({runs.replace("$", "d")}),
bg as materialized ({runs.replace("$", "b")}),
hashed as materialized (
  select g, cast(xor(list_reduce(list_concat([4294967295], list_transform(range(0, octet_length(encode(g))), lambda j: cast(('0x' || substr(hex(encode(g)), cast(2 * j + 1 as bigint), 2)) as bigint))),
                     lambda s, b: {step}), 4294967295) as bigint) % {BUCKETS} as bucket
  from (select g from dg union select g from bg), crct),
s as (select bucket, count(*) as s from dg join hashed using (g) group by bucket),
t as (select bucket, count(*) as t from bg join hashed using (g) group by bucket),
gain as materialized (
  select bucket, cast(floor(1000 * ln((coalesce(t, 0)::double + 1) * ((select count(*) from dg)::double + {BUCKETS}) / ((s::double + 1) * ((select count(*) from bg)::double + {BUCKETS})))) as bigint) as gain
  from s left join t using (bucket)),
weights as (select row, count(*) as n, sum(gain) as weight from dg join hashed using (g) join gain using (bucket) group by row),
scored as (
  select id as doc_id, row, len(w) as n_words, cast(coalesce(n, 0) as bigint) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
         cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((cast(('0x' || substr(sha256('{SEED}:' || coalesce(cast(id as varchar), 'null')), 1, 8)) as bigint)::double + 0.5) / 4294967296.0))) as bigint) as score
  from d left join weights using (row)),
drawn as (select row, row_number() over (order by score desc, doc_id nulls last, row) as rank from scored where n_words >= {LEAST_WORDS})
select doc_id, n_features, weight, score, case when rank <= {PERCENT} * (select count(*) from drawn) // 100 then rank end as rank from scored left join drawn using (row)
"""
