"""The operators applied to their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framelake.llm import bpe, exact_dedup, fixed_blocks, flac, hard_negatives, hyperminhash, licenses, mixing, nbsvm, resampling, token_counts, url_filters, warc
from framelake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL["op6_exact_dedup"] = """
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256
from (select doc_id, coalesce(text, '') as t, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
             count(*) over (partition by coalesce(text, '')) as group_size
      from documents)
"""


@_query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


ORACLE_SQL["op8_mixing"] = r"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         md5(concat('mix-1:', coalesce(cast(doc_id as varchar), 'null'))) as key
  from documents),
totals as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
ranked as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight,
                  row_number() over (order by source nulls last) as rank from totals),
capped as (select *, 3 * source_size as cap, cast(3 * source_size as double) / weight as ratio from ranked),
levels as (select *, cast((sum(source_size) over ()) - coalesce(sum(cap) over (order by ratio, rank rows between unbounded preceding and 1 preceding), 0) as double)
                     / (sum(weight) over (order by ratio, rank rows between current row and unbounded following)) as level from capped),
water as (select arg_min(level, rank_in_order) as water_level
          from (select level, ratio, row_number() over (order by ratio, rank) as rank_in_order from levels) where level <= ratio),
targets as (select source, source_size, least(cast(cap as double), water_level * weight) as target from capped, water),
placed as (select s.doc_id, s.source, s.size, t.source_size, t.target,
                  coalesce(sum(s.size) over (partition by s.source order by s.key, s.doc_id rows between unbounded preceding and 1 preceding), 0) as before,
                  case when t.source_size > 0 then cast(floor(t.target) as bigint) // t.source_size else 0 end as whole
           from sized s join targets t on s.source is not distinct from t.source)
select doc_id, source, size, source_size, target,
       cast(whole * size + greatest(0, least(size, cast(floor(target) as bigint) - whole * source_size - before)) as bigint) as taken
from placed
"""


def tokenizer_path() -> str:
    """The vocabulary file of op7; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path()))


@_query
def op1_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digest(table(spark, sf_dir, "documents"))


@_query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_dedup(table(spark, sf_dir, "documents"))


@_query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_blocks.digest(table(spark, sf_dir, "documents"))


@_query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


@_query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.digest(table(spark, sf_dir, "documents"), tokenizer_path())


ORACLE_SQL["op5_near_dedup"] = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (select distinct doc_id, array_to_string(words[i : i + 4], ' ') as g from (select doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) as i from w where len(words) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select a as doc_id, a as other from e union select r.doc_id, e.b from r join e on e.a = r.other),
m as (select doc_id, min(other) as component_id from r group by doc_id),
classes as (select doc_id, min(doc_id) over (partition by (select string_agg(g, chr(10) order by g) from s where s.doc_id = w.doc_id)) as first_id from w)
select w.doc_id, coalesce(n.n, 0) as n_shingles, case when n.n is null then w.doc_id else c.first_id end as class_id, coalesce(m.component_id, w.doc_id) as component_id,
       coalesce(m.component_id, w.doc_id) = w.doc_id as kept
from w left join n using (doc_id) left join m using (doc_id) join classes c using (doc_id)
"""

ORACLE_SQL["op10_substring_dedup"] = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
win as (select doc_id, i, array_to_string(words[i : i + 49], ' ') as g from (select doc_id, words, unnest(range(1, len(words) - 48)) as i from w where len(words) >= 50)),
first as (select g, min(doc_id) as d from win group by g),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as k from win join first using (g) where d < doc_id),
kept as (select x.doc_id, string_agg(word, ' ' order by k) as t, count(*) as n from (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as k from w) x anti join gone using (doc_id, k) group by x.doc_id)
select w.doc_id, len(words) as n_words, len(words) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept using (doc_id)
"""


ORACLE_SQL["op4_warc"] = """
with p as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as h, max(page_id) over (partition by coalesce(html, '')) as top from pages),
-- Base32: every five hex digits are twenty bits, and so four letters.
b as (select *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        cast((cast(('0x' || substr(h, cast(5 * (i // 4) + 1 as bigint), 5)) as bigint) >> (15 - 5 * (i % 4))) & 31 as bigint) + 1, 1)), '') as digest from p)
select page_id, n as payload_bytes, digest as payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to from b
"""


def _license_sql() -> str:
    """The rules of op9 with the templates and phrases in place."""
    listed = lambda text: "['" + "', '".join(text.split()) + "']"
    phrases = ", ".join(f"({listed(t)}, '{label}')" for t, label in licenses.PHRASES)
    templates = ", ".join(f"({listed(t)}, '{label}')" for t, label in licenses.TEMPLATES)
    return rf"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
phrases as (select * from (values {phrases}) v(phrase, label)),
templates as (select list_distinct(t) as t, len(t) as raw, label from (values {templates}) v(t, label)),
places as (select doc_id, i - 1 as start, label from (select doc_id, words, unnest(generate_series(1, len(words))) as i from w), phrases where words[i : i + len(phrase) - 1] = phrase),
base as (select doc_id, count(*) as n, min(start) as first_word, max(start) as last_word, list(label) as labels from places group by doc_id),
-- The best block of a template starts at one of its words: another holds no more of them than the one that starts at its first.
words_of as (select tid, label, n, unnest(t) as word from (select row_number() over () as tid, label, t, greatest({licenses.BLOCK}, 2 * raw) as n from templates)),
needs as (select tid, count(*) as size, any_value(n) as reach, any_value(label) as label from words_of group by tid),
held as (select doc_id, tid, word, i, i // n as cell, n from (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as i from w) join words_of using (word)),
pairs as (select a.doc_id, a.tid, a.i, count(distinct b.word) as c from (select *, unnest([cell, cell + 1]) as near from held) a join held b on a.doc_id = b.doc_id and a.tid = b.tid and a.near = b.cell and b.i >= a.i and b.i < a.i + a.n group by all),
met as (select doc_id, label, max(c) / size as share from pairs join needs using (tid) group by doc_id, tid, label, size having max(c) >= ceil({licenses.THRESHOLD} * size - 1e-9)),
own as (select doc_id, list(label) as labels, max(share) as share from met group by doc_id)
select w.doc_id, len(words) as n_words, coalesce(n, 0) as n_base, first_word, last_word, coalesce(array_to_string(list_sort(list_distinct(base.labels)), ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ','), '') as labels,
       case when n > 0 then 1.0::double else coalesce(share, 0.0::double) end as score
from w left join base using (doc_id) left join own using (doc_id)
"""


ORACLE_SQL["op9_licenses"] = _license_sql()


@_query
def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged(table(spark, sf_dir, "pages"))


ORACLE_SQL["op11_url_filters"] = url_filters.oracle()


@_query
def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op12_resampling"] = resampling.oracle()


@_query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"))


ORACLE_SQL["op13_hard_negatives"] = hard_negatives.oracle()
