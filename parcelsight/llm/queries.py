"""The registered queries of this folder, with their oracle texts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelsight.llm import (
    filter_audit, fingerprints, language, minhash, mixing, packing, quality_classifier, quality_rules, resampling,
    sharding, simhash, substrings, toxicity,
)
from parcelsight.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(documents(spark, sf_dir))


@query
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(documents(spark, sf_dir))
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size",
                        F.round("target", 6).alias("target"), "taken")


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_records(documents(spark, sf_dir), [1.0] * 16)


@query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_text(F.col("fp")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(documents(spark, sf_dir))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_digests(documents(spark, sf_dir))


def pack_digests(docs: DataFrame) -> DataFrame:
    """Packed pieces with a checksum in place of their ids."""
    def digest(pieces: DataFrame) -> DataFrame:
        return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), digest=digest)


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed",
                        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                        "nearest", "word_distance", "char_distance")


@query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = quality_classifier.page_sites(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return quality_classifier.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), sites)


# crc32 is worked out byte by byte: a table of 256 values, then one step per byte of the feature
RESAMPLING_SQL = r"""
with recursive bits as (
  select i, i::bigint as v, 0 as step from range(256) t(i)
  union all select i, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end, step + 1 from bits where step < 8
), crc as (select list(v order by i) as t from bits where step = 8
), texts as (
  select 'd' as kind, doc_id, row_number() over () as row_no, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
  union all select 'b', item_id, row_number() over (), translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark
), words as (
  select kind, doc_id, row_no, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts
), feats as (
  select kind, row_no, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from words
), uses as (select kind, row_no, f, count(*) as n from feats group by all
), kinds as (
  select f, xor(list_reduce(
    list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), (2 * i + 1)::int, 2))::bigint),
    lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8), 4294967295), 4294967295) % 10000 as bucket
  from (select distinct f from uses), crc
), placed as (select kind, row_no, bucket, n from uses join kinds using (f)
), seen as (
  select b.bucket, coalesce(sum(n) filter (kind = 'd'), 0)::double as s, coalesce(sum(n) filter (kind = 'b'), 0)::double as t
  from range(10000) b(bucket) left join placed p on p.bucket = b.bucket group by b.bucket
), gains as (
  select bucket, floor(1000 * ln((t + 1) * (sum(s) over () + 10000) / ((s + 1) * (sum(t) over () + 10000))))::bigint as gain from seen
), sums as (
  select row_no, sum(n) as n, floor(sum(n * gain)::double / sum(n))::bigint as weight
  from placed join gains using (bucket) where kind = 'd' group by row_no
), scored as (
  select w.doc_id, w.row_no, coalesce(s.n, 0)::bigint as n_features, coalesce(s.weight, 0) as weight, len(w.w) >= 20 as fit,
    coalesce(s.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from words w left join sums s using (row_no) where w.kind = 'd'
), places as (
  select *, row_number() over (partition by fit order by score desc, doc_id) as place, count(*) filter (fit) over () as fits from scored
)
select doc_id, n_features, weight, score, case when fit and place <= 25 * fits // 100 then place end as rank from places"""


@query
def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


ORACLES["op12_target_resampling"] = RESAMPLING_SQL


MINHASH_SQL = r"""
with recursive words as (
  select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingles as (
  select r, unnest(list_distinct(case when len(w) >= 3
    then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s from words
), sizes as (select r, count(*) as n from shingles group by r
), common as (
  select a.r as a, b.r as b, count(*) as c from shingles a join shingles b on a.s = b.s and a.r < b.r group by all
), links as (
  select a, b from common join sizes x on x.r = a join sizes y on y.r = b where 100 * c >= 85 * (x.n + y.n - c)
), ways as (select a, b from links union all select b, a from links
), reach as (
  select r as a, r as b from words union select reach.a, ways.b from reach join ways on reach.b = ways.a
), least as (select reach.a as r, min(words.doc_id) as component_id from reach join words on reach.b = words.r group by 1)
select w.doc_id, coalesce(s.n, 0)::bigint as n_shingles, component_id, w.doc_id = component_id as kept
from words w join least using (r) left join sizes s using (r)"""


@query
def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), "kept")


ORACLES["op13_minhash_near_dedup"] = MINHASH_SQL


AUDIT_SQL = r"""
with texts as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents
), words as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by t) as least from texts
), lab as (
  select doc_id, max((coalesce(quality, 0) = 1)::int) as good, max((coalesce(toxic, 0) = 1)::int) as toxic from labels group by doc_id
), masks as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int
    + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int
    + 16 * (words.doc_id > least)::int as mask
  from words left join lab on words.doc_id = lab.doc_id
), cells as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from masks group by all
), letters as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, b)
), orders as (
  select a.l || b.l || c.l || d.l || e.l as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits
  from letters a, letters b, letters c, letters d, letters e where a.b | b.b | c.b | d.b | e.b = 31
), steps as (
  select filter_order, step::int as step, bits[step] as own, coalesce(list_sum(bits[1:step - 1]), 0)::int as before
  from orders, range(1, 6) s(step)
)
select part, filter_order, step, coalesce(sum(n) filter (mask & (before | own) = 0), 0)::bigint as kept,
  coalesce(sum(n) filter (mask & own <> 0 and mask & before = 0), 0)::bigint as removed,
  coalesce(sum(n) filter (mask & own <> 0 and mask & before <> 0), 0)::bigint as redundant,
  coalesce(sum(n) filter (mask = own), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (mask & own <> 0 and mask & before = 0), 0)::bigint as good_lost,
  coalesce(sum(toxic) filter (mask & own <> 0 and mask & before = 0), 0)::bigint as toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) filter (mask & own <> 0), 0)::bigint as shapley
from steps, cells group by part, filter_order, step"""


@query
def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = filter_audit.stream_files(spark, f"{sf_dir}/documents.parquet")
    rows = documents(spark, sf_dir).count()
    return filter_audit.audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), buckets=filter_audit.buckets_of(rows))


ORACLES["op11_filter_interaction_audit"] = AUDIT_SQL
