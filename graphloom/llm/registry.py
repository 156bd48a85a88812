"""Queries of the training-data operators over their whole tables, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import bpe, counts, decontaminate, langid, lines, simhash, substring, tokens, topk, urls
from graphloom.session import prepare, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    model = langid.fit(docs.where("lang is not null and not coalesce(held_out, false)"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_to_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


OP3_SQL = """
with rules(verdict, host, path) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
u as (
  select page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
m as (
  select u.page_id, u.host, u.path, r.host || r.path as rule, r.verdict,
    row_number() over (partition by u.page_id order by length(r.host || r.path) desc nulls last) as k
  from u left join rules r on (u.host = r.host or u.host like '%.' || r.host) and starts_with(u.path, r.path))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from m where k = 1
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.deduplicate_substrings(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantize(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("id % 20 = 0"), 20)


OP5_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", F.round("similarity", 6))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    done = lines.deduplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), n_lines="n_lines", n_removed="n_removed")
    return done.select("doc_id", F.col("n_lines").cast("long"), F.col("n_removed").cast("long"), F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


OP10_SQL = """
with doc as (select doc_id, string_split(text, chr(10)) as line from documents where text is not null),
one as (select doc_id, len(line) as n, unnest(line) as s, generate_subscripts(line, 1) - 1 as pos from doc),
win as (
  select doc_id, pos, s || chr(10) || lead(s, 1) over w || chr(10) || lead(s, 2) over w as t
  from one window w as (partition by doc_id order by pos)),
ranked as (select doc_id, pos, row_number() over (partition by t order by doc_id, pos) as k from win where t is not null),
gone as (select distinct doc_id, pos + d as pos from ranked, (values (0), (1), (2)) v(d) where k > 1),
kept as (
  select o.doc_id, count(*) as n_lines, count(g.pos) as n_removed,
         coalesce(string_agg(case when g.pos is null then o.s end, chr(10) order by o.pos), '') as t
  from one o left join gone g on o.doc_id = g.doc_id and o.pos = g.pos group by o.doc_id)
select d.doc_id, coalesce(k.n_lines, 0)::bigint as n_lines, coalesce(k.n_removed, 0)::bigint as n_removed,
       md5(coalesce(k.t, '')) as kept_md5
from documents d left join kept k on d.doc_id = k.doc_id
"""


OPERATORS = (
    op1_language_id,
    op2_token_shards,
    op3_url_filter,
    op4_substring_dedup,
    op5_exact_top_k,
    op6_byte_bpe,
    op7_token_counts,
    op8_simhash,
    op9_decontamination,
    op10_line_dedup,
)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": OP3_SQL, "op5_exact_top_k": OP5_SQL, "op10_line_dedup": OP10_SQL}
