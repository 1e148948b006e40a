"""The registered queries of the corpus operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionflow.llm import avi, bpe, extraction, langid, mixing, ngram_join, perplexity, quality, suffixes, warc
from regionflow.llm.common import cut, drop_folder, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(documents, table(spark, sf_dir, "labels"))
    scored = quality.score(documents, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), ngram_join.Rule(3, (90, 100)))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(documents, langid.train(documents))
    return found.select("doc_id", quality.held_out().alias("held_out"), "lang_pred", "score", "n_spans")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder, tops = warc.archive(pages)
    found = cut(warc.look_up(pages, folder, tops))
    drop_folder(spark, folder)  # what was read back is kept, the archives aren't
    return found


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"), extraction.trained())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judge(table(spark, sf_dir, "documents"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.features(avi.write_column(table(spark, sf_dir, "documents")))


def media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timed clips of the media that op5 writes."""
    return avi.clips(avi.write_column(table(spark, sf_dir, "documents")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.stream(mixed).select("doc_id", "size", "source_size", "target", "taken", "passes", "position")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


QUERIES: dict[str, Query] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_language_id": op3_language_id,
    "op5_media_columns": op5_media_columns,
    "op6_mixing": op6_mixing,
    "op4_warc": op4_warc,
    "op7_html_extraction": op7_html_extraction,
    "op8_quality_rules": op8_quality_rules,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "media_clips": media_clips,
}

SQL: dict[str, str] = {}

SQL["op2_ngram_jaccard_join"] = """
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from words),
sizes as (select doc_id, count(s) as n from documents left join shingles using (doc_id) group by 1),
common as (select a.doc_id as a, b.doc_id as b, count(*) as i from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * i >= 90 * (x.n + y.n - i)),
edges as (select a, b from links union select b, a from links),
reach as (select doc_id, doc_id as root from documents union select e.b, r.root from reach r join edges e on e.a = r.doc_id)
select s.doc_id, s.n as n_shingles, min(root) as component_id from sizes s join reach r on r.doc_id = s.doc_id group by all
"""

SQL["op4_warc"] = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as n, sha1(html) as h, max(page_id) over (partition by html) as newest from p)
select page_id, n::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::bigint, 5))::int >> (15 - 5 * (i % 4))::int) & 31), 1)), '') as payload_digest,
  case when page_id = newest then 'response' else 'revisit' end as record_type, case when page_id <> newest then newest end as refers_to
from d
"""

SQL["op9_suffix_array_dedup"] = """
with b as (select doc_id, coalesce(text, '') as t, hex(coalesce(text, '')) as x, strlen(coalesce(text, ''))::bigint as n from documents),
windows as (select doc_id, i, hash(substr(x, 2 * i + 1, 400)) as h from b, unnest(range(n - 199)) as u(i) where n >= 200),
twice as (select h from windows group by 1 having count(*) > 1),
marked as (select doc_id, i from windows semi join twice using (h)),
starts as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 200 then 0 else 1 end as fresh from marked),
runs as (select doc_id, min(i) as a, max(i) + 200 as e from (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as r from starts) group by doc_id, r),
gaps as (
  select doc_id, a, e, coalesce(lag(e) over (partition by doc_id order by a), 0) as before from runs
  union all select r.doc_id, b.n, b.n, max(e) from runs r join b using (doc_id) group by r.doc_id, b.n),
kept as (select doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' order by before) as k from gaps join b using (doc_id) group by 1),
total as (select doc_id, sum(e - a)::bigint as gone, count(*) as many from runs group by 1)
select doc_id, n as n_bytes, coalesce(gone, 0) as n_removed, coalesce(many, 0) as n_spans, sha256(unhex(coalesce(k, x))) as kept_sha256
from b left join total using (doc_id) left join kept using (doc_id)
"""
