"""The registered queries of the llm operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table_parts
from .dac import store_tokens
from .decontaminate import contamination
from .html_text import extract_text
from .kneser_ney import train
from .ogg import media_features, store_texts
from .packing import pack_documents
from .parity_join import near_duplicates
from .preference import ORACLE as PREFERENCE_SQL
from .preference import conversation_pairs, render_pairs
from .token_counts import token_counts
from .warc import archive_round_trip

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table_parts(spark, sf_dir, "documents"), WORD_BPE, capacity=4096, end_id=1)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train(table_parts(spark, sf_dir, "documents"), table_parts(spark, sf_dir, "labels")).verdicts()


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the archives read back, with their places in the merged index."""
    return archive_round_trip(table_parts(spark, sf_dir, "pages"))


def op4_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_pairs(conversation_pairs(table_parts(spark, sf_dir, "conversations")), "conv_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table_parts(spark, sf_dir, "documents"), table_parts(spark, sf_dir, "benchmark"))


def op6_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(store_texts(table_parts(spark, sf_dir, "documents")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table_parts(spark, sf_dir, "documents"), PIECE_BPE, limit=4096)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_tokens(table_parts(spark, sf_dir, "documents"), WORD_BPE, end_id=1)


def op9_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table_parts(spark, sf_dir, "documents"), percent=75)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table_parts(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_warc": op3_warc,
    "op4_preference_format": op4_preference_format,
    "op5_decontamination": op5_decontamination,
    "op6_ogg_media": op6_ogg_media,
    "op7_token_counts": op7_token_counts,
    "op8_token_files": op8_token_files,
    "op9_parity_join": op9_parity_join,
    "op10_html_text": op10_html_text,
}

WARC_SQL = r"""
with p as (select page_id, url, coalesce(html, '') as html, sha1(coalesce(html, '')) as digest, strlen(coalesce(html, '')) as size from pages),
kept as (select digest, max(page_id) as keep from p where size >= 1000 group by digest),
placed as (select p.*, case when size >= 1000 and p.page_id < keep then keep end as refers_to from p left join kept using (digest)),
parts as (
  select *, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www[0-9]*\.', '') as host,
    regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) as query from placed),
keyed as (
  select *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || case when path = '' then '/' else path end
    || case when query = '' then '' else '?' || array_to_string(list_sort(string_split(query, '&')), '&') end as url_key,
    strftime(timestamp '2020-01-01' + to_seconds(page_id % 1000000000), '%Y%m%d%H%M%S') as captured from parts)
select page_id, size as payload_bytes, digest as payload_digest, case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to,
  url_key, captured, row_number() over (order by url_key, captured, page_id) - 1 as index_place from keyed
"""

JACCARD_SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
lists as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) end as l from words),
sizes as (select doc_id, cast(len(l) as bigint) as n from lists),
sets as (select doc_id, unnest(l) as s from lists),
shared as (select a.doc_id as u, b.doc_id as v, count(*) as k from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select u, v from shared join sizes x on x.doc_id = u join sizes y on y.doc_id = v where 100 * k >= 75 * (x.n + y.n - k)),
ways as (select u, v from links union all select v, u from links),
reach as (select doc_id as a, doc_id as b from sizes union select reach.a, ways.v from reach join ways on reach.b = ways.u)
select a as doc_id, n as n_shingles, min(b) as component_id from reach join sizes on doc_id = a group by a, n
"""

ORACLES: dict[str, str] = {
    "op3_warc": WARC_SQL,
    "op4_preference_format": PREFERENCE_SQL,
    "op9_parity_join": JACCARD_SQL,
}
