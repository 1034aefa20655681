"""Registered queries: exact and near duplicates, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import content_sort, simhash, token_frames
from .common import query, table


@query("op4_content_sort", r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from n""")
def op4_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.duplicate_groups(table(spark, sf_dir, "documents"))


@query("op5_simhash_mih")
def op5_simhash_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


@query("op6_token_frames")
def op6_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_frames.token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
