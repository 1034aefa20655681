"""Registered queries: collocations, chat formatting, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, collocations, zone_clusters
from .common import query, table


@query("op11_phrase_summaries", collocations.oracle())
def op11_phrase_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op12_prefix_targets", chat_format.oracle())
def op12_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said))
    return chat_format.digest(chat_format.examples(turns.union(more)))


@query("op13_hilbert_zones", zone_clusters.oracle())
def op13_hilbert_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_clusters.clusters(table(spark, sf_dir, "embeddings"))
