"""Registered queries: toxicity and repeated byte strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bwt_repeats, toxicity
from .common import query, table


@query("op2_bwt_repeats")
def op2_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_repeats.removed(table(spark, sf_dir, "documents"))


@query("op3_string_kernel")
def op3_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "unit")
