"""The corpus pipeline: toxic texts, exact copies, near copies and benchmark passages go; the rest is encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from formbook.llm import content_sort, piece_lattice, simhash, string_tiling, toxicity
from formbook.llm.common import table
from formbook.session import materialise

MODEL = "piece_bpe_32k.model"


def toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted toxic go."""
    return toxicity.clean_rows(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal normalised texts the row with the smallest doc_id stays."""
    return content_sort.first_of_each(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays."""
    return simhash.one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold half of a benchmark item's tokens or more go."""
    return string_tiling.contaminated(docs, table(spark, sf_dir, "benchmark"), keep=True)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's best segmentation as ids, with the scores of the n best."""
    return piece_lattice.encode_documents(docs, public_tokenizers.path(MODEL), ids="best")


STAGES = [("toxicity", toxic_texts), ("exact dedup", exact_copies), ("SimHash near-dedup", near_copies),
          ("benchmark decontamination", benchmark_passages), ("SentencePiece encoding", piece_ids)]

# The string kernel, the fingerprints and the piece lattice cannot be stated in SQL: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
