"""Registered queries: decontamination, piece lattice, licences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import license_scan, piece_lattice, string_tiling
from .common import query, table


@query("op7_piece_lattice")
def op7_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_lattice.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op8_string_tiling")
def op8_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_license_dice", license_scan.oracle())
def op9_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))
