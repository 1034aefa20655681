"""Readers and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.grouping import attach
from ..operators.quality import duplicate_contests
from ..session import path_exists
from .schema import HEADER_SCHEMA, clean_missing, complete, nested_schema, prediction_schema

POLICY_VERSION = 2


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet scan with NaN read as missing and naive timestamps."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return clean_missing(reader.parquet(path))


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A side table that may not exist: then an empty table of the same schema."""
    if path_exists(spark, path):
        have = read_parquet(spark, path)
        typed = {f.name: f.dataType.simpleString() for f in schema.fields}
        return complete(have, typed).select(*schema.names)
    return spark.createDataFrame([], schema)


def read_parts(spark: SparkSession, paths: Sequence[str], keys: Sequence[str] = ("year", "round", "driver")
               ) -> DataFrame:
    """Several files as one table; a key in more than one of them is refused by contest."""
    parts = [read_parquet(spark, p) for p in paths]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    clash = duplicate_contests(whole, keys).limit(20).collect()
    if clash:
        names = ", ".join("/".join(str(v) for v in row) for row in clash)
        raise ValueError(f"the same key appears in more than one input: {names}")
    return whole


def write_table(df: DataFrame, path: str, by: Sequence[str] = ("year",)) -> None:
    """Partitioned parquet; one shuffle so that each partition value is few files."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def archive_forecasts(headers: DataFrame, predictions: DataFrame, path: str) -> None:
    """Write-once archive of JSON records: an existing target is never replaced.

    Predictions lie in one folder per contest. Headers are written last, so an
    archive with headers is whole.
    """
    if path_exists(headers.sparkSession, path):
        raise FileExistsError(f"forecast already archived at {path}")
    predictions.write.mode("errorifexists").partitionBy("year", "round").json(f"{path}/predictions")
    headers.write.mode("errorifexists").json(f"{path}/headers")


def read_forecasts(spark: SparkSession, path: str) -> DataFrame:
    """Archived header records with the name of the file they came from."""
    raw = spark.read.schema(HEADER_SCHEMA).json(f"{path}/headers")
    return raw.select("*", F.col("_metadata.file_name").alias("source_file"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """One row per predicted entry with its header's facts; ids have the type that the headers name."""
    headers = read_forecasts(spark, path)
    types = [r["id_types"] for r in headers.select("id_types").distinct().collect()]  # one row per type an archive mixes
    if len(types) != 1:
        raise ValueError(f"an archive holds one kind of ids, found {len(types)}")
    rows = spark.read.schema(prediction_schema(**types[0].asDict())).json(f"{path}/predictions")
    facts = headers.select("event.year", "event.round", "event.event_name", "created_utc", F.col("grid.status").alias("grid_status"),
                           "bundle.training_cutoff_utc")
    return attach(rows, facts, ["year", "round"], calendar=True)


def read_nested(spark: SparkSession, path: str, driver: str = "bigint", team: str = "int", multi_line: bool = True) -> DataFrame:
    """Records of other writers that nest their predictions, ids of the given types, with their file's name."""
    raw = spark.read.schema(nested_schema(driver, team)).option("multiLine", multi_line).json(path)
    return raw.select("*", F.col("_metadata.file_name").alias("source_file"))


def explode_predictions(forecasts: DataFrame) -> DataFrame:
    """One row per predicted entry of nested records."""
    return forecasts.select(
        F.col("event.year").alias("year"), F.col("event.round").alias("round"),
        F.col("event.event_name").alias("event_name"), "created_utc",
        F.col("grid.status").alias("grid_status"),
        F.col("bundle.training_cutoff_utc").alias("training_cutoff_utc"),
        F.explode("predictions").alias("p")).select(
        "year", "round", "event_name", "created_utc", "grid_status", "training_cutoff_utc", "p.*")


def write_policy(policy: DataFrame, path: str) -> None:
    """Fitted imputation constants as one small JSON row with their version."""
    policy.withColumn("schema_version", F.lit(POLICY_VERSION)).write.mode("errorifexists").json(path)


def read_policy(spark: SparkSession, path: str) -> DataFrame:
    """Fitted constants back; another schema version is refused when the row is used."""
    raw = spark.read.json(path)
    known = F.col("schema_version") == POLICY_VERSION
    return raw.filter(F.coalesce(F.assert_true(known, F.lit("unknown policy version")).isNull(),
                                 F.lit(True))).drop("schema_version")


def write_report(sections: DataFrame, path: str) -> None:
    """A report as JSON lines, nested columns kept."""
    sections.write.mode("overwrite").json(path)
