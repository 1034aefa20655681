"""Chronological splits and folds as a long table: fold, contest, role."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import CONTEST
from ..functions.expr import col
from ..functions.text import event_id
from .grouping import with_row

TRAIN, VAL, TEST = "train", "val", "test"
K = list(CONTEST)


def contests(df: DataFrame) -> DataFrame:
    """One row per contest with its date and number of rows."""
    return df.groupBy(*K).agg(F.min("date").alias("date"), F.count(F.lit(1)).alias("n_rows"))


def split_label(year, latest) -> Column:
    """test is the latest year, val the one before, train everything earlier."""
    return (F.when(col(year) == col(latest), TEST).when(col(year) == col(latest) - 1, VAL)
            .when(col(year) <= col(latest) - 2, TRAIN))


def chronological_split(df: DataFrame) -> DataFrame:
    """`partition` per row. An empty part is an error when the label is read."""
    years = df.groupBy("year").agg(F.count(F.lit(1)).alias("_n"))
    latest = years.agg(F.max("year").alias("_latest"))
    parts = with_row(years, latest).agg(
        F.max("_latest").alias("_latest"),
        F.count_distinct(split_label("year", "_latest")).alias("_parts"))
    label = F.when(F.col("_parts") == 3, split_label("year", "_latest")).otherwise(
        F.raise_error(F.lit("chronological split needs three parts of data")).cast("string"))
    return (with_row(df, parts).withColumn("partition", label).drop("_latest", "_parts"))


def season_folds(df: DataFrame, min_train: int = 2, train_from: int | None = None) -> DataFrame:
    """One fold per held-out year; validation is the year before, training all earlier ones."""
    table = contests(df)
    # The year list is calendar-sized; its ordinal needs no partitioning.
    years = (table.select("year").distinct()
             .withColumn("_i", F.row_number().over(Window.orderBy("year")) - 1))
    held = years.filter(F.col("_i") >= min_train + 1).select(
        F.col("year").alias("_test"), F.col("_i").alias("_ti"))
    roles = held.join(years, F.col("_i") <= F.col("_ti"))
    role = (F.when(F.col("_i") == F.col("_ti"), TEST).when(F.col("_i") == F.col("_ti") - 1, VAL)
            .otherwise(TRAIN))
    roles = roles.select(F.concat(F.lit("season-"), F.col("_test").cast("string")).alias("fold"),
                         "year", role.alias("role"))
    if train_from is not None:
        roles = roles.filter((F.col("role") != TRAIN) | (F.col("year") >= train_from))
    enough = (roles.filter(F.col("role") == TRAIN).groupBy("fold")
              .agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_train).select("fold"))
    return roles.join(enough, "fold", "left_semi").join(table, "year").select("fold", "role", *K, "date")


def rolling_folds(df: DataFrame, min_train: int = 44, val: int = 12, block: int = 6) -> DataFrame:
    """Expanding training, a validation window, then a block of test contests (last may be short)."""
    ordered = contests(df).withColumn("_i", F.row_number().over(Window.orderBy("date", *K)) - 1)
    start = min_train + val
    starts = ordered.agg(F.max("_i").alias("_last")).filter(F.col("_last") >= start).select(
        F.explode(F.sequence(F.lit(start), F.col("_last"), F.lit(block))).alias("_start"))
    name = F.format_string("block-%02d", ((F.col("_start") - start) / block + 1).cast("int"))
    role = (F.when(F.col("_i") >= F.col("_start"), TEST)
            .when(F.col("_i") >= F.col("_start") - val, VAL).otherwise(TRAIN))
    return (ordered.join(starts, F.col("_i") < F.col("_start") + block)
            .select(name.alias("fold"), role.alias("role"), *K, "date"))


def manifest(folds: DataFrame) -> DataFrame:
    """Per fold and role: number of contests, date range and sorted event ids (joined by commas), and a sha256 over
    these lists. A list has one short id per contest of the calendar."""
    listed = F.array_join(F.array_sort(F.collect_list(event_id())), ",")
    per = folds.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"),
        listed.alias("events"))
    def of(role, c):
        return F.max(F.when(F.col("role") == role, F.col(c)))
    text = F.concat_ws("|", *[F.concat(F.lit(f"{r}:"), F.coalesce(of(r, "events"), F.lit("")))
                              for r in (TEST, TRAIN, VAL)])
    cols = [of(r, c).alias(f"{r}_{c}") for r in (TRAIN, VAL, TEST) for c in ("n", "first", "last", "events")]
    return per.groupBy("fold").agg(*cols, F.sha2(text, 256).alias("sha256"))


def overlaps(folds: DataFrame, key: Sequence[str] = CONTEST) -> DataFrame:
    """Contests that hold more than one role in the same fold."""
    return (folds.groupBy("fold", *key).agg(F.count_distinct("role").alias("n_roles"))
            .filter(F.col("n_roles") > 1))


def rows_of(df: DataFrame, folds: DataFrame, role: str, fold: str | None = None) -> DataFrame:
    """Rows of a role; with several folds a row appears once per fold it belongs to."""
    picked = folds.filter(F.col("role") == role)
    if fold is not None:
        return df.join(F.broadcast(picked.filter(F.col("fold") == fold).select(*K)), K, "left_semi")
    # Calendar-sized: folds x contests.
    return df.join(F.broadcast(picked.select("fold", *K)), K)
