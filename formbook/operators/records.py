"""Forecast records: nesting, scoring against later results, boards and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import CONTEST
from ..functions import vocab
from ..functions.expr import flag
from ..functions.text import display_name, event_id, finish_label, percent, place_delta
from .grouping import attach, top_k
from .metrics import spearman

K = list(CONTEST)

PREDICTED = ("pred_finish_rank", "driver", "team", "grid_position", "qualifying_position", "pit_start", "p_win", "p_podium", "p_top10")


def split_record(rows: DataFrame, header: dict[str, Column], contest: Sequence[str] = CONTEST) -> tuple[DataFrame, DataFrame]:
    """Flat forecast rows as one header record per contest and a flat predictions table keyed by contest.

    `rows` needs the contest keys, date, event_name, created_utc, grid_status and
    the prediction columns; `header` supplies source, training_cutoff_utc,
    temperature and alpha. A header holds aggregates only, so the size of a field
    never matters; ids keep the caller's type, which the header names.
    """
    types = dict(rows.dtypes)
    per = rows.groupBy(*contest).agg(
        F.count(F.lit(1)).alias("_size"), F.count(F.when(F.col("pit_start") == 1, 1)).cast("int").alias("_pits"),
        *[F.max(c).alias(c) for c in ("event_name", "date", "created_utc", "grid_status")])
    headers = per.select(
        F.struct(*contest, "event_name", "date").alias("event"), "created_utc",
        F.struct(F.col("grid_status").alias("status"), header["source"].alias("source"),
                 F.col("created_utc").cast("string").alias("cutoff_utc"), F.col("_size").alias("field_size"),
                 F.col("_pits").alias("n_pit_starts"), F.array().cast("array<string>").alias("notes")).alias("grid"),
        F.struct(header["training_cutoff_utc"].cast("string").alias("training_cutoff_utc"),
                 header["temperature"].cast("double").alias("temperature"),
                 header["alpha"].cast("double").alias("alpha")).alias("bundle"),
        F.struct(*[F.lit(types[c]).alias(c) for c in ("driver", "team")]).alias("id_types"))
    if "qualifying_position" not in rows.columns:
        rows = rows.withColumn("qualifying_position", F.lit(None).cast("double"))
    return headers, rows.select(*contest, *PREDICTED)


def match_results(predictions: DataFrame, results: DataFrame, contest: Sequence[str] = CONTEST) -> DataFrame:
    """Predictions with the result of the same entity, NULL where none matches."""
    keys = [*contest, "driver"]
    return predictions.join(
        results.select(*keys, "result_order", "is_winner", "is_podium", "finished_top10"), keys, "left")


def unmatched_counts(predictions: DataFrame, results: DataFrame, contest: Sequence[str] = CONTEST) -> DataFrame:
    return match_results(predictions, results, contest).groupBy(*contest).agg(
        F.count(F.lit(1)).alias("n_predictions"),
        F.count(F.when(F.col("result_order").isNull(), 1)).alias("n_unmatched"))


def score(predictions: DataFrame, results: DataFrame, contest: Sequence[str] = CONTEST) -> DataFrame:
    """One row per forecast contest whose result (with a winner) has arrived."""
    keys = list(contest)
    won = results.groupBy(*keys).agg(F.max("is_winner").alias("_w")).filter(F.col("_w") == 1).select(*keys)
    merged = match_results(predictions, results, contest).join(F.broadcast(won), keys, "left_semi")
    hit = lambda rank, k, c: F.count(F.when((F.col(rank) <= k) & (F.col(c) == 1), 1))
    by_grid = top_k(merged, keys, [("grid_position", "asc"), ("driver", "asc")], 3, "_g").groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("_g") == 1, F.col("is_winner"))), F.lit(0)).alias("grid_winner_hit"),
        (hit("_g", 3, "is_podium") / F.lit(3.0)).alias("grid_podium_overlap"))
    gap = F.col("p_podium") - F.coalesce("is_podium", F.lit(0))
    p_winner = F.coalesce(F.max(F.when(F.col("is_winner") == 1, F.col("p_win"))), F.lit(0.0))
    base = merged.groupBy(*keys).agg(
        F.max("event_name").alias("event_name"), F.max("grid_status").alias("grid_status"),
        F.count(F.when(F.col("result_order").isNull(), 1)).alias("drivers_unmatched"),
        F.coalesce(F.max(F.when(F.col("pred_finish_rank") == 1, F.col("is_winner"))), F.lit(0)).alias("winner_hit"),
        (hit("pred_finish_rank", 3, "is_podium") / F.lit(3.0)).alias("podium_overlap"),
        (hit("pred_finish_rank", 10, "finished_top10") / F.lit(10.0)).alias("top10_overlap"),
        (-F.ln(F.greatest(p_winner, F.lit(vocab.PROBABILITY_FLOOR)))).alias("winner_log_loss"),
        F.ln(F.count(F.lit(1)).cast("double")).alias("uniform_log_loss"),
        F.avg(gap * gap).alias("podium_brier"))
    rho = spearman(merged, keys, "pred_finish_rank", "result_order", "spearman")
    return (base.join(by_grid, keys).join(rho, keys, "left").withColumn("event", event_id()))


def pending(predictions: DataFrame, results: DataFrame, contest: Sequence[str] = CONTEST) -> DataFrame:
    """Forecast contests whose result has not arrived or names no winner."""
    won = results.filter(F.col("is_winner") == 1).select(*contest).distinct()
    return predictions.select(*contest).distinct().join(won, list(contest), "left_anti")


def summarise(scored: DataFrame, late: DataFrame | None = None, contest: Sequence[str] = CONTEST) -> DataFrame:
    """Means over scored forecasts; forecasts listed in `late` are left out."""
    if late is not None:
        scored = scored.join(F.broadcast(late.select(*contest).distinct()), list(contest), "left_anti")
    return scored.agg(
        F.count(F.lit(1)).alias("n_contests"), F.avg("winner_hit").alias("winner_accuracy"),
        F.avg("grid_winner_hit").alias("grid_winner_accuracy"),
        *[F.avg(c).alias(c) for c in ("podium_overlap", "grid_podium_overlap", "top10_overlap",
                                      "winner_log_loss", "uniform_log_loss", "podium_brier", "spearman")])


def late_flags(forecasts: DataFrame, schedule: DataFrame, start="start_utc",
               contest: Sequence[str] = CONTEST) -> DataFrame:
    """Whether a forecast was created after the scheduled start of its contest."""
    one = forecasts.select(*contest, "created_utc").distinct()
    joined = attach(one, schedule.select(*contest, start), contest, calendar=True)
    late = F.coalesce(F.col("created_utc") > F.col(start), F.lit(False))
    return joined.withColumn("is_late", late)


def season_board(predictions: DataFrame, results: DataFrame, contest: Sequence[str] = CONTEST) -> DataFrame:
    """Pick, winner and hit counts per contest; only numeric classifications count."""
    keys = list(contest)
    official = results.filter(F.col("classified_position_raw").rlike(r"^\d+$"))
    finish = top_k(official.select(*keys, "driver", "result_order"), keys,
                   [("result_order", "asc"), ("driver", "asc")], 10, "_f")
    merged = predictions.select(*keys, "driver", "pred_finish_rank", "grid_position").join(
        finish.select(*keys, "driver", "_f"), [*keys, "driver"], "left")
    grid = top_k(merged, keys, [("grid_position", "asc"), ("driver", "asc")], 10, "_g")
    both = lambda rank, k: F.count(F.when((F.col(rank) <= k) & (F.col("_f") <= k), 1))
    model = merged.groupBy(*keys).agg(
        F.max(F.when(F.col("pred_finish_rank") == 1, F.col("driver"))).alias("pick"),
        flag(F.max(F.when((F.col("pred_finish_rank") == 1) & (F.col("_f") == 1), 1)) == 1).alias("model_win"),
        both("pred_finish_rank", 3).alias("model_podium"), both("pred_finish_rank", 10).alias("model_top10"))
    order = grid.groupBy(*keys).agg(
        flag(F.max(F.when((F.col("_g") == 1) & (F.col("_f") == 1), 1)) == 1).alias("grid_win"),
        both("_g", 3).alias("grid_podium"), both("_g", 10).alias("grid_top10"))
    winner = finish.filter(F.col("_f") == 1).select(*keys, F.col("driver").alias("winner"))
    return model.join(order, keys).join(winner, keys)


def board_totals(board: DataFrame) -> DataFrame:
    """Season totals and the grand total."""
    sums = [F.sum(c).cast("bigint").alias(c) for c in
            ("model_win", "grid_win", "model_podium", "grid_podium", "model_top10", "grid_top10")]
    return (board.rollup("year").agg(F.count(F.lit(1)).alias("n_contests"), *sums)
            .withColumn("year", F.coalesce(F.col("year").cast("string"), F.lit("total"))))


def prediction_table(predictions: DataFrame) -> DataFrame:
    """Display rows of a forecast."""
    return predictions.select(
        *K, "pred_finish_rank", "driver", display_name(F.col("team").cast("string")).alias("team"),
        F.concat(F.lit("P"), F.col("grid_position").cast("int").cast("string")).alias("grid"),
        percent("p_win").alias("win"), percent("p_podium").alias("podium"), percent("p_top10").alias("top10"))


def result_table(predictions: DataFrame, results: DataFrame) -> DataFrame:
    """Display rows of a result next to what was predicted."""
    want = predictions.select(*K, "driver", "pred_finish_rank")
    both = results.join(want, [*K, "driver"], "left").withColumn("pos", finish_label("classified_position_raw"))
    grid = (F.when(F.col("pit_start") == 1, "Pit")
            .when(F.col("grid_position").isNotNull(),
                  F.concat(F.lit("P"), F.col("grid_position").cast("int").cast("string"))).otherwise("—"))
    predicted = F.coalesce(F.concat(F.lit("P"), F.col("pred_finish_rank").cast("string")), F.lit("—"))
    return both.select(*K, "driver", "pos", grid.alias("grid"), predicted.alias("predicted"),
                       place_delta("pred_finish_rank", "pos").alias("delta"))
