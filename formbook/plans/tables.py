"""Derived tables that later steps read, written once per session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, folds
from ..operators.labels import derive_labels, relevance
from ..operators.probability import blend, plackett_luce
from ..sources.league import labelled, paced_entries, stored


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table before imputation."""
    return stored(spark, sf_dir, "features", lambda: features.asof_features(paced_entries(spark, sf_dir)))


def training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with labels, grades and the chronological part of each row, before imputation."""
    def build():
        rows = derive_labels(feature_table(spark, sf_dir).drop("result_order"))
        return folds.chronological_split(relevance(rows))
    return stored(spark, sf_dir, "training", build)


def scored_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported predictions: labelled entries with simple scores from prior form."""
    def build():
        rows = features.recent_form(labelled(spark, sf_dir))
        finish = F.coalesce("form_avg_finish_3", F.lit(50.0))
        rows = rows.withColumns({
            "rank_score": -finish, "win_score": F.coalesce("form_avg_points_3", F.lit(0.0)),
            "podium_score": -F.coalesce("season_avg_finish", F.lit(50.0)),
            "p_top10_clf": 1.0 / (1.0 + F.exp(finish / 20.0 - 1.0))})
        return blend(rows, "rank_score", 0.5)
    return stored(spark, sf_dir, "predictions", build)


def probability_table(spark: SparkSession, sf_dir: str, n_draws: int) -> DataFrame:
    """Exported predictions with model and known-order probabilities."""
    def build():
        rows = plackett_luce(scored_entries(spark, sf_dir), "rank_score", 8.0, n_draws)
        order = scored_entries(spark, sf_dir).select("year", "round", "driver", (-F.col("grid_position")).alias("_u"))
        order = plackett_luce(order, "_u", 10.0, n_draws)
        return rows.join(order.select("year", "round", "driver", F.col("p_win").alias("p_win_grid"),
                                      F.col("p_podium").alias("p_podium_grid")), ["year", "round", "driver"])
    return stored(spark, sf_dir, f"probabilities{n_draws}", build)
