"""Fitted imputation: constants from training rows, replayed unchanged later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import col
from .grouping import with_row

# Column groups of the fill chain (fixed values).
POSITION_SCALED = ("form_avg_finish_3", "form_avg_quali_3", "season_avg_finish",
                   "driver_circuit_avg_finish", "driver_circuit_best_finish",
                   "team_circuit_avg_finish")
RATES = {"form_dnf_rate_5": "dnf_rate", "driver_dnf_rate": "dnf_rate", "team_dnf_rate": "dnf_rate",
         "driver_circuit_podium_rate": "podium_rate"}
ZERO_FILL = ("form_avg_points_3", "momentum", "driver_wet_delta", "quali_gap_to_teammate",
             "form_finish_vs_teammate", "driver_wet_n", "driver_races_at_circuit",
             "constructor_standing_prior", "driver_pace_races")
FLAG_DEFAULTS = {"is_rookie_here": 1, "teammate_available": 0, "pit_start": 0}
WEATHER_MEANS = ("air_temp", "track_temp", "humidity", "wind_speed")
WEATHER_ZERO = ("rainfall", "is_wet")
PRIOR = "driver_overall_avg_finish"
GRID_DEFAULT = 20.0


def fit(train: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The fill constants, one row (or one per `by` key, such as a fold)."""
    podium = F.avg(F.when(F.col("position") <= 3, 1.0).otherwise(0.0))
    parts = [F.avg("position").alias("global_mean_finish"), podium.alias("podium_rate"),
             F.avg("is_dnf").alias("dnf_rate"), F.lit(GRID_DEFAULT).alias("grid_position_default"),
             *[F.avg(c).alias(f"mean_{c}") for c in WEATHER_MEANS if c in train.columns],
             F.count(F.lit(1)).alias("fitted_rows"), F.min("year").alias("fitted_year_min"),
             F.max("year").alias("fitted_year_max"),
             F.count_distinct("year", "round").alias("fitted_contests")]
    if by:
        return train.groupBy(*by).agg(*parts)
    # Using the constants of an empty fit is an error, raised when the row is read.
    guard = F.when(F.col("fitted_rows") > 0, F.col("fitted_rows")).otherwise(
        F.raise_error(F.lit("cannot fit a fill policy on no rows")).cast("bigint"))
    return train.agg(*parts).withColumn("fitted_rows", guard)


def transform(df: DataFrame, policy: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Apply fitted constants: own prior first, then the global mean, the prior itself last."""
    names = df.columns
    # One row, or one per fold: the size of the policy does not depend on the data.
    joined = df.join(F.broadcast(policy), list(by)) if by else with_row(df, policy)
    filled = {}
    for c in POSITION_SCALED:
        chain = [F.col(c), *([F.col(PRIOR)] if PRIOR in names else []), F.col("global_mean_finish")]
        filled[c] = F.coalesce(*chain)
    for c, const in RATES.items():
        filled[c] = F.coalesce(c, const)
    for c in (*ZERO_FILL, *WEATHER_ZERO):
        filled[c] = F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in names else None
    for c, v in FLAG_DEFAULTS.items():
        filled[c] = F.coalesce(F.col(c), F.lit(v)).cast("int")
    for c in WEATHER_MEANS:
        if f"mean_{c}" in policy.columns:
            filled[c] = F.coalesce(c, f"mean_{c}")
    filled["grid_position"] = F.coalesce("grid_position", "grid_position_default")
    filled[PRIOR] = F.coalesce(PRIOR, "global_mean_finish")
    return joined.select(*[filled[c].alias(c) if filled.get(c) is not None else col(c) for c in names])
