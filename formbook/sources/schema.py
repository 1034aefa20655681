"""Column roles and table schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column roles (fixed values).
ID_COLS = (
    "year", "round", "event_name", "circuit_id", "driver", "driver_id", "team", "date",
    "position", "status", "points", "result_order", "classified_position_raw",
    "status_category", "started", "finished", "officially_classified",
    "officially_classified_source", "is_winner", "is_podium", "is_dnf", "classified",
    "driver_overall_avg_finish", "air_temp", "track_temp", "humidity", "wind_speed",
    "rainfall", "is_wet", "q1_s", "q2_s", "q3_s", "quali_best_s", "gap_to_pole_s",
    "race_pace_pct", "race_pace_laps", "race_pace_sd_pct", "practice_pace_pct",
    "practice_laps", "practice_sd_pct", "practice_deg_slope", "practice_runs",
)
TARGET = "finished_top10"
FEATURE_COLS = (
    "grid_position", "pit_start", "form_avg_finish_3", "form_avg_points_3",
    "form_avg_quali_3", "form_dnf_rate_5", "season_avg_finish", "momentum",
    "driver_wet_delta", "driver_wet_n", "driver_circuit_avg_finish",
    "driver_circuit_best_finish", "driver_circuit_podium_rate", "driver_races_at_circuit",
    "is_rookie_here", "team_circuit_avg_finish", "quali_gap_to_teammate",
    "form_finish_vs_teammate", "teammate_available", "driver_dnf_rate", "team_dnf_rate",
    "constructor_standing_prior", "quali_gap_pct", "quali_gap_to_median_pct",
    "quali_pace_vs_teammate_pct", "quali_stage_reached", "quali_field_spread_pct",
    "quali_no_time", "q1_gap_pct", "driver_pace_ewm_3", "driver_pace_ewm_12",
    "driver_pace_trend", "team_pace_ewm_3", "team_pace_ewm_12", "team_pace_trend",
    "driver_pace_vs_team", "driver_pace_sd_ewm", "driver_pace_races",
)
REMOVED_COLS = ("air_temp", "track_temp", "humidity", "wind_speed", "rainfall", "is_wet",
                "driver_temp_bin_avg", "driver_temp_bin_n")
OUTCOME_COLS = ("position", "status", "points", "is_dnf", "classified", "finished_top10",
                "result_order", "officially_classified", "started", "finished",
                "is_winner", "is_podium")
PRACTICE_COLS = ("practice_pace_pct", "practice_laps", "practice_sd_pct",
                 "practice_deg_slope", "practice_runs")
PACE_COLS = ("race_pace_pct", "race_pace_laps", "race_pace_sd_pct")
NATIVE_MISSING = (
    "q1_gap_pct", "q2_gap_pct", "q3_gap_pct", "quali_gap_pct", "quali_gap_to_median_pct",
    "quali_pace_vs_teammate_pct", "driver_pace_ewm_3", "driver_pace_ewm_12",
    "driver_pace_trend", "team_pace_ewm_3", "team_pace_ewm_12", "team_pace_trend",
    "driver_pace_vs_team", "driver_pace_sd_ewm", *PRACTICE_COLS,
)

HEADER_SCHEMA = (
    "event struct<year:int, round:int, event_name:string, date:date>, created_utc timestamp,"
    " grid struct<status:string, source:string, cutoff_utc:string, field_size:bigint,"
    "  n_pit_starts:int, notes:array<string>>,"
    " bundle struct<training_cutoff_utc:string, temperature:double, alpha:double>,"
    " id_types struct<driver:string, team:string>")


def prediction_schema(driver: str = "bigint", team: str = "int") -> str:
    """Columns of a flat predictions table, ids of the given types."""
    return (f"year int, round int, pred_finish_rank int, driver {driver}, team {team}, grid_position double,"
            " qualifying_position double, pit_start int, p_win double, p_podium double, p_top10 double")


def nested_schema(driver: str = "bigint", team: str = "int") -> str:
    """A record that nests its predictions, as other writers leave them."""
    entry = "pred_finish_rank:int, driver:{}, team:{}, grid_position:double, p_win:double, p_podium:double, p_top10:double"
    return HEADER_SCHEMA.rsplit(",", 2)[0] + f", predictions array<struct<{entry.format(driver, team)}>>"


def project_roles(df: DataFrame) -> DataFrame:
    """Identifier, feature and target columns that are present, in that order."""
    wanted = dict.fromkeys((*ID_COLS, *FEATURE_COLS, TARGET))
    return df.select(*[c for c in wanted if c in df.columns])


def role_problems(features=FEATURE_COLS, ids=ID_COLS, removed=REMOVED_COLS) -> list[tuple[str, str]]:
    """(rule, column) for every broken role rule; empty when the registry is sound."""
    return ([("feature_is_removed", c) for c in features if c in removed]
            + [("feature_is_identifier", c) for c in features if c in ids]
            + [("feature_repeated", c) for c in dict.fromkeys(features) if list(features).count(c) > 1])


def role_report(df: DataFrame) -> DataFrame:
    """One row per column of `df` with its role, type and number of known values."""
    role = {**{c: "removed" for c in REMOVED_COLS}, **{c: "id" for c in ID_COLS},
            **{c: "feature" for c in FEATURE_COLS}, TARGET: "target"}
    facts = [F.struct(F.lit(c).alias("column"), F.lit(role.get(c, "other")).alias("role"), F.lit(t).alias("type"),
                      F.count(F.col(f"`{c}`")).alias("n_known")) for c, t in df.dtypes]
    return df.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))


def complete(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add each missing column as a typed NULL."""
    missing = [c for c in columns if c not in df.columns]
    return df.select("*", *[F.lit(None).cast(columns[c]).alias(c) for c in missing])


def clean_missing(df: DataFrame) -> DataFrame:
    """Floating NaN becomes NULL, zoned timestamps become naive UTC ones."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, T.TimestampType):
            c = F.to_utc_timestamp(c, F.current_timezone()).cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)
