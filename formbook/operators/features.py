"""Feature families, planned together.

A family states what it needs at each level: windows over one entity, sums per
group and contest, aggregates per contest, and final expressions. `build` turns
any set of families into one plan:

    entity windows -> one (group, contest) table -> one contest table -> select

so asking for all families costs the same joins as asking for one. Tables are
built next to the rows and attached once; no family re-reads another's result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import CONTEST
from ..functions.expr import complete_sum, flag, leave_one_out, ratio, steady_sum
from ..sources.schema import PRACTICE_COLS
from . import asof
from .grouping import attach, group_quantiles, sized
from .labels import temperature_bucket

K = list(CONTEST)
SEGMENTS = ("q1", "q2", "q3")
SHORT_HALF_LIFE, LONG_HALF_LIFE, PLACES_HALF_LIFE = 3, 12, 6


@dataclass
class Family:
    """What one family computes at each level, in evaluation order."""

    outputs: Sequence[str]
    prepare: Mapping[str, Column] = field(default_factory=dict)      # row expressions
    entity: Mapping[str, Column] = field(default_factory=dict)       # windows over one entity
    entity_ewm: Mapping[str, asof.PastEwm] = field(default_factory=dict)
    group_sums: Mapping[str, str] = field(default_factory=dict)      # name -> column: _s and _c
    group_means: Mapping[str, str] = field(default_factory=dict)     # name -> column: contest mean
    group_totals: Sequence[str] = ()                                 # any-missing-is-missing totals
    group_past: Mapping[str, Column] = field(default_factory=dict)   # windows over the group table
    group_ewm: Mapping[str, asof.PastEwm] = field(default_factory=dict)
    contest: Mapping[str, Column] = field(default_factory=dict)      # aggregates per contest
    quantiles: Mapping[str, tuple[str, float]] = field(default_factory=dict)
    final: Mapping[str, Column] = field(default_factory=dict)        # expressions over all of it


def _merged(families: Sequence[Family], name: str) -> dict:
    out: dict = {}
    for f in families:
        out |= getattr(f, name)
    return out


def _add(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in columns.items()]) if columns else df


def build(df: DataFrame, *families: Family) -> DataFrame:
    """Add the outputs of the families to the entry rows."""
    base = _add(df, _merged(families, "prepare"))
    entity = {**_merged(families, "entity"), **_merged(families, "entity_ewm")}
    rows = _add(sized(base, "driver") if entity else base, _merged(families, "entity"))
    rows = asof.with_past_ewm(rows, _merged(families, "entity_ewm")) if _merged(families, "entity_ewm") else rows

    sums, means = _merged(families, "group_sums"), _merged(families, "group_means")
    totals = list(dict.fromkeys(c for f in families for c in f.group_totals))
    joined = rows
    if sums or means or totals:
        parts = [F.count(F.lit(1)).alias("_size")]
        if "circuit_id" in df.columns:
            parts.append(F.min("circuit_id").alias("circuit_id"))
        for n, c in sums.items():
            parts += [F.sum(c).alias(f"{n}_s"), F.count(c).alias(f"{n}_c")]
        parts += [ratio(steady_sum(c), F.count(c)).alias(n) for n, c in means.items()]
        parts += [complete_sum(c).alias(f"_tot_{c}") for c in totals]
        per = rows.groupBy("team", *K).agg(F.min("date").alias("date"), *parts)
        past, ewms = _merged(families, "group_past"), _merged(families, "group_ewm")
        per = _add(per, past)
        per = asof.with_past_ewm(per, ewms) if ewms else per
        per = per.select("team", *K, "_size", *[f"_tot_{c}" for c in totals], *past, *ewms)
        joined = attach(joined, per, ["team", *K], salts=8, by=[c for c in joined.columns if c == "driver"])

    contest, quantiles = _merged(families, "contest"), _merged(families, "quantiles")
    if contest or quantiles:
        if quantiles:
            one = group_quantiles(base, K, quantiles, contest)
        else:
            one = base.groupBy(*K).agg(*[c.alias(n) for n, c in contest.items()])
        joined = attach(joined, one, K, calendar=True)

    outputs = [o for f in families for o in f.outputs]
    final = _merged(families, "final")
    direct = {n: c for n, c in final.items() if n.startswith("_")}
    joined = _add(joined, direct)
    return joined.select(*df.columns, *[final[o].alias(o) if o in final else F.col(o) for o in outputs])


# --- the families ----------------------------------------------------------------
def recent_form_family() -> Family:
    """Rolling means of the last 3 or 5 contests, season mean and momentum.

    `form_avg_quali_3` averages earlier starting places.
    """
    d = ["driver"]
    return Family(
        ("form_avg_finish_3", "form_avg_points_3", "form_avg_quali_3", "form_dnf_rate_5",
         "season_avg_finish", "momentum"),
        entity={"form_avg_finish_3": asof.past_rolling_mean(d, "position", 3),
                "form_avg_points_3": asof.past_rolling_mean(d, "points", 3),
                "form_avg_quali_3": asof.past_rolling_mean(d, "grid_position", 3),
                "form_dnf_rate_5": asof.past_rolling_mean(d, "is_dnf", 5),
                "season_avg_finish": asof.past_mean(["driver", "year"], "position")},
        final={"momentum": F.col("form_avg_finish_3") - F.col("season_avg_finish")})


def reliability_family() -> Family:
    """Entity and group retirement rates, and the group's points so far this year."""
    season = asof.before(["team", "year"])
    return Family(
        ("driver_dnf_rate", "team_dnf_rate", "constructor_standing_prior"),
        entity={"driver_dnf_rate": asof.past_mean(["driver"], "is_dnf")},
        group_sums={"_dnf": "is_dnf", "_pts": "points"},
        group_past={"team_dnf_rate": asof.prior_ratio(["team"], "_dnf"),
                    "constructor_standing_prior": F.sum("_pts_s").over(season)})


def weather_family() -> Family:
    """Overall and wet-contest history of an entity."""
    wet = F.coalesce(F.col("is_wet") == 1, F.lit(False))
    return Family(
        ("driver_overall_avg_finish", "driver_wet_avg", "driver_wet_n", "driver_wet_delta"),
        entity={"driver_overall_avg_finish": asof.past_mean(["driver"], "position"),
                "driver_wet_avg": asof.past_mean_where(["driver"], "position", wet),
                "driver_wet_n": asof.past_count_where(["driver"], wet).cast("double")},
        final={"driver_wet_delta": F.col("driver_wet_avg") - F.col("driver_overall_avg_finish")})


def venue_family() -> Family:
    """Entity and group record at the venue."""
    dv = ["driver", "circuit_id"]
    podium = F.when(F.col("position") <= 3, 1.0).otherwise(0.0)
    return Family(
        ("driver_circuit_avg_finish", "driver_circuit_best_finish", "driver_circuit_podium_rate",
         "driver_races_at_circuit", "is_rookie_here", "team_circuit_avg_finish"),
        entity={"driver_circuit_avg_finish": asof.past_mean(dv, "position"),
                "driver_circuit_best_finish": asof.past_min(dv, "position"),
                "driver_circuit_podium_rate": asof.past_mean(dv, podium),
                "driver_races_at_circuit": asof.past_count(dv).cast("double")},
        group_sums={"_pos": "position"},
        group_past={"team_circuit_avg_finish": asof.prior_ratio(["team", "circuit_id"], "_pos")},
        final={"is_rookie_here": flag(F.col("driver_races_at_circuit") == 0)})


def pace_family(columns: Sequence[str]) -> Family:
    """Recency-weighted pace of entity and group, trends and their gap."""
    outputs = ("driver_pace_ewm_3", "driver_pace_ewm_12", "driver_pace_trend", "team_pace_ewm_3",
               "team_pace_ewm_12", "team_pace_trend", "driver_pace_vs_team", "driver_pace_sd_ewm",
               "driver_pace_races")
    pace, d = "race_pace_pct", ["driver"]
    if pace not in columns:
        blank = {c: F.lit(None).cast("double") for c in outputs[:-1]}
        return Family(outputs, final={**blank, "driver_pace_races": F.lit(0.0)})
    sd = F.col("race_pace_sd_pct") if "race_pace_sd_pct" in columns else F.lit(None).cast("double")
    return Family(
        outputs,
        entity={"driver_pace_races": asof.past_count_where(d, F.col(pace).isNotNull()).cast("double")},
        entity_ewm={"driver_pace_ewm_3": asof.past_ewm(d, pace, SHORT_HALF_LIFE),
                    "driver_pace_ewm_12": asof.past_ewm(d, pace, LONG_HALF_LIFE),
                    "driver_pace_sd_ewm": asof.past_ewm(d, sd, SHORT_HALF_LIFE)},
        group_means={"_pace": pace},
        group_ewm={"team_pace_ewm_3": asof.past_ewm(["team"], "_pace", SHORT_HALF_LIFE),
                   "team_pace_ewm_12": asof.past_ewm(["team"], "_pace", LONG_HALF_LIFE)},
        final={"driver_pace_trend": F.col("driver_pace_ewm_3") - F.col("driver_pace_ewm_12"),
               "team_pace_trend": F.col("team_pace_ewm_3") - F.col("team_pace_ewm_12"),
               "driver_pace_vs_team": F.col("driver_pace_ewm_3") - F.col("team_pace_ewm_3")})


def teammate_family() -> Family:
    """Prior form against the mean of the other group members; neutral 0 when unknown."""
    pairs = {"form_avg_quali_3": "quali_gap_to_teammate", "form_avg_finish_3": "form_finish_vs_teammate"}
    gaps = {f"_{o}": F.col(c) - leave_one_out(c, f"_tot_{c}", "_size") for c, o in pairs.items()}
    ready = (F.col("_size") > 1)
    for g in gaps:
        ready = ready & F.col(g).isNotNull()
    return Family(
        (*pairs.values(), "teammate_available"), group_totals=tuple(pairs),
        final={**gaps, **{o: F.coalesce(f"_{o}", F.lit(0.0)) for o in pairs.values()},
               "teammate_available": flag(ready)})


def qualifying_family() -> Family:
    """Gaps within each qualifying segment; the deepest segment an entry reached wins.

    The median and spread of the gaps equal those of the times up to scaling,
    so they come from the segment times without a second pass over the gaps.
    """
    times = [f"{s}_s" for s in SEGMENTS]
    deepest = lambda n: F.coalesce(*[F.col(f"_{s}_{n}") for s in reversed(SEGMENTS)])
    gaps = {}
    for s, t in zip(SEGMENTS, times):
        gaps[f"_{s}_gap"] = 100.0 * (ratio(t, f"_best_{t}") - 1.0)
        gaps[f"_{s}_mid"] = 100.0 * ratio(F.col(t) - F.col(f"_mid_{t}"), f"_best_{t}")
        gaps[f"_{s}_mate"] = 100.0 * (ratio(t, leave_one_out(t, f"_tot_{t}", "_size")) - 1.0)
    stage = (F.when(F.col("q3_s").isNotNull(), 3.0).when(F.col("q2_s").isNotNull(), 2.0)
             .when(F.col("q1_s").isNotNull(), 1.0).otherwise(0.0))
    spread = 100.0 * ratio(F.col("_p90") - F.col("_p10"), "_best_q1_s")
    outputs = {**{f"{s}_gap_pct": F.col(f"_{s}_gap") for s in SEGMENTS},
               "quali_stage_reached": stage, "quali_gap_pct": deepest("gap"),
               "quali_gap_to_median_pct": deepest("mid"),
               "quali_pace_vs_teammate_pct": deepest("mate"),
               "quali_field_spread_pct": F.coalesce(spread, F.lit(0.0)), "quali_no_time": flag(stage == 0.0)}
    return Family(
        tuple(outputs), group_totals=times, contest={f"_best_{t}": F.min(t) for t in times},
        quantiles={**{f"_mid_{t}": (t, 0.5) for t in times}, "_p90": ("q1_s", 0.9), "_p10": ("q1_s", 0.1)},
        final={**gaps, **outputs})


def teammate_grid_family() -> Family:
    """Current starting place against the mean of the other group members."""
    gap = F.col("grid_position") - leave_one_out("grid_position", "_tot_grid_position", "_size")
    return Family(("grid_vs_teammate",), group_totals=("grid_position",), final={"grid_vs_teammate": gap})


def bucket_family(forecast: str) -> Family:
    """History in the same temperature bucket, keyed on a value known before the cutoff."""
    key, known = ["driver", "_bucket"], F.col("_bucket").isNotNull()
    return Family(
        ("driver_temp_bin_avg", "driver_temp_bin_n"), prepare={"_bucket": temperature_bucket(forecast)},
        entity={"driver_temp_bin_avg": F.when(known, asof.past_mean(key, "position")),
                "driver_temp_bin_n": F.when(known, asof.past_count(key)).otherwise(0).cast("double")})


# --- entry points ------------------------------------------------------------------
def recent_form(df: DataFrame) -> DataFrame:
    return build(df, recent_form_family())


def reliability(df: DataFrame) -> DataFrame:
    return build(df, reliability_family())


def weather_affinity(df: DataFrame) -> DataFrame:
    return build(df, weather_family())


def venue_history(df: DataFrame) -> DataFrame:
    return build(df, venue_family())


def pace_ratings(df: DataFrame) -> DataFrame:
    return build(df, pace_family(df.columns))


def teammate_form(df: DataFrame) -> DataFrame:
    gone = [c for c in ("form_avg_quali_3", "form_avg_finish_3") if c not in df.columns]
    if gone:
        raise KeyError(f"recent form must be built first; missing {gone}")
    return build(df, teammate_family())


def qualifying_pace(df: DataFrame) -> DataFrame:
    return build(df, qualifying_family())


def teammate_grid(df: DataFrame) -> DataFrame:
    return build(df, teammate_grid_family())


def bucket_affinity(df: DataFrame, forecast: str) -> DataFrame:
    return build(df, bucket_family(forecast))


def places_gained(df: DataFrame) -> DataFrame:
    """Past places gained from start to finish, in shares of the field (half-life 6)."""
    sizes = df.groupBy(*K).agg(F.count(F.lit(1)).alias("_fs"))
    out = attach(df, sizes, K, calendar=True).withColumn(
        "_gain", (F.col("grid_position") - F.col("position")) / F.col("_fs"))
    gained = Family(
        ("driver_places_gained", "team_places_gained"),
        entity_ewm={"driver_places_gained": asof.past_ewm(["driver"], "_gain", PLACES_HALF_LIFE)},
        group_means={"_mean_gain": "_gain"},
        group_ewm={"team_places_gained": asof.past_ewm(["team"], "_mean_gain", PLACES_HALF_LIFE)})
    return build(out, gained).drop("_fs", "_gain")


def practice_pace(df: DataFrame, practice: DataFrame | None) -> DataFrame:
    """Practice summary of the same contest; absent entries stay NULL."""
    base = df.drop(*PRACTICE_COLS)
    if practice is None:
        return base.select("*", *[F.lit(None).cast("double").alias(c) for c in PRACTICE_COLS])
    return base.join(practice.select(*K, "driver", *PRACTICE_COLS), [*K, "driver"], "left")


def all_features(df: DataFrame, practice: DataFrame | None = None) -> DataFrame:
    """Every family over the same rows, then the practice join."""
    df = build(df, recent_form_family(), weather_family(), venue_family(), reliability_family(),
               pace_family(df.columns), teammate_family(), qualifying_family())
    return practice_pace(df, practice)


def asof_features(history: DataFrame, upcoming: DataFrame | None = None,
                  practice: DataFrame | None = None) -> DataFrame:
    """The one feature path for training (history) and forecasting (history and upcoming)."""
    from .quality import overlapping
    if upcoming is not None:
        if not overlapping(history, upcoming).isEmpty():
            raise ValueError("`upcoming` names a contest that already has results")
        history = history.unionByName(upcoming, allowMissingColumns=True)
    return all_features(history, practice)
