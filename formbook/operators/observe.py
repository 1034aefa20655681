"""From observations (laps, samples, sessions) to one row per entity and contest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import CONTEST
from ..functions import vocab
from ..functions.expr import col, ratio
from .grouping import attach, group_quantiles


def clean(laps: DataFrame) -> DataFrame:
    """Green-flag, accurate, timed laps that are neither in-laps, out-laps nor deleted."""
    kept = ((F.col("track_status") == "1") & F.col("is_accurate") & F.col("secs").isNotNull()
            & F.col("pit_in_time").isNull() & F.col("pit_out_time").isNull())
    if "deleted" in laps.columns:
        kept = kept & ~F.coalesce(F.col("deleted"), F.lit(False))
    return laps.filter(kept)


def _against_field(table: DataFrame, value: str, contest: Sequence[str]) -> DataFrame:
    """Attach the field median of an entity-level value; non-positive fields drop out."""
    field = group_quantiles(table, contest, {"_field": (value, 0.5)})
    return attach(table, field, contest, calendar=True).filter(F.col("_field") > 0)


def race_pace(laps: DataFrame, contest: Sequence[str] = CONTEST, entity="driver") -> DataFrame:
    """Median clean pace per entity against the median of medians, spread and count."""
    keys = [*contest, entity]
    good = clean(laps).select(*keys, "secs")
    mid = group_quantiles(good, keys, {"_mid": ("secs", 0.5)}, {
        "race_pace_laps": F.count(F.lit(1)).cast("double"), "_sd": F.stddev_samp("secs")})
    per = _against_field(mid, "_mid", contest)
    return per.select(*keys, (100.0 * (F.col("_mid") / F.col("_field") - 1.0)).alias("race_pace_pct"),
                      "race_pace_laps", (100.0 * ratio("_sd", "_mid")).alias("race_pace_sd_pct"))


def long_runs(laps: DataFrame, contest: Sequence[str] = CONTEST, entity="driver",
              min_laps: int = vocab.MIN_RUN_LAPS) -> DataFrame:
    """Runs of one entity, stint and compound with enough clean laps. A NULL stint is a stint."""
    null_safe = [F.coalesce(F.col(c), F.lit("<none>")).alias(c) for c in ("stint", "compound")]
    keys = [*contest, entity, "stint", "compound"]
    good = clean(laps).select(*contest, entity, *null_safe, "secs", F.col("tyre_life").cast("double"))
    both = F.col("tyre_life").isNotNull()
    slope = F.when((F.count(F.when(both, 1)) >= min_laps)
                   & (F.min("tyre_life") < F.max("tyre_life")), F.regr_slope("secs", "tyre_life"))
    facts = {"laps": F.count(F.lit(1)).cast("int"), "sd_s": F.stddev_samp("secs"), "deg_slope": slope}
    return group_quantiles(good, keys, {"median_s": ("secs", 0.5)}, facts, F.col("laps") >= min_laps)


def best_runs(runs: DataFrame, contest: Sequence[str] = CONTEST, entity="driver") -> DataFrame:
    """The entity's fastest run against the field's median best run, and its run count.

    Runs that name their `session` also say which one was used (`practice_session`).
    """
    keys = [*contest, entity]
    named = ["session"] if "session" in runs.columns else []
    first = F.struct("median_s", "stint", "compound", "laps", "sd_s", "deg_slope", *named)
    best = (runs.groupBy(*keys).agg(F.min(first).alias("b"), F.count(F.lit(1)).alias("_runs"))
            .select(*keys, "b.*", "_runs"))
    return _against_field(best, "median_s", contest).select(
        *keys, (100.0 * (F.col("median_s") / F.col("_field") - 1.0)).alias("practice_pace_pct"),
        F.col("laps").cast("double").alias("practice_laps"),
        (100.0 * F.col("sd_s") / F.col("median_s")).alias("practice_sd_pct"),
        F.col("deg_slope").alias("practice_deg_slope"),
        F.col("_runs").cast("double").alias("practice_runs"), *[F.col(c).alias("practice_session") for c in named])


def preferred_session(summaries: DataFrame, contest: Sequence[str] = CONTEST, session="session",
                      order: Sequence[str] = vocab.SESSION_PREFERENCE) -> DataFrame:
    """Rows of the first session in the preference order that has any, per contest."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), col(session))
    usable = summaries.withColumn("_pref", place).filter(F.col("_pref") > 0)
    chosen = usable.groupBy(*contest).agg(F.min("_pref").alias("_best"))
    return (attach(usable, chosen, contest, calendar=True)
            .filter(F.col("_pref") == F.col("_best")).drop("_pref", "_best"))


def weather_summary(samples: DataFrame, means: Sequence[str], rain="rainfall",
                    contest: Sequence[str] = CONTEST) -> DataFrame:
    """Mean readings per contest and whether any sample saw rain."""
    wet = F.max(F.coalesce(col(rain), F.lit(False)).cast("int")).cast("double")
    return samples.groupBy(*contest).agg(*[F.avg(m).alias(m) for m in means],
                                         wet.alias("rainfall"), wet.alias("is_wet"))


def qualifying_summary(times: DataFrame, contest: Sequence[str] = CONTEST) -> DataFrame:
    """Best of the three segment times and the gap to the field's best."""
    best = times.withColumn("quali_best_s", F.least("q1_s", "q2_s", "q3_s"))
    pole = best.groupBy(*contest).agg(F.min("quali_best_s").alias("_pole"))
    return (attach(best, pole, contest, calendar=True)
            .withColumn("gap_to_pole_s", F.col("quali_best_s") - F.col("_pole")).drop("_pole"))


def upcoming(schedule: DataFrame, as_of: str, date="date") -> DataFrame:
    """Schedule rows without testing and without contests after `as_of`."""
    real = (F.col("round") > 0) & (F.coalesce(F.col("format"), F.lit("")) != "testing")
    return schedule.filter(real & (col(date) <= F.lit(as_of).cast("date")))


def session_rows(results: DataFrame, schedule: DataFrame, weather: DataFrame, quali: DataFrame,
                 pace: DataFrame, contest: Sequence[str] = CONTEST, entity="driver") -> DataFrame:
    """Landed session tables to entry rows: dimension joins, then entity-level joins."""
    keys = [*contest, entity]
    out = attach(results, schedule, contest, calendar=True)
    out = attach(out, weather, contest, calendar=True)
    return out.join(quali, keys, "left").join(pace, keys, "left")
