"""Registered queries: as-of windows and feature families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, features, metrics, quality
from ..operators.grouping import group_quantiles, ranks, tie_ranks, top_k, with_row
from ..sources.league import K, entries, events, laps, labelled, paced_entries
from ..sources.schema import FEATURE_COLS
from .oracle import ewm, past, part, r, sql
from .registry import out, query

ID = [*K, "driver"]
IDS = "year, round, driver"


def _entity(name, column, needs, expr):
    """A one-column as-of query over the entries."""
    def run(spark, sf):
        return out(entries(spark, sf).select(*ID, column().alias("value")))
    query(name, sql(needs, f"select {IDS}, {r(expr + ' as value')} from entries"))(run)


_entity("win1_past_mean", lambda: asof.past_mean(["driver"], "position"), "entries",
        past("avg(position)", "driver"))
_entity("win2_past_rolling_mean", lambda: asof.past_rolling_mean(["driver"], "position", 3), "entries",
        "avg(position) over (partition by driver order by d rows between 3 preceding and 1 preceding)")
_entity("win3_past_min", lambda: asof.past_min(["driver", "circuit_id"], "position"), "entries",
        past("min(position)", "driver, circuit_id"))
_entity("win4_past_sum", lambda: asof.past_sum(["driver"], "points"), "entries",
        past("sum(points)", "driver"))
_entity("win5_past_count", lambda: asof.past_count(["driver", "circuit_id"]).cast("double"), "entries",
        past("count(*)", "driver, circuit_id"))
_entity("win9_past_mean_where", lambda: asof.past_mean_where(["driver"], "position", F.col("is_wet") == 1),
        "entries", past("avg(case when is_wet = 1 then position end)", "driver"))


# Sums per group and contest first, then the window over them: the rows of a contest are peers and share one value,
# which DuckDB's RANGE frames over the entries do not give once a group has many thousand rows.
part("team_record", ("entries",), f"""select team, d, {past('sum(dnf)', 'team')} / {past('sum(n)', 'team')} as team_dnf_rate,
    {past('sum(pts)', 'team, year')} as constructor_standing_prior,
    {past('sum(pos)', 'team, circuit_id')} / nullif({past('sum(known)', 'team, circuit_id')}, 0) as team_circuit_avg_finish from (
    select team, d, year, circuit_id, sum(is_dnf) as dnf, count(*) as n, sum(points) as pts, sum(position) as pos, count(position) as known
    from entries group by 1, 2, 3, 4)""")


@query("win6_past_mean_excluding_contest",
       sql("entries team_record", f"select {IDS}, {r('team_dnf_rate as value')} from entries join team_record using (team, d)"))
def _(spark, sf):
    df = asof.past_by_contest(entries(spark, sf), ["team"], {"value": "is_dnf"})
    return out(df, *ID, "value")


part("kpos", ("entries",), "select *, count(position) over (partition by driver order by d) as k from entries")


@query("win7_past_ewm", sql("kpos", f"select {IDS}, {r(ewm('position', 'k', 'driver', 3) + ' as value')} from kpos"))
def _(spark, sf):
    df = asof.with_past_ewm(entries(spark, sf), {"value": asof.past_ewm(["driver"], "position", 3)})
    return out(df, *ID, "value")


part("tpos", ("entries",), """select team, d, avg(position) as v,
    count(avg(position)) over (partition by team order by d) as k from entries group by team, d""")
part("tewm", ("tpos",), f"select team, d, {ewm('v', 'k', 'team', 12)} as value from tpos")


@query("win8_past_ewm_excluding_contest",
       sql("tewm entries", f"select {IDS}, {r('value')} from entries left join tewm using (team, d)"))
def _(spark, sf):
    df = asof.past_ewm_by_contest(entries(spark, sf), ["team"], "position", {"value": 12})
    return out(df, *ID, "value")


@query("win10_order_contract",
       sql("entries", """select cast(count(*) as bigint) as n_rows, cast(count(distinct (driver, d)) as bigint) as n_keys,
           cast(0 as bigint) as n_duplicate_contests from entries"""))
def _(spark, sf):
    e = entries(spark, sf)
    dup = quality.duplicate_contests(e, ID).agg(F.count(F.lit(1)).alias("n_duplicate_contests"))
    return with_row(e.groupBy(*ID).agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys")), dup)


@query("win11_predicted_rank",
       sql("form", f"""select {IDS}, cast(row_number() over (partition by year, round
           order by form_avg_finish_3 nulls last, grid_position, driver) as int) as pred_rank from form"""))
def _(spark, sf):
    df = features.recent_form(entries(spark, sf))
    return metrics.predicted_rank(df, "form_avg_finish_3", True).select(*ID, "pred_rank")


@query("win12_tie_rank",
       sql("entries", f"""select {IDS}, rank() over (partition by year, round order by n_ret)
           + (count(*) over (partition by year, round, n_ret) - 1) / 2.0 as tie_rank from entries"""))
def _(spark, sf):
    return out(tie_ranks(entries(spark, sf), K, "n_ret", "tie_rank", ["driver"]), *ID, "tie_rank")


@query("win13_contest_zscore",
       sql("entries", f"""select {IDS}, {r('''coalesce((rev - avg(rev) over k)
           / nullif(stddev_samp(rev) over k, 0), 0.0) as rev_z''')} from entries window k as (partition by year, round)"""))
def _(spark, sf):
    from ..operators.probability import standardise
    return out(standardise(entries(spark, sf), ["rev"]), *ID, "rev_z")


@query("win14_favourite",
       sql("entries", """select year, round, driver as favourite, grid_position from entries qualify
           row_number() over (partition by year, round order by grid_position, driver) = 1"""))
def _(spark, sf):
    first = F.min(F.struct("grid_position", "driver"))
    return out(entries(spark, sf).groupBy(*K).agg(first.alias("f"))
               .select(*K, F.col("f.driver").alias("favourite"), F.col("f.grid_position").alias("grid_position")))


@query("win15_debut",
       sql("entries", f"""select {IDS}, circuit_id from entries qualify
           row_number() over (partition by driver, circuit_id order by d) = 1"""))
def _(spark, sf):
    return quality.first_rows(entries(spark, sf), ["driver", "circuit_id"]).select(*ID, "circuit_id")


@query("win16_last_roster",
       sql("entries", """select distinct year, driver, team from entries
           qualify round = max(round) over (partition by year)"""))
def _(spark, sf):
    e = entries(spark, sf)
    last = e.groupBy("year").agg(F.max("round").alias("round"))
    return e.join(F.broadcast(last), K, "left_semi").select("year", "driver", "team").distinct()


@query("win17_field_spread",
       sql("entries", f"""select year, round, {r('quantile_cont(rev, 0.9) - quantile_cont(rev, 0.1) as spread')}
           from entries group by 1, 2"""))
def _(spark, sf):
    q = group_quantiles(entries(spark, sf), K, {"hi": ("rev", 0.9), "lo": ("rev", 0.1)})
    return out(q.select(*K, (F.col("hi") - F.col("lo")).alias("spread")))


# --- long histories on the event stream ---------------------------------------
@query("win_long_prefix",
       sql("", f"""select event_id, cast(count(*) over w as bigint) as n_before, {r('sum(value) over w as sum_before')},
           {r('min(value) over w as min_before')}, {r('max(value) over w as max_before')} from events
           window w as (partition by user_id order by epoch_us(ts) range between unbounded preceding and 1 preceding)"""))
def _(spark, sf):
    df = asof.long_prefix(events(spark, sf), ["user_id"], "ts", {
        "n_before": ("count", "value"), "sum_before": ("sum", "value"),
        "min_before": ("min", "value"), "max_before": ("max", "value")})
    return out(df, "event_id", "n_before", "sum_before", "min_before", "max_before")


@query("win_long_ewm",
       sql("", f"""with k as (select *, row_number() over (partition by user_id order by ts, event_id) as k from events)
           select event_id, {r('''sum(value * pow(2.0, k / 3.0)) over w / sum(pow(2.0, k / 3.0)) over w as ewm''')} from k
           window w as (partition by user_id order by k rows between unbounded preceding and 1 preceding)"""))
def _(spark, sf):
    df = asof.long_ewm(events(spark, sf), ["user_id"], "ts", ["event_id"], "value", 3, "ewm")
    return out(df, "event_id", "ewm")


@query("win_long_rolling_mean",
       sql("", f"""select event_id, {r('''avg(value) over (partition by user_id order by ts, event_id
           rows between 5 preceding and 1 preceding) as mean_5''')} from events"""))
def _(spark, sf):
    df = asof.long_rolling_mean(events(spark, sf), ["user_id"], "ts", ["event_id"], "value", 5, "mean_5")
    return out(df, "event_id", "mean_5")


def _sides(spark, sf):
    e = events(spark, sf)
    left = e.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    right = e.filter(F.col("event_type") == "view").select(
        "user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return left, right


_LR = """with l as (select event_id, user_id, ts from events where event_type = 'purchase'),
     v as (select user_id, ts as view_ts, event_id as view_id, value as view_value from events where event_type = 'view')"""


@query("join5_asof_backward",
       f"""{_LR} select l.event_id, view_id, {r('view_value')} from l asof left join v
           on l.user_id = v.user_id and l.ts > v.view_ts""")
def _(spark, sf):
    left, right = _sides(spark, sf)
    df = asof.asof_join(left, right, ["user_id"], "ts", "view_ts", ["view_id", "view_value"], "view_id")
    return out(df, "event_id", "view_id", "view_value")


@query("join5_asof_forward_tolerance",
       f"""{_LR} select l.event_id, case when epoch_us(view_ts) - epoch_us(ts) <= 86400000000 then view_id end as view_id
           from l asof left join v on l.user_id = v.user_id and l.ts <= v.view_ts""")
def _(spark, sf):
    left, right = _sides(spark, sf)
    df = asof.asof_join(left, right, ["user_id"], "ts", "view_ts", ["view_id"], "view_id",
                        allow_exact=True, direction="forward", tolerance_seconds=86400)
    return df.select("event_id", "view_id")


@query("join6_strictly_earlier_self_join",
       sql("entries", f"select {IDS}, {r(past('avg(position)', 'driver') + ' as value')} from entries"))
def _(spark, sf):
    return out(quality.naive_history(entries(spark, sf), ["driver"], {"value": (F.col("position"), None)}), *ID, "value")


# --- families -------------------------------------------------------------------
def _family(name, needs, columns, build, source=paced_entries, rows=None):
    names = columns.split()
    def run(spark, sf):
        return out(build(source(spark, sf)), *ID, *names)
    query(name, sql(needs, f"select {IDS}, {r(', '.join(names))} from {rows or needs.split()[0]}"))(
        lambda spark, sf: run(spark, sf).select(*ID, *[F.col(c).cast("double").alias(c) for c in names]))


_family("feat1_recent_form", "form", "form_avg_finish_3 form_avg_points_3 form_avg_quali_3 form_dnf_rate_5 "
        "season_avg_finish momentum", features.recent_form)
_family("feat2_reliability", "reliable team_record", "driver_dnf_rate team_dnf_rate constructor_standing_prior", features.reliability,
        rows="(select * exclude (team_dnf_rate, constructor_standing_prior) from reliable) join team_record using (team, d)")
_family("feat3_weather_affinity", "weather", "driver_overall_avg_finish driver_wet_avg driver_wet_n driver_wet_delta",
        features.weather_affinity)
_family("feat4_venue_history", "venue", "driver_circuit_avg_finish driver_circuit_best_finish "
        "driver_circuit_podium_rate driver_races_at_circuit is_rookie_here team_circuit_avg_finish", features.venue_history)
_family("feat5_pace_ratings", "rated", "driver_pace_ewm_3 driver_pace_ewm_12 driver_pace_trend team_pace_ewm_3 "
        "team_pace_ewm_12 team_pace_trend driver_pace_vs_team driver_pace_sd_ewm driver_pace_races", features.pace_ratings)
_family("feat6_teammate_form", "mated", "quali_gap_to_teammate form_finish_vs_teammate teammate_available",
        lambda df: features.teammate_form(features.recent_form(df)))
_family("feat7_segment_gaps", "gaps", "q1_gap_pct q2_gap_pct q3_gap_pct", features.qualifying_pace)
_family("feat8_stage_reached", "features", "quali_stage_reached quali_no_time", features.qualifying_pace)
_family("feat9_deepest_gap", "features", "quali_gap_pct", features.qualifying_pace)
_family("feat10_gap_to_median", "features", "quali_gap_to_median_pct", features.qualifying_pace)
_family("feat11_teammate_pace", "features", "quali_pace_vs_teammate_pct", features.qualifying_pace)
_family("feat12_field_spread", "features", "quali_field_spread_pct", features.qualifying_pace)


@query("feat13_practice_join",
       sql("entries practice", f"""select {IDS}, {r('practice_pace_pct, practice_laps, practice_sd_pct, practice_deg_slope, practice_runs')}
           from entries left join practice using ({IDS})"""))
def _(spark, sf):
    from ..operators.observe import best_runs, long_runs
    df = features.practice_pace(entries(spark, sf), best_runs(long_runs(laps(spark, sf))))
    return out(df, *ID, "practice_pace_pct", "practice_laps", "practice_sd_pct", "practice_deg_slope", "practice_runs")


def _steady_mate(c):
    """`mate` with a total that does not depend on the order of the rows: in steps of 2^-40, as the features take it."""
    g = "over (partition by year, round, team)"
    steps = f"cast(cast(sum(cast(floor({c} * 1099511627776.0::double + 0.5) as bigint)) {g} as varchar) as double) / 1099511627776.0::double"
    return f"((case when count({c}) {g} = count(*) {g} then {steps} end - {c}) / nullif(count(*) {g} - 1, 0))"


@query("feat14_asof_features",
       sql("features team_record", f"""select {IDS}, {r(', '.join(FEATURE_COLS))} from (select * exclude (team_dnf_rate, constructor_standing_prior,
           team_circuit_avg_finish, quali_gap_to_teammate, form_finish_vs_teammate, quali_pace_vs_teammate_pct),
           coalesce(form_avg_quali_3 - {_steady_mate('form_avg_quali_3')}, 0.0) as quali_gap_to_teammate,
           coalesce(form_avg_finish_3 - {_steady_mate('form_avg_finish_3')}, 0.0) as form_finish_vs_teammate,
           coalesce({', '.join(f"100.0 * ({q} / {_steady_mate(q)} - 1.0)" for q in ('q3_s', 'q2_s', 'q1_s'))}) as quali_pace_vs_teammate_pct
           from features) join team_record using (team, d)"""))
def _(spark, sf):
    df = features.asof_features(paced_entries(spark, sf))
    return out(df.select(*ID, *[F.col(c).cast("double").alias(c) for c in FEATURE_COLS]))


part("gain", ("entries",), """select *, (grid_position - position) / field_size as g,
    count((grid_position - position) / field_size) over (partition by driver order by d) as k from entries""")
part("tgain", ("gain",), """select team, d, avg(g) as v, count(avg(g)) over (partition by team order by d) as k
    from gain group by team, d""")
part("tgain_ewm", ("tgain",), f"select team, d, {ewm('v', 'k', 'team', 6)} as team_places_gained from tgain")


@query("feat15_places_gained",
       sql("gain tgain_ewm", f"""select {IDS}, {r(ewm('g', 'k', 'driver', 6) + ' as driver_places_gained')},
           {r('team_places_gained')} from gain left join tgain_ewm using (team, d)"""))
def _(spark, sf):
    return out(features.places_gained(entries(spark, sf)), *ID, "driver_places_gained", "team_places_gained")


from .oracle import mate  # noqa: E402


@query("feat15_teammate_grid",
       sql("entries", f"select {IDS}, {r('grid_position - ' + mate('grid_position') + ' as grid_vs_teammate')} from entries"))
def _(spark, sf):
    return out(features.teammate_grid(entries(spark, sf)), *ID, "grid_vs_teammate")


# Sprint observations: the short stints on compound 'N'.
part("sprint_mid", ("clean",), """select year, round, driver, quantile_cont(secs, 0.5) as mid from clean
    where compound = 'N' group by 1, 2, 3""")


@query("feat15_sprint_pace",
       sql("sprint_mid", f"""select year, round, driver, {r('pct as sprint_pace_pct')},
           cast(row_number() over (partition by year, round order by pct, driver) as int) as sprint_finish
           from (select s.*, 100.0 * (mid / f - 1.0) as pct from sprint_mid s
             join (select year, round, quantile_cont(mid, 0.5) as f from sprint_mid group by 1, 2) q using (year, round) where f > 0)"""))
def _(spark, sf):
    from ..operators.observe import race_pace
    pace = race_pace(laps(spark, sf).filter(F.col("compound") == "N")).withColumnRenamed("race_pace_pct", "sprint_pace_pct")
    placed = ranks(pace, K, {"sprint_finish": [("sprint_pace_pct", "asc"), ("driver", "asc")]})
    return out(placed, *ID, "sprint_pace_pct", "sprint_finish")


_BUCKET = "case when t < 30 then 'cool' when t > 45 then 'hot' when t is not null then 'medium' end"
part("warm", ("entries",), """select *, case when (year + round) % 7 <> 0
    then cast(20 + (year * 5 + round * 3) % 31 as double) end as t from entries""")
part("bucketed", ("warm",), f"select *, {_BUCKET} as b from warm")


def _forecast_temperature():
    y, m = F.col("year"), F.col("round")
    return F.when((y + m) % 7 != 0, (20 + (y * 5 + m * 3) % 31).cast("double"))


@query("feat16_bucket_affinity",
       sql("bucketed", f"""select {IDS}, {r('case when b is not null then ' + past('avg(position)', 'driver, b') + ' end as driver_temp_bin_avg')},
           {r('case when b is not null then ' + past('count(*)', 'driver, b') + ' else 0 end as driver_temp_bin_n')} from bucketed"""))
def _(spark, sf):
    df = entries(spark, sf).withColumn("forecast_temp", _forecast_temperature())
    return out(features.bucket_affinity(df, "forecast_temp"), *ID, "driver_temp_bin_avg", "driver_temp_bin_n")


@query("flagship_form_vs_grid",
       sql("labelled form", f"""select method, cast(count(*) as bigint) as n_contests,
           {r('avg(hit) as winner_accuracy')} from (
           select s.method, s.year, s.round, max(case when pr = 1 then is_winner end) as hit, max(is_winner) as w from (
             select 'form' as method, l.*, row_number() over (partition by l.year, l.round
               order by f.form_avg_finish_3 nulls last, l.grid_position, l.driver) as pr
             from labelled l join form f using (year, round, driver)
             union all select 'grid', l.*, row_number() over (partition by year, round order by grid_position, driver) as pr
             from labelled l) s group by 1, 2, 3) where w = 1 group by 1"""))
def _(spark, sf):
    df = features.recent_form(labelled(spark, sf)).select(*ID, "is_winner", "grid_position", "form_avg_finish_3")
    long = metrics.stack_orderings(df, {"form": ("form_avg_finish_3", True), "grid": ("grid_position", True)})
    # Only the first pick matters, so map tasks keep one row per contest and method.
    picks = top_k(long, ["method", *K], [("_score", "asc"), ("grid_position", "asc"), ("driver", "asc")], 1)
    won = df.groupBy(*K).agg(F.max("is_winner").alias("_w")).filter(F.col("_w") == 1)
    return out(picks.join(F.broadcast(won.select(*K)), K, "left_semi").groupBy("method").agg(
        F.count(F.lit(1)).alias("n_contests"), F.avg("is_winner").alias("winner_accuracy")))
