"""SQL building blocks of the DuckDB counterparts: the adapter views as plain windows."""

from __future__ import annotations

_PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, needs: tuple[str, ...], body: str) -> None:
    """Declare a named common table expression and what it builds on."""
    _PARTS[name] = (needs, body)


def sql(needs: str, final: str) -> str:
    """A statement with the transitive CTEs of `needs` (space separated) and a final select."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in _PARTS[n][0]:
            visit(d)
        order.append(n)

    for n in needs.split():
        visit(n)
    ctes = ",\n".join(f"{n} as ({_PARTS[n][1]})" for n in order)
    return f"with {ctes}\n{final}" if ctes else final


def r(*names: str) -> str:
    """Rounded doubles: `expr as name` items, or plain names (several in one string)."""
    parts = []
    for n in names:
        for item in ([n] if " as " in n else n.split(", ")):
            expr, _, alias = item.rpartition(" as ")
            parts.append(f"floor(cast({expr or alias} as double) * 1000000.0 + 0.5) / 1000000.0 as {alias}")
    return ", ".join(parts)


part("m", (), """
  select cast(year(l_shipdate) as int) as year, cast(month(l_shipdate) as int) as round,
         l_suppkey as driver, round(sum(l_extendedprice), 2) as rev, sum(l_quantity) as qty,
         cast(count(*) as int) as n,
         cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as int) as n_ret
  from lineitem group by 1, 2, 3""")
part("ranked", ("m",), """
  select m.*, s_nationkey as team, cast(count(*) over (partition by year, round) as int) as field_size,
         row_number() over (partition by year, round order by rev desc, driver) as result_order0,
         row_number() over (partition by year, round order by qty desc, driver) as grid0
  from m join supplier on s_suppkey = driver""")
part("stated", ("ranked",), """
  select *, case when n_ret * 2 > n then 'Engine' when n_ret % 5 = 0 then 'Finished'
                 when n_ret % 5 = 1 then '+1 Lap' when n_ret % 5 = 2 then 'Lapped'
                 when n_ret % 5 = 3 then 'Collision' else 'Retired' end as status
  from ranked""")
part("entries", ("stated",), """
  select year, round, make_date(year, round, 1) as date, year * 12 + round as d, driver, team,
         concat('venue_', cast(round as varchar)) as circuit_id, rev, qty, n, n_ret, field_size,
         cast(result_order0 as int) as result_order,
         case when (driver + round) % 29 <> 0 then cast(grid0 as double) end as grid_raw,
         case when (driver + round) % 29 = 0 then cast(field_size as double) else cast(grid0 as double) end as grid_position,
         case when (driver + round) % 29 = 0 then 1 else 0 end as pit_start, status,
         case when status <> 'Engine' then cast(result_order0 as double) end as position,
         cast(case result_order0 when 1 then 25 when 2 then 18 when 3 then 15 when 4 then 12 when 5 then 10
              when 6 then 8 when 7 then 6 when 8 then 4 when 9 then 2 when 10 then 1 else 0 end as double) as points,
         case when (year * 7 + round) % 6 = 0 then 1 else 0 end as is_wet,
         rev / qty as q1_s,
         case when grid0 <= 0.75 * field_size then cast(0.99 as double) * rev / qty end as q2_s,
         case when grid0 <= 0.5 * field_size then cast(0.98 as double) * rev / qty end as q3_s,
         case when status in ('Finished', '+1 Lap', 'Lapped') then 0 else 1 end as is_dnf,
         case when driver % 7 = 0 then null
              when status in ('Engine', 'Collision', 'Retired') then case when n_ret % 2 = 0 then 'R' else 'N' end
              else cast(result_order0 as varchar) end as classified_position_raw
  from stated""")
part("official", ("entries",), """
  select * exclude (result_order), position as result_order,
         case status when 'Engine' then 'mechanical' when 'Collision' then 'accident'
                     when 'Retired' then 'retired_unspecified' else 'finished' end as status_category,
         1 as started, 1 - is_dnf as finished,
         case when classified_position_raw in ('R', 'N') then 0
              when classified_position_raw is not null then 1
              when is_dnf = 0 or position is not null then 1 else 0 end as officially_classified,
         case when classified_position_raw is null then 'derived_from_status'
              else 'classified_position' end as officially_classified_source
  from entries""")
part("labelled", ("official",), """
  select *, case when result_order = 1 and officially_classified = 1 then 1 else 0 end as is_winner,
         case when result_order <= 3 and officially_classified = 1 then 1 else 0 end as is_podium,
         case when result_order <= 10 and officially_classified = 1 then 1 else 0 end as finished_top10
  from official""")
part("laps", (), """
  select cast(year(l_shipdate) as int) as year, cast(month(l_shipdate) as int) as round, l_suppkey as driver,
         l_linestatus as stint, l_returnflag as compound, l_linenumber as tyre_life,
         l_extendedprice / nullif(l_quantity, 0) as secs,
         case when l_discount < 0.08 then '1' else '4' end as track_status, l_tax <= 0.07 as is_accurate,
         case when l_tax = 0.05 then l_shipdate end as pit_in_time,
         case when l_tax = 0.06 then l_shipdate end as pit_out_time,
         case when l_discount > 0 then l_discount = 0.07 end as deleted
  from lineitem""")
part("clean", ("laps",), """
  select * from laps where track_status = '1' and is_accurate and secs is not null
     and pit_in_time is null and pit_out_time is null and deleted is distinct from true""")
part("pace_mid", ("clean",), """
  select year, round, driver, quantile_cont(secs, 0.5) as mid, cast(count(*) as double) as laps,
         stddev_samp(secs) as sd from clean group by 1, 2, 3""")
part("pace", ("pace_mid",), """
  select p.year, p.round, p.driver, 100.0 * (mid / f - 1.0) as race_pace_pct, laps as race_pace_laps,
         100.0 * sd / mid as race_pace_sd_pct
  from pace_mid p join (select year, round, quantile_cont(mid, 0.5) as f from pace_mid group by 1, 2) q
    on p.year = q.year and p.round = q.round where f > 0""")
part("paced", ("entries", "pace"), """
  select e.*, race_pace_pct, race_pace_laps, race_pace_sd_pct from entries e
  left join pace p on e.year = p.year and e.round = p.round and e.driver = p.driver""")
part("runs", ("clean",), """
  select year, round, driver, coalesce(stint, '<none>') as stint, coalesce(compound, '<none>') as compound,
         cast(count(*) as int) as laps, quantile_cont(secs, 0.5) as median_s, stddev_samp(secs) as sd_s,
         case when count(tyre_life) >= 4 and count(distinct tyre_life) >= 2
              then regr_slope(secs, tyre_life) end as deg_slope
  from clean group by 1, 2, 3, 4, 5 having count(*) >= 4""")
part("best", ("runs",), """
  select *, row_number() over (partition by year, round, driver order by median_s, stint, compound) as rn,
         count(*) over (partition by year, round, driver) as n_runs from runs""")
part("practice", ("best",), """
  select b.year, b.round, driver, 100.0 * (median_s / f - 1.0) as practice_pace_pct,
         cast(laps as double) as practice_laps, 100.0 * sd_s / median_s as practice_sd_pct,
         deg_slope as practice_deg_slope, cast(n_runs as double) as practice_runs
  from best b join (select year, round, quantile_cont(median_s, 0.5) as f from best where rn = 1 group by 1, 2) q
    on b.year = q.year and b.round = q.round where rn = 1""")

PAST = "range between unbounded preceding and 1 preceding"


def past(fn: str, keys: str) -> str:
    """`fn` over strictly earlier contests of `keys`."""
    return f"{fn} over (partition by {keys} order by d {PAST})"


def ewm(value: str, n: str, keys: str, h: float) -> str:
    """Closed-form weighted past mean given the running count column `n`."""
    w = f"pow(2.0, {n} / {float(h)})"
    return (f"{past(f'sum({value} * {w})', keys)} / "
            f"{past(f'sum(case when {value} is not null then {w} end)', keys)}")


part("form", ("paced",), f"""
  select *, avg(position) over w3 as form_avg_finish_3, avg(points) over w3 as form_avg_points_3,
         avg(grid_position) over w3 as form_avg_quali_3, avg(is_dnf) over w5 as form_dnf_rate_5,
         {past('avg(position)', 'driver, year')} as season_avg_finish,
         avg(position) over w3 - {past('avg(position)', 'driver, year')} as momentum
  from paced
  window w3 as (partition by driver order by d rows between 3 preceding and 1 preceding),
         w5 as (partition by driver order by d rows between 5 preceding and 1 preceding)""")
part("weather", ("form",), f"""
  select *, {past('avg(position)', 'driver')} as driver_overall_avg_finish,
         {past('avg(case when is_wet = 1 then position end)', 'driver')} as driver_wet_avg,
         cast({past('count(case when is_wet = 1 then 1 end)', 'driver')} as double) as driver_wet_n,
         {past('avg(case when is_wet = 1 then position end)', 'driver')}
           - {past('avg(position)', 'driver')} as driver_wet_delta
  from form""")
part("venue", ("weather",), f"""
  select *, {past('avg(position)', 'driver, circuit_id')} as driver_circuit_avg_finish,
         {past('min(position)', 'driver, circuit_id')} as driver_circuit_best_finish,
         {past('avg(case when position <= 3 then 1.0 else 0.0 end)', 'driver, circuit_id')} as driver_circuit_podium_rate,
         cast({past('count(*)', 'driver, circuit_id')} as double) as driver_races_at_circuit,
         case when {past('count(*)', 'driver, circuit_id')} = 0 then 1 else 0 end as is_rookie_here,
         {past('avg(position)', 'team, circuit_id')} as team_circuit_avg_finish
  from weather""")
part("reliable", ("venue",), f"""
  select *, {past('avg(is_dnf)', 'driver')} as driver_dnf_rate, {past('avg(is_dnf)', 'team')} as team_dnf_rate,
         {past('sum(points)', 'team, year')} as constructor_standing_prior
  from venue""")
part("team_pace", ("paced",), """
  select team, d, avg(race_pace_pct) as v, count(avg(race_pace_pct)) over (partition by team order by d) as k
  from paced group by team, d""")
part("team_ewm", ("team_pace",), f"""
  select team, d, {ewm('v', 'k', 'team', 3)} as team_pace_ewm_3, {ewm('v', 'k', 'team', 12)} as team_pace_ewm_12
  from team_pace""")
part("numbered", ("reliable",), """
  select *, count(race_pace_pct) over (partition by driver order by d) as k_pace,
         count(race_pace_sd_pct) over (partition by driver order by d) as k_sd from reliable""")
part("rated", ("numbered", "team_ewm"), f"""
  select *, driver_pace_ewm_3 - driver_pace_ewm_12 as driver_pace_trend,
         team_pace_ewm_3 - team_pace_ewm_12 as team_pace_trend,
         driver_pace_ewm_3 - team_pace_ewm_3 as driver_pace_vs_team
  from (select n.*, {ewm('race_pace_pct', 'k_pace', 'driver', 3)} as driver_pace_ewm_3,
               {ewm('race_pace_pct', 'k_pace', 'driver', 12)} as driver_pace_ewm_12,
               {ewm('race_pace_sd_pct', 'k_sd', 'driver', 3)} as driver_pace_sd_ewm,
               cast({past('count(race_pace_pct)', 'driver')} as double) as driver_pace_races from numbered n)
  left join team_ewm using (team, d)""")


def mate(c: str) -> str:
    """Mean of the other group members in the contest, NULL when any value is missing."""
    g = "over (partition by year, round, team)"
    return (f"((case when count({c}) {g} = count(*) {g} then sum({c}) {g} end - {c})"
            f" / nullif(count(*) {g} - 1, 0))")


part("mated", ("rated",), f"""
  select * exclude (g1, g2), coalesce(g1, 0.0) as quali_gap_to_teammate, coalesce(g2, 0.0) as form_finish_vs_teammate,
         case when g1 is not null and g2 is not null then 1 else 0 end as teammate_available
  from (select *, form_avg_quali_3 - {mate('form_avg_quali_3')} as g1,
               form_avg_finish_3 - {mate('form_avg_finish_3')} as g2 from rated)""")
part("gaps", ("mated",), f"""
  select *, 100.0 * (q1_s / min(q1_s) over k - 1.0) as q1_gap_pct, 100.0 * (q2_s / min(q2_s) over k - 1.0) as q2_gap_pct,
         100.0 * (q3_s / min(q3_s) over k - 1.0) as q3_gap_pct,
         100.0 * (q1_s / {mate('q1_s')} - 1.0) as m1, 100.0 * (q2_s / {mate('q2_s')} - 1.0) as m2,
         100.0 * (q3_s / {mate('q3_s')} - 1.0) as m3
  from mated window k as (partition by year, round)""")
part("mids", ("gaps",), """
  select year, round, quantile_cont(q1_gap_pct, 0.5) as md1, quantile_cont(q2_gap_pct, 0.5) as md2,
         quantile_cont(q3_gap_pct, 0.5) as md3,
         quantile_cont(q1_gap_pct, 0.9) - quantile_cont(q1_gap_pct, 0.1) as spread from gaps group by 1, 2""")
part("features", ("gaps", "mids"), """
  select g.*, case when q3_s is not null then 3.0 when q2_s is not null then 2.0 when q1_s is not null then 1.0
              else 0.0 end as quali_stage_reached,
         coalesce(q3_gap_pct, q2_gap_pct, q1_gap_pct) as quali_gap_pct,
         coalesce(q3_gap_pct - md3, q2_gap_pct - md2, q1_gap_pct - md1) as quali_gap_to_median_pct,
         coalesce(m3, m2, m1) as quali_pace_vs_teammate_pct, coalesce(spread, 0.0) as quali_field_spread_pct,
         case when q3_s is null and q2_s is null and q1_s is null then 1 else 0 end as quali_no_time
  from gaps g join mids m on g.year = m.year and g.round = m.round""")
