"""Registered queries: sources, sinks, projections, joins, aggregates, sets, imputation,
folds, data quality and the starting-order contract."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, vocab
from ..functions.expr import flag
from ..operators import features, folds, grid, impute, labels, observe, quality, records
from ..operators.grouping import attach, top_k, with_row
from ..session import scratch_path as scratch
from ..sources import files, league, schema
from ..sources.league import K, entries, labelled, laps, paced_entries, table
from .oracle import part, r, sql
from .registry import out, query
from .tables import feature_table

ID = [*K, "driver"]
IDS = "year, round, driver"
PRACTICE = ", ".join(schema.PRACTICE_COLS)


# --- sources and sinks ------------------------------------------------------------
@query("src1_parquet_scan", f"select o_orderkey, o_custkey, o_orderdate, {r('o_totalprice')}, o_orderstatus from orders")
def _(spark, sf):
    df = files.read_parquet(spark, f"{sf}/orders.parquet")
    return out(df, "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")


@query("src2_optional_side_table",
       sql("entries", f"select {IDS}, " + ", ".join(f"cast(null as double) as {c}" for c in schema.PRACTICE_COLS) + " from entries"))
def _(spark, sf):
    kind = T.StructType([T.StructField("year", T.IntegerType()), T.StructField("round", T.IntegerType()),
                         T.StructField("driver", T.LongType()),
                         *[T.StructField(c, T.DoubleType()) for c in schema.PRACTICE_COLS]])
    side = files.read_optional(spark, f"{sf}/no_such_practice.parquet", kind)
    return out(features.practice_pace(entries(spark, sf), side), *ID, *schema.PRACTICE_COLS)


@query("src3_parts_union",
       sql("entries", f"select {IDS}, date, {r('position, points')} from entries"))
def _(spark, sf):
    e = entries(spark, sf).select(*ID, "date", "position", "points")
    old, new = scratch(spark, "part"), scratch(spark, "part")
    e.filter("year <= 1997").write.parquet(old)
    e.filter("year > 1997").select("points", "position", "date", *reversed(ID)).write.parquet(new)
    return out(files.read_parts(spark, [old, new]), *ID, "date", "position", "points")


_SOFT = """select {ids}, team, grid_position, pit_start, date, exp(-(grid_position - lo) / 10.0)
    / sum(exp(-(grid_position - lo) / 10.0)) over (partition by year, round) as p_win,
    cast(row_number() over (partition by year, round order by grid_position, driver desc) as int) as pred_finish_rank,
    case when (year * 12 + round) % 5 = 0 then cast(date as timestamp) + interval 24 hours
         else cast(date as timestamp) - interval 6 hours end as created_utc,
    'provisional' as grid_status, concat('Contest ', cast(round as varchar)) as event_name
    from (select *, min(grid_position) over (partition by year, round) as lo from entries)"""
part("forecasts0", ("entries",), _SOFT.format(ids="year, round, driver"))
part("forecasts", ("forecasts0",), "select *, least(1.0, 3 * p_win) as p_podium, least(1.0, 10 * p_win) as p_top10 from forecasts0")
part("results", ("labelled",), "select * from labelled where year < (select max(year) from labelled)")


def header():
    return {"source": F.lit("known-order"), "training_cutoff_utc": F.lit("1994-12-31T00:00:00"),
            "temperature": F.lit(10.0), "alpha": F.lit(1.0)}


def archived(spark, sf):
    """Archive every forecast as JSON records once; the archive's folder."""
    path = scratch(spark, "forecasts")
    files.archive_forecasts(*records.split_record(league.forecasts(spark, sf), header()), path)
    return path


@query("src4_json_records",
       sql("forecasts", f"select {IDS}, event_name, created_utc, grid_status, pred_finish_rank, "
           f"{r('grid_position, p_win, p_podium, p_top10')} from forecasts"))
def _(spark, sf):
    flat = files.read_predictions(spark, archived(spark, sf))
    return out(flat.withColumn("created_utc", F.col("created_utc").cast("timestamp_ntz")), *ID, "event_name",
               "created_utc", "grid_status", "pred_finish_rank", "grid_position", "p_win", "p_podium", "p_top10")


def landed(spark, sf):
    """The landed session tables of SRC-5, cut out of the adapter views."""
    e = entries(spark, sf)
    samples = laps(spark, sf).select(*K, F.col("secs").alias("air_temp"), (F.col("tyre_life") == 7).alias("rainfall"))
    return dict(
        results=e.select(*ID, "grid_raw", "status", "points", "classified_position_raw", "position"),
        schedule=league.schedule(spark, sf).select(*K, "date", text.slugify("location").alias("circuit_id")),
        weather=observe.weather_summary(samples, ["air_temp"]),
        quali=observe.qualifying_summary(e.select(*ID, "q1_s", "q2_s", "q3_s")),
        pace=observe.race_pace(laps(spark, sf)))


part("wsum", ("laps",), """select year, round, avg(secs) as air_temp,
    cast(bool_or(tyre_life = 7) as double) as rainfall from laps group by 1, 2""")
part("qsum", ("entries",), """select *, qb - min(qb) over (partition by year, round) as gap from
    (select year, round, driver, least(q1_s, q2_s, q3_s) as qb from entries)""")


@query("src5_session_rows",
       sql("entries labelled wsum qsum pace", f"""select {IDS}, date, concat('venue_', round) as circuit_id, pit_start,
           l.finished, l.is_winner, {r('l.grid_position as grid_position', 'points', 'air_temp', 'w.rainfall as rainfall')},
           {r('qb as quali_best_s', 'gap as gap_to_pole_s', 'race_pace_pct', 'race_pace_laps', 'race_pace_sd_pct')}
           from labelled l join wsum w using (year, round) join qsum q using ({IDS}) left join pace p using ({IDS})"""))
def _(spark, sf):
    rows = observe.session_rows(**landed(spark, sf))
    rows = labels.derive_labels(quality.without_hollow(labels.back_of_grid(rows)))
    return out(rows, *ID, "date", "circuit_id", "pit_start", "finished", "is_winner", "grid_position", "points",
               "air_temp", "rainfall", "quali_best_s", "gap_to_pole_s", "race_pace_pct", "race_pace_laps", "race_pace_sd_pct")


@query("src6_schedule_filter",
       sql("entries", """select distinct year, round, date from entries where round <> 2 and date <= date '1999-06-15'"""))
def _(spark, sf):
    return observe.upcoming(league.schedule(spark, sf), "1999-06-15").select(*K, "date")


@query("snk1_parquet_sink", sql("entries", "select year, count(*) as n_rows, sum(cast(points as bigint)) as points from entries group by 1"))
def _(spark, sf):
    path = scratch(spark, "table")
    files.write_table(entries(spark, sf), path)
    return spark.read.parquet(path).groupBy(F.col("year").cast("int").alias("year")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("points").cast("bigint")).alias("points"))


@query("snk2_coverage_manifest",
       sql("entries", """, want as (select distinct year, round from entries),
           have as (select distinct year, round from entries where (year * 12 + round) % 11 <> 0)
           select year, count(*) as requested, count(h.round) as ingested, count(*) - count(h.round) as skipped,
           count(*) = count(h.round) as complete from want w left join have h using (year, round) group by 1""").replace(")\n,", "),"))
def _(spark, sf):
    e = entries(spark, sf)
    return quality.coverage_manifest(league.schedule(spark, sf), e.filter((F.col("year") * 12 + F.col("round")) % 11 != 0))


@query("snk3_write_once_record",
       sql("forecasts", "select count(distinct (year, round)) as n_contests, count(*) as n_predictions from forecasts"))
def _(spark, sf):
    path = archived(spark, sf)
    n = files.read_predictions(spark, path).agg(F.count(F.lit(1)).alias("n_predictions"))
    return with_row(files.read_forecasts(spark, path).agg(F.count_distinct("event.year", "event.round").alias("n_contests")), n)


_POLICY = r("avg(position) as global_mean_finish", "avg(case when position <= 3 then 1.0 else 0.0 end) as podium_rate",
            "avg(is_dnf) as dnf_rate", "20.0 as grid_position_default")


@query("snk4_fitted_state",
       sql("entries", f"select {_POLICY}, count(*) as fitted_rows from entries where year <= (select max(year) - 2 from entries)"))
def _(spark, sf):
    path = scratch(spark, "policy")
    files.write_policy(impute.fit(train_rows(entries(spark, sf))), path)
    back = files.read_policy(spark, path)
    return out(back, "global_mean_finish", "podium_rate", "dnf_rate", "grid_position_default", "fitted_rows")


@query("snk5_report_sink",
       sql("entries", f"""select year, count(*) as n_rows, {r('avg(is_dnf) as dnf_rate')} from entries group by 1"""))
def _(spark, sf):
    path = scratch(spark, "report")
    report = entries(spark, sf).groupBy("year").agg(
        F.struct(F.count(F.lit(1)).alias("n_rows"), F.avg("is_dnf").alias("dnf_rate")).alias("section"))
    files.write_report(report, path)
    back = spark.read.schema("year int, section struct<n_rows:bigint, dnf_rate:double>").json(path)
    return out(back, "year", "section.n_rows", "section.dnf_rate")


def train_rows(df):
    """Rows up to two years before the latest."""
    return folds.chronological_split(df).filter(F.col("partition") == folds.TRAIN).drop("partition")


# --- projections ---------------------------------------------------------------------
@query("prj1_role_projection",
       sql("labelled", f"select year, round, circuit_id, driver, team, date, {r('position')}, status, {r('points')}, finished_top10 from labelled"))
def _(spark, sf):
    df = schema.project_roles(labelled(spark, sf).withColumn("extra", F.lit(1)))
    assert "extra" not in df.columns
    return out(df, *K, "circuit_id", "driver", "team", "date", "position", "status", "points", "finished_top10")


@query("prj2_slugify",
       """select c_custkey, trim(regexp_replace(lower(trim(concat('  ', c_name, ' / ', c_mktsegment, '! '))),
          '[^a-z0-9]+', '_', 'g'), '_') as slug from customer""")
def _(spark, sf):
    raw = F.concat(F.lit("  "), "c_name", F.lit(" / "), "c_mktsegment", F.lit("! "))
    return table(spark, sf, "customer").select("c_custkey", text.slugify(raw).alias("slug"))


# Names as sponsors decorate them, cycled over the supplier table.
_DECORATED = ["Acme Alpine F1 Team", " Scuderia AlphaTauri Acme ", "RB", "Mercedes", "Kick Sauber", "", "Brand New GP"]
_CANON = ["alpine", "racing_bulls", "racing_bulls", "mercedes", "sauber", "unknown", "brand_new_gp"]


def _named(spark, sf):
    names = F.array(*[F.lit(n) for n in _DECORATED])
    i = (F.col("s_suppkey") % 8).cast("int")
    plain = F.when(i < 7, F.get(names, i)).otherwise(F.col("s_name"))
    return table(spark, sf, "supplier").select("s_suppkey", plain.alias("name"))


@query("prj3_canonical_name",
       "select s_suppkey, case s_suppkey % 8 " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(_CANON))
       + " else replace(lower(s_name), '#', '_') end as id from supplier")
def _(spark, sf):
    return _named(spark, sf).select("s_suppkey", text.canonical_name("name").alias("id"))


@query("prj4_unmapped_report",
       "select case when s_suppkey % 8 = 6 then 'Brand New GP' else s_name end as name, count(*) as n_rows "
       "from supplier where s_suppkey % 8 in (6, 7) group by 1")
def _(spark, sf):
    names = _named(spark, sf).filter(F.trim("name") != "")
    return names.filter(~text.is_mapped_name("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"))


_RAW_STATUS = """case driver % 6 when 0 then upper(status) when 1 then concat('  ', status, ' ')
    when 2 then '+2   Laps' when 3 then 'Teleported' when 4 then null else 'Oil  leak' end"""


def _raw_status():
    i = F.col("driver") % 6
    return (F.when(i == 0, F.upper("status")).when(i == 1, F.concat(F.lit("  "), "status", F.lit(" ")))
            .when(i == 2, "+2   Laps").when(i == 3, "Teleported").when(i == 4, F.lit(None)).otherwise("Oil  leak"))


@query("prj5_status_normalisation",
       sql("entries", f"""select {IDS}, case when driver % 6 = 2 then 'finished' when driver % 6 in (3, 4) then 'unknown'
           when driver % 6 = 5 then 'mechanical' else case lower(status) when 'engine' then 'mechanical'
           when 'collision' then 'accident' when 'retired' then 'retired_unspecified' else 'finished' end end
           as status_category from entries"""))
def _(spark, sf):
    return entries(spark, sf).select(*ID, text.status_category(_raw_status()).alias("status_category"))


@query("prj6_classification_parse",
       sql("entries", f"""select {IDS}, case when classified_position_raw is null then null
           when classified_position_raw in ('R', 'N') then false else true end as classified from entries"""))
def _(spark, sf):
    return entries(spark, sf).select(*ID, text.classification_flag("classified_position_raw").alias("classified"))


@query("prj7_label_derivation",
       sql("labelled", f"""select {IDS}, status_category, started, finished, officially_classified, officially_classified_source,
           is_winner, is_podium, finished_top10, {r('result_order')} from labelled"""))
def _(spark, sf):
    return out(labelled(spark, sf), *ID, "status_category", "started", "finished", "officially_classified",
               "officially_classified_source", "is_winner", "is_podium", "finished_top10", "result_order")


@query("prj8_aliases",
       sql("labelled", f"select {IDS}, is_dnf, case when result_order is not null then 1 else 0 end as classified from labelled"))
def _(spark, sf):
    return labels.add_aliases(labelled(spark, sf).drop("is_dnf")).select(*ID, "is_dnf", "classified")


@query("prj9_back_of_grid", sql("entries", f"select {IDS}, {r('grid_position')}, pit_start from entries"))
def _(spark, sf):
    return out(labels.back_of_grid(entries(spark, sf).drop("grid_position", "pit_start")), *ID, "grid_position", "pit_start")


@query("prj10_bucketing",
       "select event_id, case when value < 30 then 'cool' when value > 45 then 'hot' when value is not null then 'medium' end as bucket from events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", labels.temperature_bucket("value").alias("bucket"))


part("graded", ("labelled",), """select *, cast(case when officially_classified = 1
    then coalesce(greatest(field_size - result_order + 1, 0), 0) else 0 end as int) as relevance from labelled""")


@query("prj11_relevance", sql("graded", f"select {IDS}, relevance from graded"))
def _(spark, sf):
    return labels.relevance(labelled(spark, sf)).select(*ID, "relevance")


@query("prj12_ensure_labels",
       sql("entries", f"""select {IDS}, 1 - is_dnf as finished,
           case when position = 1 then 1 else 0 end as is_winner from entries
           """))
def _(spark, sf):
    bare = entries(spark, sf).drop("result_order", "classified_position_raw")
    return labels.ensure_labels(bare).select(*ID, "finished", "is_winner")


@query("prj13_clean_observations",
       sql("clean", f"select year, round, count(*) as n_laps, {r('sum(secs) as secs')} from clean group by 1, 2"))
def _(spark, sf):
    return out(observe.clean(laps(spark, sf)).groupBy(*K).agg(F.count(F.lit(1)).alias("n_laps"), F.sum("secs").alias("secs")))


@query("prj14_hide_outcomes",
       sql("labelled", f"""select {IDS}, case when year >= 2000 then null else status end as status,
           case when year >= 2000 then 0 else is_dnf end as is_dnf, case when year < 2000 then is_winner end as is_winner,
           {r('case when year < 2000 then position end as position', 'case when year >= 2000 then 0 else points end as points')}
           from labelled"""))
def _(spark, sf):
    return out(labels.hide_outcomes(labelled(spark, sf), F.col("year") >= 2000), *ID, "status", "is_dnf", "is_winner", "position", "points")


def next_contest(spark, sf):
    """Placeholder rows of the month after the last, for the last roster of the last year."""
    e = paced_entries(spark, sf)
    last = e.agg(F.max(F.struct(*K)).alias("k"), F.max("year").alias("year")).first()
    year, rnd = last["k"]["year"], last["k"]["round"]
    roster = e.filter((F.col("year") == year) & (F.col("round") == rnd)).select("driver", "team", "q1_s", "q2_s", "q3_s")
    year, rnd = (year + 1, 1) if rnd == 12 else (year, rnd + 1)
    return e, labels.placeholders(roster, year, rnd, f"{year}-{rnd:02d}-01", f"venue_{rnd}", e)


@query("prj15_placeholders",
       sql("entries", f"""select cast(year + (round // 12) as int) as year, cast(round % 12 + 1 as int) as round, driver, team,
           0 as pit_start, 0 as is_dnf, cast(null as double) as position, cast(0 as double) as points
           from entries where d = (select max(d) from entries)"""))
def _(spark, sf):
    return out(next_contest(spark, sf)[1], *ID, "team", "pit_start", "is_dnf", "position", "points")


_PCT = """case when {p} >= 1.0 then '100%' when {p} >= 0.9995 then '>99.9%' when {p} < 0.0005 then '<0.1%'
    else format('{{:.1f}}%', {p} * 100) end"""


@query("prj16_formatting",
       sql("forecasts labelled", f"""select {IDS}, {_PCT.format(p='round(p_top10, 6)')} as chance,
           case when classified_position_raw is null then 'DNF' when classified_position_raw = 'R' then 'DNF'
                when classified_position_raw = 'N' then 'NC' else classified_position_raw end as pos,
           case when regexp_full_match(classified_position_raw, '[0-9]+') then
             case when g = 0 then '=' when g > 0 then concat('▲', g) else concat('▼', -g) end else '' end as delta
           from (select f.*, l.classified_position_raw,
                 f.pred_finish_rank - try_cast(l.classified_position_raw as int) as g
                 from forecasts f join labelled l using ({IDS}))"""))
def _(spark, sf):
    both = league.forecasts(spark, sf).join(labelled(spark, sf).select(*ID, "classified_position_raw"), ID)
    return both.withColumn("pos", text.finish_label("classified_position_raw")).select(
        *ID, text.percent(F.round("p_top10", 6)).alias("chance"), "pos", text.place_delta("pred_finish_rank", "pos").alias("delta"))


@query("prj17_late_forecast",
       sql("forecasts", "select distinct year, round, created_utc > cast(date as timestamp) as is_late from forecasts"))
def _(spark, sf):
    return records.late_flags(league.forecasts(spark, sf), league.schedule(spark, sf)).select(*K, "is_late")


@query("prj18_spot_check",
       sql("entries", f"""select {IDS}, status from entries where year = 1997 and contains(lower(circuit_id), lower('VENUE_1'))
           order by year, round, driver limit 12"""))
def _(spark, sf):
    e = entries(spark, sf)
    return (e.filter((F.col("year") == 1997) & F.lower("circuit_id").contains("VENUE_1".lower()))
            .orderBy(*ID).limit(12).select(*ID, "status"))


# --- joins -------------------------------------------------------------------------
@query("join1_left_entity",
       sql("entries pace", f"select {IDS}, {r('race_pace_pct')} from entries left join pace using ({IDS})"))
def _(spark, sf):
    return out(entries(spark, sf).join(observe.race_pace(laps(spark, sf)), ID, "left"), *ID, "race_pace_pct")


@query("join2_left_with_suffix",
       sql("entries practice", f"select {IDS}, {r('points', 'practice_laps')} from entries left join practice using ({IDS})"))
def _(spark, sf):
    side = observe.best_runs(observe.long_runs(laps(spark, sf)))
    old = entries(spark, sf).withColumn("practice_laps", F.lit(-1.0))
    return out(features.practice_pace(old, side), *ID, "points", "practice_laps")


@query("join3_group_join_back",
       sql("entries", f"select {IDS}, {r('sum(points) over (partition by year, round, team) as team_points')} from entries"))
def _(spark, sf):
    e = entries(spark, sf)
    per = e.groupBy("team", *K).agg(F.sum("points").alias("team_points"))
    return out(attach(e, per, ["team", *K], salts=8), *ID, "team_points")


@query("join4_overlap_guard",
       sql("entries", "select distinct year, round from entries where year >= 2001"))
def _(spark, sf):
    e = entries(spark, sf)
    return quality.overlapping(e, e.filter("year >= 2001"))


@query("join7_semi_anti",
       sql("entries", f"""select 'kept' as side, count(*) as n_rows from entries where (year, round) in (select year, round from entries where is_wet = 1)
           union all select 'left', count(*) from entries where (year, round) not in (select year, round from entries where is_wet = 1)"""))
def _(spark, sf):
    e = entries(spark, sf)
    wet = e.filter("is_wet = 1").select(*K).distinct()
    count = lambda how, side: e.join(wet, K, how).agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n_rows"))
    return count("left_semi", "kept").unionByName(count("left_anti", "left"))


@query("join10_grid_overlay",
       sql("entries", f"""select {IDS}, pit_start, {r('''case when driver % 3 = 0 then 1.0 + driver else grid_position end
           as grid_position''')} from entries"""))
def _(spark, sf):
    e = entries(spark, sf)
    new = e.filter(F.col("driver") % 3 == 0).select(*ID, (1.0 + F.col("driver")).alias("grid_position"), "pit_start")
    return out(grid.overlay(e, new), *ID, "pit_start", "grid_position")


@query("join9_forecast_result",
       sql("forecasts results", f"""select year, round, count(*) as n_predictions, count(*) - count(x.result_order) as n_unmatched
           from forecasts f left join results x using ({IDS}) group by 1, 2"""))
def _(spark, sf):
    return records.unmatched_counts(league.forecasts(spark, sf), league.results(spark, sf))


# --- aggregates ---------------------------------------------------------------------
@query("agg1_weather_summary", sql("wsum", f"select year, round, {r('air_temp', 'rainfall', 'rainfall as is_wet')} from wsum"))
def _(spark, sf):
    return out(landed(spark, sf)["weather"], *K, "air_temp", "rainfall", "is_wet")


@query("agg2_qualifying_summary", sql("qsum", f"select {IDS}, {r('qb as quali_best_s', 'gap as gap_to_pole_s')} from qsum"))
def _(spark, sf):
    return out(landed(spark, sf)["quali"], *ID, "quali_best_s", "gap_to_pole_s")


@query("agg3_race_pace", sql("pace", f"select {IDS}, {r('race_pace_pct, race_pace_laps, race_pace_sd_pct')} from pace"))
def _(spark, sf):
    return out(observe.race_pace(laps(spark, sf)))


@query("agg4_long_runs", sql("runs", f"select {IDS}, stint, compound, laps, {r('median_s, sd_s')} from runs"))
def _(spark, sf):
    return out(observe.long_runs(laps(spark, sf)), *ID, "stint", "compound", "laps", "median_s", "sd_s")


@query("agg5_degradation_slope", sql("runs", f"select {IDS}, stint, compound, {r('deg_slope')} from runs"))
def _(spark, sf):
    return out(observe.long_runs(laps(spark, sf)), *ID, "stint", "compound", "deg_slope")


@query("agg6_best_runs", sql("practice", f"select {IDS}, {r(PRACTICE)} from practice"))
def _(spark, sf):
    return out(observe.best_runs(observe.long_runs(laps(spark, sf))))


def _session(spark, sf):
    """Runs with the session that the adapter view gives them."""
    session = F.when(F.col("compound") == "R", "FP1").when(F.col("compound") == "A", "FP3").otherwise("FP2")
    return observe.long_runs(laps(spark, sf)).withColumn("session", session)


@query("agg7_session_coverage",
       sql("runs entries", """select e.year, e.round, case min(pref) when 1 then 'FP2' when 2 then 'FP3' when 3 then 'FP1' end as practice_session,
           count(distinct case when pref = best then r.driver end) as n_entities,
           case when not bool_or(l.year is not null) then 'no session' when min(pref) is null then 'no session with long runs' end as reason
           from (select distinct year, round from entries) e left join (select distinct year, round from laps) l using (year, round)
           left join (select *, case compound when 'R' then 3 when 'A' then 2 else 1 end as pref,
             min(case compound when 'R' then 3 when 'A' then 2 else 1 end) over (partition by year, round) as best from runs) r using (year, round)
           group by e.year, e.round"""))
def _(spark, sf):
    chosen = observe.best_runs(observe.preferred_session(_session(spark, sf)))
    return quality.session_coverage(league.schedule(spark, sf), laps(spark, sf), chosen)


@query("agg7_preferred_session",
       sql("runs", f"""select {IDS}, session, laps from (select *, rank() over (partition by year, round order by pref) as rk from (
           select *, case compound when 'R' then 'FP1' when 'A' then 'FP3' else 'FP2' end as session,
           case compound when 'R' then 3 when 'A' then 2 else 1 end as pref from runs)) where rk = 1"""))
def _(spark, sf):
    return observe.preferred_session(_session(spark, sf)).select(*ID, "session", "laps")


@query("agg8_contest_table", sql("entries", "select year, round, min(date) as date, count(*) as n_rows from entries group by 1, 2"))
def _(spark, sf):
    return folds.contests(entries(spark, sf))


@query("agg9_coverage_by_season",
       sql("entries", """, kept as (select * from entries where (year * 12 + round) % 11 <> 0),
           per as (select year, round, count(*) as n from kept group by 1, 2)
           select year, cast(sum(n) as bigint) as n_rows, count(*) as contests, max(round) as max_round, min(n) as min_field,
           max(n) as max_field, cast(list_sort(list_filter(range(1, cast(max(round) as bigint) + 1),
             lambda x: not list_contains(list(round), x))) as int[]) as missing_rounds
           from per group by 1""").replace(")\n,", "),"))
def _(spark, sf):
    return quality.coverage_by_season(entries(spark, sf).filter((F.col("year") * 12 + F.col("round")) % 11 != 0))


@query("agg10_dataset_summary",
       sql("labelled", f"""select count(*) as n_rows, count(distinct (year, round)) as n_contests, min(date) as date_min,
           max(date) as date_max, {r('avg(finished_top10) as top10_rate', 'avg(is_dnf) as dnf_rate')},
           cast(sum(pit_start) as bigint) as pit_starts,
           count(case when is_dnf = 1 and result_order is not null then 1 end) as dnf_and_classified from labelled"""))
def _(spark, sf):
    return out(quality.dataset_summary(labels.add_aliases(labelled(spark, sf))))


@query("agg11_category_frequency", sql("labelled", "select status_category, count(*) as n_rows from labelled group by 1"))
def _(spark, sf):
    return labelled(spark, sf).groupBy("status_category").agg(F.count(F.lit(1)).alias("n_rows"))


@query("agg12_policy_fit",
       sql("entries", f"""select {_POLICY}, count(*) as fitted_rows, min(year) as fitted_year_min, max(year) as fitted_year_max,
           count(distinct (year, round)) as fitted_contests from entries where year <= (select max(year) - 2 from entries)"""))
def _(spark, sf):
    return out(impute.fit(train_rows(entries(spark, sf))))


# --- imputation ---------------------------------------------------------------------
_POS = "form_avg_finish_3 form_avg_quali_3 season_avg_finish driver_circuit_avg_finish driver_circuit_best_finish team_circuit_avg_finish".split()
_FILL = [*[f"coalesce({c}, driver_overall_avg_finish, p.g) as {c}" for c in _POS],
         *[f"coalesce({c}, p.{k}) as {c}" for c, k in (("form_dnf_rate_5", "dr"), ("driver_dnf_rate", "dr"),
                                                    ("team_dnf_rate", "dr"), ("driver_circuit_podium_rate", "pr"))],
         *[f"coalesce({c}, 0.0) as {c}" for c in impute.ZERO_FILL],
         "coalesce(driver_overall_avg_finish, p.g) as driver_overall_avg_finish", "grid_position"]
_FILLED = [f.split(" as ")[-1] for f in _FILL]
part("policy", ("entries",), """select avg(position) as g, avg(case when position <= 3 then 1.0 else 0.0 end) as pr,
    avg(is_dnf) as dr from entries where year <= (select max(year) - 2 from entries)""")


def _filled(spark, sf):
    pre = feature_table(spark, sf)
    return impute.transform(pre, impute.fit(train_rows(paced_entries(spark, sf))))


@query("fill1_fit", sql("entries", f"select {_POLICY}, count(*) as fitted_rows from entries where year <= (select max(year) - 2 from entries)"))
def _(spark, sf):
    return out(impute.fit(train_rows(entries(spark, sf))), "global_mean_finish", "podium_rate", "dnf_rate", "grid_position_default", "fitted_rows")


@query("fill2_transform",
       sql("features policy", f"select {IDS}, {r(*_FILL)} from features cross join policy p"))
def _(spark, sf):
    return out(_filled(spark, sf).select(*ID, *[F.col(c).cast("double").alias(c) for c in _FILLED]))


@query("fill3_unexpected_missing",
       sql("features", " union all ".join(f"select '{c}' as column, count(*) - count({c}) as n_missing from features having count(*) > count({c})"
           for c in schema.FEATURE_COLS if c not in schema.NATIVE_MISSING)))
def _(spark, sf):
    pre = feature_table(spark, sf)
    return quality.missing_counts(pre, schema.FEATURE_COLS, schema.NATIVE_MISSING)


@query("fill4_idempotent", "select 0::bigint as n_changed, count(*) as n_rows from (select distinct year(l_shipdate), month(l_shipdate), l_suppkey from lineitem)")
def _(spark, sf):
    once = _filled(spark, sf)
    policy = impute.fit(train_rows(paced_entries(spark, sf)))
    diff = quality.mismatches(once, impute.transform(once, policy), ID, _FILLED)
    return diff.agg(F.sum("n_mismatches").alias("n_changed"), F.max("n_rows").alias("n_rows"))


# --- sets, sort, limit -----------------------------------------------------------------
@query("set1_sorted_frame", sql("entries", f"select {IDS}, date from entries order by date, year, round"))
def _(spark, sf):
    return entries(spark, sf).select(*ID, "date").orderBy("date", *K)


@query("set2_top_k",
       sql("entries", f"""select {IDS}, cast(row_number() over (partition by year, round order by grid_position, driver) as int) as place
           from entries qualify place <= 3"""))
def _(spark, sf):
    return top_k(entries(spark, sf), K, [("grid_position", "asc"), ("driver", "asc")], 3).select(*ID, "place")


@query("set3_tail_per_entity",
       sql("entries", f"select {IDS} from entries qualify row_number() over (partition by driver order by d desc) <= 3"))
def _(spark, sf):
    return top_k(entries(spark, sf), ["driver"], [("date", "desc")], 3).select(*ID)


@query("set4_global_head", sql("entries", f"select {IDS}, {r('rev')} from entries order by rev desc, driver limit 10"))
def _(spark, sf):
    return out(entries(spark, sf).orderBy(F.desc("rev"), "driver").limit(10), *ID, "rev")


@query("set5_union",
       sql("entries", f"select {IDS}, {r('points')}, {r('case when year > 1997 then rev end as rev')} from entries"))
def _(spark, sf):
    e = entries(spark, sf)
    a, b = e.filter("year <= 1997").select(*ID, "points"), e.filter("year > 1997").select(*ID, "points", "rev")
    return out(a.unionByName(b, allowMissingColumns=True), *ID, "points", "rev")


@query("set6_overlap_size",
       sql("labelled", """select year, round, count(case when g <= 3 and is_podium = 1 then 1 end) as common from
           (select *, row_number() over (partition by year, round order by grid_position, driver) as g from labelled) group by 1, 2"""))
def _(spark, sf):
    first = top_k(labelled(spark, sf), K, [("grid_position", "asc"), ("driver", "asc")], 3)
    return first.groupBy(*K).agg(F.count(F.when(F.col("is_podium") == 1, 1)).alias("common"))


@query("set7_duplicate_keys",
       sql("entries", "select distinct year, round from entries where is_wet = 1"))
def _(spark, sf):
    e = entries(spark, sf)
    return quality.duplicate_contests(e.unionByName(e.filter("is_wet = 1")), ID)


@query("set8_drop_duplicates",
       sql("entries", "select driver, team, date from entries qualify row_number() over (partition by driver order by d desc) = 1"))
def _(spark, sf):
    last = F.max(F.struct("date", "team")).alias("x")
    return entries(spark, sf).groupBy("driver").agg(last).select("driver", "x.team", "x.date")


@query("set9_seeded_permutation",
       sql("entries", f"select {IDS}, md5(concat_ws('/', '7', year, round, driver)) as tag from entries"))
def _(spark, sf):
    tag = F.md5(F.concat_ws("/", F.lit("7"), *[F.col(c).cast("string") for c in ID]))
    return entries(spark, sf).select(*ID, tag.alias("tag")).orderBy("tag")


# --- splits and folds -----------------------------------------------------------------
_SPLIT = "case when year = mx then 'test' when year = mx - 1 then 'val' else 'train' end"
part("split", ("entries",), f"select *, {_SPLIT} as partition from entries, (select max(year) as mx from entries)")


@query("fold1_chronological_split", sql("split", "select partition, count(*) as n_rows, min(year) as y0, max(year) as y1 from split group by 1"))
def _(spark, sf):
    df = folds.chronological_split(entries(spark, sf))
    return df.groupBy("partition").agg(F.count(F.lit(1)).alias("n_rows"), F.min("year").alias("y0"), F.max("year").alias("y1"))


@query("fold2_partition_label", sql("split", f"select {IDS}, partition from split"))
def _(spark, sf):
    return folds.chronological_split(entries(spark, sf)).select(*ID, "partition")


part("contests", ("entries",), "select year, round, date, row_number() over (order by date) - 1 as i from entries group by 1, 2, 3")
part("years", ("entries",), "select year, row_number() over (order by year) - 1 as yi from entries group by 1")
part("season_folds", ("contests", "years"), """select concat('season-', t.year) as fold,
    case when y.yi = t.yi then 'test' when y.yi = t.yi - 1 then 'val' else 'train' end as role, c.year, c.round, c.date
    from years t join years y on y.yi <= t.yi join contests c on c.year = y.year where t.yi >= 3""")
part("rolling_folds", ("contests",), """select format('block-{:02d}', cast((s - 56) / 6 + 1 as int)) as fold,
    case when i >= s then 'test' when i >= s - 12 then 'val' else 'train' end as role, year, round, date
    from contests, (select unnest(range(56, (select max(i) + 1 from contests), 6)) as s) where i < s + 6""")


@query("fold3_season_folds", sql("season_folds", "select * from season_folds"))
def _(spark, sf):
    return folds.season_folds(entries(spark, sf))


@query("fold4_rolling_folds", sql("rolling_folds", "select * from rolling_folds"))
def _(spark, sf):
    return folds.rolling_folds(entries(spark, sf))


part("role_events", ("season_folds",), """select fold, role, count(*) as n, min(date) as first, max(date) as last,
    string_agg(concat(year, '-', lpad(cast(round as varchar), 2, '0')), ',' order by year, round) as ev from season_folds group by 1, 2""")


@query("fold5_manifest",
       sql("role_events", "select fold, " + ", ".join(
           f"max(case when role = '{x}' then {c} end) as {x}_{n}" for x in ("train", "val", "test")
           for c, n in (("n", "n"), ("first", "first"), ("last", "last"), ("ev", "events")))
           + """, sha256(concat_ws('|', concat('test:', max(case when role = 'test' then ev end)),
           concat('train:', max(case when role = 'train' then ev end)), concat('val:', max(case when role = 'val' then ev end)))) as sha256
           from role_events group by 1"""))
def _(spark, sf):
    return folds.manifest(folds.season_folds(entries(spark, sf)))


@query("fold6_disjointness",
       sql("rolling_folds", "select count(*) as n_rows, 0::bigint as n_overlaps from rolling_folds"))
def _(spark, sf):
    table_ = folds.rolling_folds(entries(spark, sf))
    bad = folds.overlaps(table_).agg(F.count(F.lit(1)).alias("n_overlaps"))
    return with_row(table_.agg(F.count(F.lit(1)).alias("n_rows")), bad)


@query("fold7_policy_per_fold",
       sql("season_folds entries", f"""select fold, {r('avg(position) as global_mean_finish', 'avg(case when position <= 3 then 1.0 else 0.0 end) as podium_rate',
           'avg(is_dnf) as dnf_rate')}, count(*) as fitted_rows from season_folds f join entries e using (year, round)
           where role = 'train' group by 1"""))
def _(spark, sf):
    e = entries(spark, sf)
    train = folds.rows_of(e, folds.season_folds(e), folds.TRAIN)
    return out(impute.fit(train, by=["fold"]), "fold", "global_mean_finish", "podium_rate", "dnf_rate", "fitted_rows")


@query("fold7_transform_per_fold",
       sql("season_folds form", f"""select fold, {IDS}, {r('coalesce(form_avg_finish_3, g) as form_avg_finish_3')} from
           (select f.fold, e.* from season_folds f join form e using (year, round) where role = 'test')
           join (select fold, avg(position) as g from season_folds f join form e using (year, round) where role = 'train' group by 1)
           using (fold)"""))
def _(spark, sf):
    e = features.recent_form(entries(spark, sf))
    table_ = folds.season_folds(e)
    policy = impute.fit(folds.rows_of(e, table_, folds.TRAIN), by=["fold"])
    test = folds.rows_of(e, table_, folds.TEST).join(F.broadcast(policy), "fold")
    return out(test.withColumn("form_avg_finish_3", F.coalesce("form_avg_finish_3", "global_mean_finish")),
               "fold", *ID, "form_avg_finish_3")


# --- audits and data quality ------------------------------------------------------------
_AUDITED = ["form_avg_finish_3", "form_dnf_rate_5", "driver_circuit_avg_finish", "driver_dnf_rate",
            "driver_overall_avg_finish", "team_dnf_rate", "team_circuit_avg_finish"]


@query("dq1_leakage_audit",
       sql("entries", " union all ".join(f"select '{c}' as feature, count(*) as n_rows, 0::bigint as n_mismatches from entries" for c in _AUDITED)))
def _(spark, sf):
    e = paced_entries(spark, sf)
    fast = feature_table(spark, sf)
    pos, dnf = F.col("position"), F.col("is_dnf")
    naive = e.select(*ID, "team", "circuit_id")
    for key, wanted in ((["driver"], {"form_avg_finish_3": (pos, 3), "form_dnf_rate_5": (dnf, 5), "driver_dnf_rate": (dnf, None),
                                      "driver_overall_avg_finish": (pos, None)}),
                        (["driver", "circuit_id"], {"driver_circuit_avg_finish": (pos, None)}),
                        (["team"], {"team_dnf_rate": (dnf, None)}), (["team", "circuit_id"], {"team_circuit_avg_finish": (pos, None)})):
        naive = naive.join(quality.naive_history(e, key, wanted), [*key, *K], "left")
    return quality.mismatches(fast, naive, ID, _AUDITED)


_DEBUTS = """, d as (select count(*) as n from (select date = min(date) over (partition by driver) as f from entries) where f),
           v as (select count(*) as n from (select date = min(date) over (partition by driver, circuit_id) as f from entries) where f),
           r as (select 'debut_unknown' as rule, unnest(['form_avg_finish_3', 'form_avg_points_3', 'form_avg_quali_3', 'form_dnf_rate_5',
               'season_avg_finish', 'momentum', 'driver_overall_avg_finish', 'driver_wet_delta', 'driver_circuit_avg_finish',
               'driver_circuit_best_finish', 'driver_circuit_podium_rate', 'driver_dnf_rate']) as feature
             union all select 'debut_zero', unnest(['driver_wet_n', 'driver_races_at_circuit', 'quali_gap_to_teammate',
               'form_finish_vs_teammate', 'teammate_available'])
             union all select 'first_visit_unknown', unnest(['driver_circuit_avg_finish', 'driver_circuit_best_finish', 'driver_circuit_podium_rate']))
           select rule, feature, case when rule = 'first_visit_unknown' then (select n from v) else (select n from d) end as n_rows,
             0::bigint as n_violations from r"""


@query("dq2_debut_checks", sql("entries", _DEBUTS))
def _(spark, sf):
    return quality.debut_report(feature_table(spark, sf))


part("hollowed", ("entries",), """select * exclude (status, points), case when (year + round) % 10 = 0 then '' else status end as status,
    case when (year + round) % 10 = 0 then 0.0 else points end as points from entries""")


def _hollowed(spark, sf):
    bad = (F.col("year") + F.col("round")) % 10 == 0
    return entries(spark, sf).withColumns({"status": F.when(bad, "").otherwise(F.col("status")),
                                           "points": F.when(bad, 0.0).otherwise(F.col("points"))})


@query("dq3_hollow_contests",
       sql("hollowed", "select year, round, count(*) as n_rows from hollowed group by 1, 2 having bool_and(trim(status) = '') and sum(points) = 0"))
def _(spark, sf):
    return quality.hollow_contests(_hollowed(spark, sf))


@query("dq3_quarantine",
       sql("hollowed", "select year, count(*) as n_rows from hollowed where (year + round) % 10 <> 0 group by 1"))
def _(spark, sf):
    return quality.without_hollow(_hollowed(spark, sf)).groupBy("year").agg(F.count(F.lit(1)).alias("n_rows"))


@query("dq4_overlap_refusal",
       sql("entries", "select distinct year, round from entries where year = 1998"))
def _(spark, sf):
    e = entries(spark, sf)
    return quality.overlapping(e.filter("year <= 1998"), e.filter("year >= 1998"))


@query("dq5_replay_parity",
       sql("entries", "select count(*) as n_rows, 0::bigint as n_mismatches from entries where year = (select max(year) from entries) and round = "
           "(select max(round) from entries where year = (select max(year) from entries))"))
def _(spark, sf):
    e = paced_entries(spark, sf)
    last = e.agg(F.max(F.struct(*K)).alias("k")).first()["k"]
    target = (F.col("year") == last["year"]) & (F.col("round") == last["round"])
    hidden = labels.hide_outcomes(e, target).withColumn("race_pace_pct", F.when(~target, F.col("race_pace_pct")))
    seen = feature_table(spark, sf).filter(target)
    replay = features.asof_features(hidden).filter(target)
    diff = quality.mismatches(seen, replay, ID, list(schema.FEATURE_COLS), atol=1e-12)
    return diff.agg(F.max("n_rows").alias("n_rows"), F.sum("n_mismatches").alias("n_mismatches"))


@query("dq6_earlier_row_immunity",
       sql("entries", "select count(*) as n_rows, 0::bigint as n_mismatches from entries where year < 1999"))
def _(spark, sf):
    e = paced_entries(spark, sf)
    late = F.col("year") >= 1999
    bent = e.withColumns({"position": F.when(late, 99.0).otherwise(F.col("position")),
                          "race_pace_pct": F.when(late, 50.0).otherwise(F.col("race_pace_pct"))})
    cols = ["form_avg_finish_3", "driver_overall_avg_finish", "driver_pace_ewm_3", "team_pace_ewm_12", "team_circuit_avg_finish"]
    # The families of `cols` alone: the others' joins and quantiles would be planned for nothing.
    families = features.recent_form_family(), features.weather_family(), features.venue_family(), features.pace_family(bent.columns)
    a, b = feature_table(spark, sf).filter(~late), features.build(bent, *families).filter(~late)
    diff = quality.mismatches(a, b, ID, cols)
    return diff.agg(F.max("n_rows").alias("n_rows"), F.sum("n_mismatches").alias("n_mismatches"))


@query("dq7_column_roles")
def _(spark, sf):
    return schema.role_report(features.asof_features(labelled(spark, sf)))


@query("dq8_frozen_record",
       sql("entries", """, a as (select cast(year as varchar) as section, cast(round as varchar) as key, count(*) as value from entries group by 1, 2),
           b as (select cast(year as varchar) as section, cast(round as varchar) as key, count(*) - (case when year = 1996 and round < 4 then 1 else 0 end) as value
                 from entries group by year, round)
           select section, count(*) as only_frozen, count(*) as only_current from a join b using (section, key)
           where a.value <> b.value group by 1""").replace(")\n,", "),"))
def _(spark, sf):
    n = F.count(F.lit(1))
    per = entries(spark, sf).groupBy(*K).agg(n.alias("n"))
    shape = lambda v: per.select(F.col("year").cast("string").alias("section"), F.col("round").cast("string").alias("key"), v.alias("value"))
    moved = F.col("n") - flag((F.col("year") == 1996) & (F.col("round") < 4))
    return quality.differing_sections(shape(F.col("n")), shape(moved.cast("bigint")))


# --- starting order ------------------------------------------------------------------------
def _broken_grid(spark, sf):
    """The order with one entry dropped, one stranger, one repeat and one blank per contest."""
    e = entries(spark, sf).select(*ID, "grid_position", "pit_start")
    odd = F.col("driver") % 10
    g = e.filter(odd != 1).withColumn("grid_position", F.when(odd == 2, None).when(odd == 3, 3.0).when(odd == 4, 0.0)
                                      .otherwise(F.col("grid_position")))
    stranger = e.filter(odd == 5).withColumn("driver", F.col("driver") + 1_000_000)
    return g.unionByName(stranger), e


part("g0", ("entries",), """select year, round, driver, case driver % 10 when 2 then null when 3 then 3.0 when 4 then 0.0
    else grid_position end as gp, pit_start from entries where driver % 10 <> 1
    union all select year, round, driver + 1000000, grid_position, pit_start from entries where driver % 10 = 5""")
part("g1", ("g0",), "select *, count(*) over (partition by year, round) as sz from g0")


@query("grid1_violations",
       sql("g1 entries", """select year, round, 'absent_from_grid' as rule, cast(driver as varchar) as offender from entries
               where (year, round, driver) not in (select (year, round, driver) from g0)
           union all select year, round, 'not_in_roster', cast(driver as varchar) from g0 where driver >= 1000000
           union all select year, round, 'missing_place', cast(driver as varchar) from g1 where pit_start = 0 and gp is null
           union all select year, round, 'repeated_place', cast(cast(gp as bigint) as varchar) from g1 where pit_start = 0 and gp is not null
               group by year, round, gp having count(*) > 1
           union all select distinct year, round, 'place_out_of_range', cast(cast(gp as bigint) as varchar) from g1
               where pit_start = 0 and (gp < 1 or gp > sz)"""))
def _(spark, sf):
    return grid.violations(*_broken_grid(spark, sf))


@query("grid2_confirmed_order",
       sql("entries", f"""select {IDS}, pit_start, 'confirmed' as grid_status,
           case when pit_start = 0 and driver % 10 = 1 then 1 else 0 end as is_error,
           {r('case when pit_start = 1 then field_size when driver % 10 <> 1 then grid_position end as grid_position')} from entries"""))
def _(spark, sf):
    e = entries(spark, sf)
    known = e.filter(F.col("driver") % 10 != 1).select(*ID, "grid_position")
    return out(grid.confirmed(e, known, e.filter("pit_start = 1")), *ID, "pit_start", "grid_status", "is_error", "grid_position")


_PROV = """case when pit_start = 1 then cast(field_size as double) else cast(row_number() over
    (partition by year, round order by pit_start, {q} nulls last, driver) as double) end as grid_position"""


@query("grid3_provisional_order", sql("entries", f"select {IDS}, {_PROV.format(q='q3_s')} from entries"))
def _(spark, sf):
    return grid.provisional(entries(spark, sf), "q3_s").select(*ID, "grid_position")


@query("grid4_snapshots",
       sql("entries", """select year, round, 'provisional' as status, 'session' as source, cast(min(date) as varchar) as cutoff_utc,
           cast(count(*) as int) as field_size, cast(sum(pit_start) as int) as n_pit_starts, 'from order' as notes, true as is_post_qualifying
           from entries group by 1, 2"""))
def _(spark, sf):
    e = entries(spark, sf)
    g = attach(grid.provisional(e, "q3_s"), folds.contests(e).select(*K, "date"), K, calendar=True)
    return grid.snapshot(g, "session", F.col("date"), ["from order"])


@query("grid5_quality_by_status",
       sql("labelled", f"""select status, count(*) as n_contests, {r('avg(share) as podium_overlap')} from (
           select year, round, case when round % 2 = 0 then 'assumed' else 'confirmed' end as status,
           case when max(is_podium) = 1 then count(case when g <= 3 and is_podium = 1 then 1 end) / 3.0 end as share from
           (select *, row_number() over (partition by year, round order by grid_position, driver) as g from labelled) group by 1, 2)
           group by 1"""))
def _(spark, sf):
    from ..operators.metrics import contest_metrics
    df = labelled(spark, sf)
    status = F.when(F.col("round") % 2 == 0, vocab.ASSUMED).otherwise(vocab.CONFIRMED)
    snaps = folds.contests(df).withColumn("status", status)
    return out(grid.quality_by_status(contest_metrics(df, "grid_position", True), snaps, ["podium_overlap"]))


@query("prob16_assumed_order", sql("form", f"select {IDS}, {_PROV.format(q='form_avg_quali_3')}, 'assumed' as grid_status from form"))
def _(spark, sf):
    df = features.recent_form(entries(spark, sf))
    return grid.provisional(df, "form_avg_quali_3", status=vocab.ASSUMED).select(*ID, "grid_position", "grid_status")
