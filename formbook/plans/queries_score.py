"""Registered queries: scores, probabilities, evaluation, gates and forecast records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import folds, gates, metrics, probability, records, stats
from ..operators.grouping import with_row
from ..operators.labels import relevance
from ..sources import files, league
from ..sources.league import K, entries, labelled
from .oracle import part, r, sql
from .registry import out, query
from .tables import probability_table, scored_entries

ID = [*K, "driver"]
IDS = "year, round, driver"
# Draws of the queries on the exported probabilities; `prob5` takes the documented number, the operator's default.
DRAWS = 500
REPLICATES = vocab.BOOTSTRAP_REPLICATES
ORDERINGS = dict(zip(vocab.ORDERING_NAMES, (("grid_position", True), ("p_top10_clf", False), ("rank_score", False), ("blend_score", True)), strict=True))

part("scored0", ("labelled", "form"), """select l.*, -coalesce(form_avg_finish_3, 50.0) as rank_score,
    coalesce(form_avg_points_3, 0.0) as win_score, -coalesce(season_avg_finish, 50.0) as podium_score,
    1.0 / (1.0 + exp(coalesce(form_avg_finish_3, 50.0) / 20.0 - 1.0)) as p_top10_clf
    from labelled l join (select year, round, driver, form_avg_finish_3, form_avg_points_3, season_avg_finish from form) f
    using (year, round, driver)""")
part("scored", ("scored0",), """select *, 0.5 * g_rank + 0.5 * m_rank as blend_score from (select *,
    row_number() over (partition by year, round order by grid_position, driver) as g_rank,
    row_number() over (partition by year, round order by rank_score desc, grid_position, driver) as m_rank from scored0)""")
part("val", ("scored",), "select * from scored where year = (select max(year) - 1 from scored)")


def val_rows(spark, sf):
    df = folds.chronological_split(scored_entries(spark, sf))
    return df.filter(F.col("partition") == folds.VAL)


# --- blends --------------------------------------------------------------------------
@query("prob1_rank_blend", sql("scored", f"select {IDS}, {r('blend_score')} from scored"))
def _(spark, sf):
    return out(scored_entries(spark, sf), *ID, "blend_score")


part("alphas", (), "select i / 10.0 as alpha from range(11) t(i)")
part("blended", ("val", "alphas"), """select a.alpha, v.*, row_number() over (partition by a.alpha, year, round
    order by cast(a.alpha as double) * g_rank + (1 - cast(a.alpha as double)) * m_rank, grid_position, driver) as pr
    from val v cross join alphas a""")
part("alpha_contest", ("blended",), """select alpha, year, round, max(is_winner) as w, max(is_podium) as p,
    max(case when pr = 1 then is_winner end) as hit, count(case when pr <= 3 and is_podium = 1 then 1 end) / 3.0 as pod
    from blended group by 1, 2, 3""")
part("alpha_table", ("alpha_contest",), """select alpha, avg(case when w = 1 then hit end) as winner_accuracy,
    avg(case when p = 1 then pod end) as podium_overlap from alpha_contest group by 1""")


@query("join8_candidate_sweep", sql("alpha_table", f"select {r('alpha', 'winner_accuracy', 'podium_overlap')} from alpha_table"))
def _(spark, sf):
    return out(probability.alpha_table(val_rows(spark, sf), "rank_score"))


@query("prob2_select_alpha",
       sql("alpha_table", f"select {r('alpha')} from alpha_table order by winner_accuracy desc nulls last, podium_overlap desc nulls last, alpha desc limit 1"))
def _(spark, sf):
    return out(probability.select_alpha(probability.alpha_table(val_rows(spark, sf), "rank_score")))


part("alpha_rho", ("blended",), """select alpha, avg(rho) as spearman from (select alpha, year, round, corr(ra, rb) as rho from (
    select alpha, year, round, rank() over (partition by alpha, year, round order by pr) as ra,
    rank() over (partition by alpha, year, round order by result_order) as rb from blended where result_order is not null)
    group by 1, 2, 3) group by 1""")


@query("prob3_select_alpha_spearman",
       sql("alpha_rho", f"select {r('alpha', 'spearman')} from alpha_rho order by round(spearman, 9) desc, alpha limit 1"))
def _(spark, sf):
    return out(probability.select_alpha_spearman(val_rows(spark, sf), "rank_score"))


# --- probabilities ---------------------------------------------------------------------
def _softmax_sql(score, t):
    return f"exp(({score} - max({score}) over k) / {t}) / sum(exp(({score} - mx) / {t})) over k"


part("soft", ("scored",), """select *, exp((rank_score - mx) / 8.0) / sum(exp((rank_score - mx) / 8.0)) over (partition by year, round) as p_win
    from (select *, max(rank_score) over (partition by year, round) as mx from scored)""")


@query("prob4_contest_softmax", sql("soft", f"select {IDS}, {r('p_win')} from soft"))
def _(spark, sf):
    return out(probability.softmax(scored_entries(spark, sf), "rank_score", 8.0), *ID, "p_win")


def _draws(name, score, t, n=DRAWS):
    u = "(('0x' || substr(md5(concat_ws('/', '20260911', draw, year, round, driver)), 1, 8))::bigint + 0.5) / 4294967296.0"
    part(f"{name}_order", ("scored",), f"""select year, round, driver, draw, row_number() over (partition by year, round, draw
        order by {score} / {t} - ln(-ln({u})) desc, driver) as place
        from scored cross join (select cast(i + 1 as bigint) as draw from range({n}) t(i))""")
    part(f"{name}_share", (f"{name}_order",), f"""select year, round, driver,
        count(case when place <= 3 then 1 end) / {n}.0 as p_podium, count(case when place <= 10 then 1 end) / {n}.0 as p_top10
        from {name}_order group by 1, 2, 3""")


_draws("pl", "rank_score", "8.0")
_draws("plg", "-grid_position", "10.0")
_draws("plw", "rank_score", "8.0", vocab.PL_DRAWS)


def model_probabilities(spark, sf):
    return probability.plackett_luce(scored_entries(spark, sf), "rank_score", 8.0)


@query("prob5_plackett_luce",
       sql("soft plw_share", f"select {IDS}, {r('p_win', 'p_podium', 'p_top10')}, {r(f'sqrt(0.25 / {vocab.PL_DRAWS}) as mc_error')} from soft join plw_share using ({IDS})"))
def _(spark, sf):
    return out(model_probabilities(spark, sf), *ID, "p_win", "p_podium", "p_top10", "mc_error")


part("field1", ("soft",), "select year, round, driver, p_win as p from soft where is_wet = 1")


@query("prob6_exact_podium",
       sql("soft", f"""select a.year, a.round, a.driver, {r('''any_value(a.p_win) + sum(b.p_win * a.p_win / (1 - b.p_win)
           + b.p_win * a.p_win / (1 - b.p_win) * c.s2) as p_podium_exact''')}
           from soft a join soft b on a.year = b.year and a.round = b.round and a.driver <> b.driver
           join lateral (select sum(k.p_win / (1 - b.p_win - k.p_win)) as s2 from soft k where k.year = a.year
             and k.round = a.round and k.driver <> a.driver and k.driver <> b.driver) c on true group by 1, 2, 3"""))
def _(spark, sf):
    rows = probability.softmax(scored_entries(spark, sf), "rank_score", 8.0)
    return out(probability.exact_podium(rows), *ID, "p_podium_exact")


@query("prob7_winner_log_loss",
       sql("soft", f"select year, round, {r('-ln(greatest(p_win, 1e-15)) as winner_log_loss')} from soft where is_winner = 1"))
def _(spark, sf):
    return out(probability.winner_losses(probability.softmax(scored_entries(spark, sf), "rank_score", 8.0)))


part("temps", (), "select cast(i as int) as t_index, exp(ln(0.05) + (ln(20.0) - ln(0.05)) * i / 59.0) as temperature from range(60) t(i)")


def _temperature_parts(name, source, score):
    part(f"{name}_d", (source,), f"""select year, round, is_winner, {score} - max({score}) over (partition by year, round) as dd,
        max(is_winner) over (partition by year, round) as w from {source}""")
    part(f"{name}_loss", (f"{name}_d", "temps"), f"""select t_index, temperature, avg(l) as log_loss from (
        select t_index, temperature, year, round,
        -ln(greatest(max(case when is_winner = 1 then exp(dd / temperature) end) / sum(exp(dd / temperature)), 1e-15)) as l
        from {name}_d cross join temps where w = 1 group by 1, 2, 3, 4) group by 1, 2""")


_temperature_parts("tm", "val", "rank_score")
_temperature_parts("tg", "val", "-grid_position")
_BEST_T = "order by round(log_loss, 12), t_index limit 1"


@query("prob8_fit_temperature",
       sql("tm_loss", f"select t_index, t_index in (0, 59) as on_bound, {r('temperature', 'log_loss')} from tm_loss {_BEST_T}"))
def _(spark, sf):
    return out(probability.fit_temperature(probability.temperature_losses(val_rows(spark, sf), "rank_score")))


@query("prob9_uniform_log_loss",
       sql("labelled", f"select {r('avg(l) as uniform_log_loss')} from (select ln(count(*)) as l from labelled group by year, round having max(is_winner) = 1)"))
def _(spark, sf):
    return out(probability.uniform_losses(labelled(spark, sf)).agg(F.avg("uniform_log_loss").alias("uniform_log_loss")))


part("withpl", ("soft", "pl_share"), "select s.*, p_podium, p_top10 from soft s join pl_share using (year, round, driver)")


@query("prob10_podium_brier",
       sql("withpl", f"select {r('avg(b) as podium_brier')} from (select avg((p_podium - is_podium) * (p_podium - is_podium)) as b from withpl group by year, round)"))
def _(spark, sf):
    return out(probability.podium_briers(probability_table(spark, sf, DRAWS)).agg(F.avg("podium_brier").alias("podium_brier")))


_BENT = "select year, round, driver, p_win * 1.1 as p_win, p_podium, case when driver % 9 = 0 then p_podium / 2 else p_top10 end as p_top10 from withpl"


@query("prob11_coherence",
       sql("withpl", f""", bent as ({_BENT}), t as (select year, round, sum(p_win) as a, sum(p_podium) as b, sum(p_top10) as c,
           count(*) as n, max(p_win - p_podium) as x, max(p_podium - p_top10) as y from bent group by 1, 2)
           select year, round, 'sum_p_win' as rule, {r('a as total', '1.0 as expected')} from t where abs(a - 1) > 0.02
           union all select year, round, 'sum_p_podium', {r('b as total', 'least(3, n) as expected')} from t where abs(b - least(3, n)) > 0.02
           union all select year, round, 'sum_p_top10', {r('c as total', 'least(10, n) as expected')} from t where abs(c - least(10, n)) > 0.02
           union all select year, round, 'win_over_podium', {r('x as total', '0.0 as expected')} from t where x > 0.02
           union all select year, round, 'podium_over_top10', {r('y as total', '0.0 as expected')} from t where y > 0.02""").replace(")\n,", "),"))
def _(spark, sf):
    df = probability_table(spark, sf, DRAWS).withColumns({
        "p_win": F.col("p_win") * 1.1,
        "p_top10": F.when(F.col("driver") % 9 == 0, F.col("p_podium") / 2).otherwise(F.col("p_top10"))})
    return out(probability.coherence(df))


part("softg", ("soft",), """select *, exp((lo - grid_position) / 10.0) / sum(exp((lo - grid_position) / 10.0)) over (partition by year, round) as p_win_grid
    from (select *, min(grid_position) over (partition by year, round) as lo from soft)""")


@query("prob12_grid_baseline",
       sql("softg plg_share tg_loss", f"""select {IDS}, {r('p_win_grid', 'p_podium as p_podium_grid', 't as grid_temperature')} from softg join plg_share using ({IDS})
           cross join (select temperature as t from tg_loss {_BEST_T})"""))
def _(spark, sf):
    fitted = probability.fit_temperature(probability.temperature_losses(
        val_rows(spark, sf).withColumn("_u", -F.col("grid_position")), "_u"))
    rows = grid_probabilities(spark, sf, scored_entries(spark, sf))
    return out(with_row(rows, fitted.select(F.col("temperature").alias("grid_temperature"))),
               *ID, "p_win_grid", "p_podium_grid", "grid_temperature")


def grid_probabilities(spark, sf, rows):
    """Known-order probabilities next to the others."""
    base = rows.select(*ID, (-F.col("grid_position")).alias("_u"))
    pl = probability.plackett_luce(base, "_u", 10.0, DRAWS)
    return rows.join(pl.select(*ID, F.col("p_win").alias("p_win_grid"), F.col("p_podium").alias("p_podium_grid")), ID)


_Q = "greatest(least(p_top10_clf, 1 - 1e-6), 1e-6)"


@query("prob13_log_odds", sql("scored", f"select {IDS}, {r(f'ln({_Q} / (1.0 - {_Q})) as utility')} from scored"))
def _(spark, sf):
    return out(scored_entries(spark, sf).withColumn("utility", probability.log_odds("p_top10_clf")), *ID, "utility")


_Z = lambda c: f"coalesce(({c} - avg({c}) over k) / nullif(stddev_samp({c}) over k, 0), 0.0)"
part("zs", ("val",), f"""select *, {_Z('rank_score')} as z0, {_Z('win_score')} as z1, {_Z('podium_score')} as z2 from val
    window k as (partition by year, round)""")


@query("prob14_combined_utility", sql("zs", f"select {IDS}, {r('1.0 * z0 + 0.5 * z1 + 0.25 * z2 as utility')} from zs"))
def _(spark, sf):
    z = probability.standardise(val_rows(spark, sf), ["rank_score", "win_score", "podium_score"])
    w = {"rank_score_z": 1.0, "win_score_z": 0.5, "podium_score_z": 0.25}
    return out(z.withColumn("utility", probability.combine(w)), *ID, "utility")


part("pairs", (), "select a * 5 + b as w_index, a * 0.25 as w_win, b * 0.25 as w_pod from range(5) x(a), range(5) y(b)")
part("wd", ("zs", "pairs"), """select w_index, w_win, w_pod, year, round, is_winner, u - max(u) over (partition by w_index, year, round) as dd,
    max(is_winner) over (partition by w_index, year, round) as w from (select *, z0 + w_win * z1 + w_pod * z2 as u from zs cross join pairs)""")
part("wt", ("wd", "temps"), """select w_index, w_win, w_pod, t_index, temperature, avg(l) as log_loss from (
    select w_index, w_win, w_pod, t_index, temperature, year, round,
    -ln(greatest(max(case when is_winner = 1 then exp(dd / temperature) end) / sum(exp(dd / temperature)), 1e-15)) as l
    from wd cross join temps where w = 1 group by all) group by all""")


@query("prob15_select_weights",
       sql("wt", f"select {r('w_win', 'w_pod', 'temperature', 'log_loss')} from wt order by round(log_loss, 12), w_index, t_index limit 1"))
def _(spark, sf):
    z = probability.standardise(val_rows(spark, sf), ["rank_score", "win_score", "podium_score"])
    table = probability.weight_losses(z, "rank_score_z", ("win_score_z", "podium_score_z"))
    return out(probability.select_weights(table))


# --- evaluation -----------------------------------------------------------------------
_ORD = " union all ".join(
    f"select '{m}' as method, {'' if asc else '-'}{c} as s, * from scored" for m, (c, asc) in ORDERINGS.items())
part("long", ("scored",), _ORD)
part("placed", ("long",), "select *, row_number() over (partition by method, year, round order by s nulls last, grid_position, driver) as pr from long")
part("rho_all", ("placed",), """select method, year, round, corr(ra, rb) as spearman_all from (select method, year, round,
    rank() over k as ra, rank() over j + (count(*) over i - 1) / 2.0 as rb from placed where result_order is not null
    window k as (partition by method, year, round order by pr), j as (partition by method, year, round order by result_order),
    i as (partition by method, year, round, result_order)) group by 1, 2, 3""")
part("rho_fin", ("placed",), """select method, year, round, corr(ra, rb) as spearman_finishers from (select method, year, round,
    rank() over k as ra, rank() over j + (count(*) over i - 1) / 2.0 as rb from placed where result_order is not null and finished = 1
    window k as (partition by method, year, round order by pr), j as (partition by method, year, round order by result_order),
    i as (partition by method, year, round, result_order)) group by 1, 2, 3""")
part("hits", ("placed",), """select method, year, round,
    case when max(is_winner) = 1 then cast(max(case when pr = 1 then is_winner end) as double) end as winner_accuracy,
    case when max(is_podium) = 1 then count(case when pr <= 3 and is_podium = 1 then 1 end) / 3.0 end as podium_overlap,
    case when max(finished_top10) = 1 then count(case when pr <= 10 and finished_top10 = 1 then 1 end) / 10.0 end as top10_overlap,
    case when max(finished_top10) = 1 then cast(max(case when pr = 1 then finished_top10 end) as double) end as top_pick_finished_top10
    from placed group by 1, 2, 3""")
part("per", ("hits", "rho_all", "rho_fin"), """select * from hits left join rho_all using (method, year, round)
    left join rho_fin using (method, year, round)""")
METRICS = ", ".join(metrics.METRICS)
HEAD = list(metrics.HEADLINE)


def per_method(spark, sf):
    """Per-contest metrics of every ordering, exported once like the predictions."""
    return league.stored(spark, sf, "per_method",
                         lambda: metrics.orderings_metrics(scored_entries(spark, sf), ORDERINGS))


@query("eval1_contest_metrics", sql("per", f"select year, round, {r(METRICS)} from per where method = 'rank_model'"))
def _(spark, sf):
    return out(metrics.contest_metrics(scored_entries(spark, sf), "rank_score", False))


@query("eval2_spearman", sql("rho_all", f"select year, round, {r('spearman_all as rho')} from rho_all where method = 'grid_baseline'"))
def _(spark, sf):
    df = metrics.predicted_rank(scored_entries(spark, sf), "grid_position", True)
    return out(metrics.spearman(df, K, "pred_rank", "result_order", "rho"))


_POOL = ", ".join(f"avg({m}) as {m}" for m in metrics.METRICS)
_DEN = ", ".join(f"count({m}) as {n}" for n, m in metrics.DENOMINATORS.items())


@query("eval3_pooled_metrics",
       sql("per", f"select {r(*[f'avg({m}) as {m}' for m in metrics.METRICS])}, count(*) as n_contests, {_DEN} from per where method = 'rank_model'"))
def _(spark, sf):
    return out(metrics.pooled(metrics.contest_metrics(scored_entries(spark, sf), "rank_score", False)))


@query("agg13_two_level_mean",
       sql("per", f"select year, {r('avg(winner_accuracy) as winner_accuracy')}, count(winner_accuracy) as n from per where method = 'blend' group by 1"))
def _(spark, sf):
    per = metrics.contest_metrics(scored_entries(spark, sf), "blend_score", True)
    return out(per.groupBy("year").agg(F.avg("winner_accuracy").alias("winner_accuracy"), F.count("winner_accuracy").alias("n")))


@query("eval4_comparison_table",
       sql("per", f"select method, {r(*[f'avg({m}) as {m}' for m in metrics.METRICS])}, count(*) as n_contests, {_DEN} from per group by 1"))
def _(spark, sf):
    per = metrics.orderings_metrics(scored_entries(spark, sf), ORDERINGS)
    return out(metrics.pooled(per, ["method"]))


def _split_methods(spark, sf):
    per = per_method(spark, sf)
    return (per.filter(F.col("method") == "rank_model").drop("method"),
            per.filter(F.col("method") == "grid_baseline").drop("method"))


_DIFF = " union all ".join(f"""select '{m}' as metric, c.year, c.round, c.{m} - b.{m} as diff from per c join per b
    using (year, round) where c.method = 'rank_model' and b.method = 'grid_baseline' and c.{m} is not null and b.{m} is not null""" for m in HEAD)
part("diffs", ("per",), _DIFF.replace("c.year, c.round", "year, round"))
part("slots", ("diffs",), """select metric, diff, row_number() over (partition by metric order by year, round) - 1 as slot,
    count(*) over (partition by metric) as n from diffs""")


def _hash(*parts):
    return f"('0x' || substr(md5(concat_ws('/', '20260911', {', '.join(parts)})), 1, 8))::bigint"


def _boot(name, n):
    part(f"{name}_means", ("slots",), f"""select p.metric, rep, avg(s.diff) as m from (
        select metric, rep, {_hash('rep', 'slot')} % n as pick from slots cross join (select i + 1 as rep from range({n}) t(i))) p
        join slots s on s.metric = p.metric and s.slot = p.pick group by 1, 2""")
    part(f"{name}_ci", (f"{name}_means", "slots"), f"""select metric, n, md, lo, hi from (select metric, quantile_cont(m, 0.025) as lo,
        quantile_cont(m, 0.975) as hi from {name}_means group by 1) join (select metric, max(n) as n, avg(diff) as md from slots group by 1) using (metric)""")


_boot("full", vocab.BOOTSTRAP_REPLICATES)
_boot("quick", REPLICATES)


@query("eval5_paired_bootstrap",
       sql("full_ci", f"select metric, n as n_contests, {r('md as mean_difference', 'lo as ci_low', 'hi as ci_high')}, lo > 0 or hi < 0 as resolves from full_ci"))
def _(spark, sf):
    return out(stats.bootstrap(stats.paired(*_split_methods(spark, sf), HEAD)))


part("clusters", ("diffs",), """select metric, year, sum(diff) as s, count(*) as c, row_number() over (partition by metric order by year) - 1 as slot,
    count(*) over (partition by metric) as n from diffs group by metric, year""")


@query("eval6_cluster_bootstrap",
       sql("clusters diffs", f"""select metric, n_clusters, {r('md as mean_difference', 'lo as ci_low', 'hi as ci_high')} from (
           select metric, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from (
             select p.metric, rep, sum(s.s) / sum(s.c) as m from (select metric, rep, {_hash('rep', 'slot')} % n as pick from clusters
               cross join (select i + 1 as rep from range({REPLICATES}) t(i))) p join clusters s on s.metric = p.metric and s.slot = p.pick group by 1, 2)
           group by 1) join (select metric, max(n) as n_clusters from clusters group by 1) using (metric)
           join (select metric, avg(diff) as md from diffs group by 1) using (metric)"""))
def _(spark, sf):
    return out(stats.cluster_bootstrap(stats.paired(*_split_methods(spark, sf), HEAD), n=REPLICATES))


part("cells", ("per",), """select cast(c.winner_accuracy as int) as candidate_hit, cast(b.winner_accuracy as int) as baseline_hit, count(*) as n_contests
    from per c join per b using (year, round) where c.method = 'rank_model' and b.method = 'grid_baseline'
    and c.winner_accuracy is not null and b.winner_accuracy is not null group by 1, 2""")


@query("eval7_discordance", sql("cells", "select * from cells"))
def _(spark, sf):
    return stats.discordance(*_split_methods(spark, sf))


@query("eval7_mcnemar",
       sql("cells", f"""select a as only_candidate, b as only_baseline, {r('''least(1.0, 2 * (select sum(exp(lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1)
           - (a + b) * ln(2.0))) from (select unnest(range(0, least(a, b) + 1)) as k))) as p_value''')} from (select
           cast(coalesce(sum(case when candidate_hit = 1 and baseline_hit = 0 then n_contests end), 0) as int) as a,
           cast(coalesce(sum(case when candidate_hit = 0 and baseline_hit = 1 then n_contests end), 0) as int) as b from cells)"""))
def _(spark, sf):
    return out(stats.mcnemar(stats.discordance(*_split_methods(spark, sf))))


part("signed", ("diffs",), """select metric, diff, rank() over (partition by metric order by a) + (count(*) over (partition by metric, a) - 1) / 2.0 as rk
    from (select *, round(abs(diff), 12) as a from diffs) where a > 0""")


@query("eval8_wilcoxon",
       sql("signed", f"""select metric, count(*) as n, {r('sum(case when diff > 0 then rk else 0 end) as w_plus',
           'sum(case when diff < 0 then rk else 0 end) as w_minus',
           '(sum(case when diff > 0 then rk else 0 end) - sum(case when diff < 0 then rk else 0 end)) / sqrt(sum(rk * rk)) as z')} from signed group by 1"""))
def _(spark, sf):
    return out(stats.wilcoxon(stats.paired(*_split_methods(spark, sf), HEAD)))


part("one", ("quick_ci",), """select max(case when metric = 'winner_accuracy' then md end) as w, max(case when metric = 'podium_overlap' then md end) as p,
    max(case when metric = 'top10_overlap' then md end) as t, max(case when metric = 'spearman_all' then md end) as s,
    max(case when metric = 'winner_accuracy' then n end) as n,
    bool_or(case when metric = 'winner_accuracy' then lo > 0 or hi < 0 end) as res from quick_ci""")
_GATES = [("winner_gain", "w", "0.05", "w >= 0.05"), ("podium_gain", "p", "0.03", "p >= 0.03"), ("top10_guard", "t", "-0.02", "t >= -0.02"),
          ("spearman_guard", "s", "-0.02", "s >= -0.02"), ("folds", "4", "3", "true"), ("contests", "n", "60", "n >= 60"),
          ("winner_gain_resolves", "cast(res as int)", "1", "res")]


@query("eval9_promotion_gates",
       sql("one", " union all ".join(f"select '{g}' as gate, {r(f'{v} as value', f'{t} as threshold')}, coalesce({c}, false) as passed from one" for g, v, t, c in _GATES)))
def _(spark, sf):
    n_folds = folds.season_folds(entries(spark, sf)).agg(F.count_distinct("fold").alias("n_folds"))
    ci = stats.bootstrap(stats.paired(*_split_methods(spark, sf), HEAD), n=REPLICATES)
    return out(gates.promotion(ci, n_folds))


part("paired_p", ("softg", "pl_share", "plg_share"), """select s.*, a.p_podium, a.p_top10, b.p_podium as p_podium_grid from softg s
    join pl_share a using (year, round, driver) join plg_share b using (year, round, driver)""")
part("losses", ("paired_p",), """select year, round, -ln(greatest(max(case when is_winner = 1 then p_win end), 1e-15)) as lm,
    -ln(greatest(max(case when is_winner = 1 then p_win_grid end), 1e-15)) as lg,
    avg((p_podium - is_podium) * (p_podium - is_podium)) as bm, avg((p_podium_grid - is_podium) * (p_podium_grid - is_podium)) as bg,
    ln(count(*)) as lu from paired_p group by 1, 2 having max(is_winner) = 1""")
part("broken", ("paired_p",), """select (abs(sum(p_win) - 1) > 0.02)::int + (abs(sum(p_podium) - least(3, count(*))) > 0.02)::int
    + (abs(sum(p_top10) - least(10, count(*))) > 0.02)::int + (max(p_win - p_podium) > 0.02)::int + (max(p_podium - p_top10) > 0.02)::int as k
    from paired_p group by year, round""")
_PG = [("log_loss_beats_grid", "l", "0", "l < 0"), ("podium_brier_guard", "b", "0.01", "b <= 0.01"), ("coherent", "k", "0", "k = 0"),
       ("beats_uniform", "u", "0", "u < 0")]


@query("eval10_probability_gates",
       sql("losses broken", "select gate, " + r("value", "threshold") + ", passed from (" + " union all ".join(
           f"select '{g}' as gate, {v} as value, {t} as threshold, {c} as passed from agg" for g, v, t, c in _PG)
           + ")").replace("\nselect gate", ", agg as (select avg(lm - lg) as l, avg(bm - bg) as b, (select sum(k) from broken) as k, avg(lm) - avg(lu) as u from losses)\nselect gate"))
def _(spark, sf):
    df = probability_table(spark, sf, DRAWS)
    return out(gates.probability_gates(df, n=REPLICATES))


@query("eval10_favourite_calibration",
       sql("soft", f"""select {r('avg(p_win) as mean_favourite_p', 'avg(is_winner) as favourite_won')} from (select * from soft
           qualify row_number() over (partition by year, round order by p_win desc, grid_position, driver) = 1)"""))
def _(spark, sf):
    return out(gates.calibration(probability.softmax(scored_entries(spark, sf), "rank_score", 8.0)))


_UNPIV = " union all ".join(f"select method, year, round, '{m}' as metric, {m} as v from per" for m in HEAD)
part("flat", ("per",), _UNPIV)
part("fslots", ("flat",), """select *, row_number() over (partition by method, metric order by year, round) - 1 as slot, count(*) over (partition by method, metric) as n
    from (select c.method, c.metric, c.year, c.round, c.v - b.v as diff from flat c join flat b on c.year = b.year and c.round = b.round
          and c.metric = b.metric and b.method = 'grid_baseline' where c.method <> 'grid_baseline' and c.v is not null and b.v is not null)""")
part("fci", ("fslots",), f"""select method, metric, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from (
    select p.method, p.metric, rep, avg(s.diff) as m from (select method, metric, rep, {_hash('rep', 'slot')} % n as pick from fslots
    cross join (select i + 1 as rep from range({REPLICATES}) t(i))) p join fslots s on s.method = p.method and s.metric = p.metric and s.slot = p.pick
    group by 1, 2, 3) group by 1, 2""")


@query("eval11_gate_summary",
       sql("flat fslots fci", f"""select a.method, a.metric, {r('a.pooled as pooled', 'md as mean_difference', 'lo as ci_low', 'hi as ci_high')},
           n as n_contests, lo > 0 or hi < 0 as resolves from (select method, metric, avg(v) as pooled from flat group by 1, 2) a
           left join (select method, metric, avg(diff) as md, max(n) as n from fslots group by 1, 2) d using (method, metric)
           left join fci using (method, metric)"""))
def _(spark, sf):
    return out(gates.gate_summary(per_method(spark, sf), "grid_baseline", n=REPLICATES))


@query("agg14_window_slices",
       sql("diffs", f"""select metric, slice, {r('avg(diff) as mean_difference')}, count(*) as n_contests from (
           select metric, diff, cast(year as varchar) as slice from diffs union all select metric, diff, 'all' from diffs
           union all select metric, diff, 'recent' from diffs where year >= 1999) group by 1, 2"""))
def _(spark, sf):
    diff = stats.paired(*_split_methods(spark, sf), HEAD)
    return out(stats.window_slices(diff, {"recent": (1999, 2100)}))


@query("agg15_slot_reliability",
       sql("soft", f"select {r('grid_position', 'avg(is_winner) as win_rate', 'avg(p_win) as mean_p')}, count(*) as n_rows from soft group by grid_position"))
def _(spark, sf):
    return out(metrics.slot_reliability(probability.softmax(scored_entries(spark, sf), "rank_score", 8.0)))


part("slot_rates", ("labelled",), """select grid_position, (sum(is_winner) + 0.5) / (count(*) + 1.0) as rate from labelled
    where year <= (select max(year) - 2 from labelled) group by 1""")


@query("agg17_slot_baseline",
       sql("slot_rates labelled", f"""select {IDS}, {r('rate / sum(rate) over (partition by year, round) as p_win')} from (
           select l.*, coalesce(rate, 0.25) as rate from labelled l left join slot_rates using (grid_position)
           where year = (select max(year) from labelled))"""))
def _(spark, sf):
    df = folds.chronological_split(labelled(spark, sf))
    train, test = (df.filter(F.col("partition") == p) for p in (folds.TRAIN, folds.TEST))
    return out(metrics.slot_baseline(train, test), *ID, "p_win")


_P = "p_top10_clf"
_CLIPPED = f"greatest(least({_P}, 1 - 2.220446049250313e-16), 2.220446049250313e-16)"


@query("eval12_classifier_metrics",
       sql("scored", f"""select {r('accuracy', 'roc_auc', 'average_precision', 'log_loss', 'brier')}, true_pos, false_pos, false_neg, true_neg from
           (select avg(case when ({_P} >= 0.5) = (finished_top10 = 1) then 1.0 else 0.0 end) as accuracy,
            avg(case when finished_top10 = 1 then -ln({_CLIPPED}) else -ln(1 - {_CLIPPED}) end) as log_loss,
            avg(({_P} - finished_top10) * ({_P} - finished_top10)) as brier,
            count(case when {_P} >= 0.5 and finished_top10 = 1 then 1 end) as true_pos, count(case when {_P} >= 0.5 and finished_top10 = 0 then 1 end) as false_pos,
            count(case when {_P} < 0.5 and finished_top10 = 1 then 1 end) as false_neg, count(case when {_P} < 0.5 and finished_top10 = 0 then 1 end) as true_neg from scored),
           (select (sum(case when finished_top10 = 1 then rk end) - n1 * (n1 + 1) / 2.0) / (n1 * n0) as roc_auc from (
             select finished_top10, rank() over (order by {_P}) + (count(*) over (partition by {_P}) - 1) / 2.0 as rk,
             sum(finished_top10) over () as n1, sum(1 - finished_top10) over () as n0 from scored) group by n1, n0),
           (select sum(pos / tot * cp / (cp + cn)) as average_precision from (select pos, sum(pos) over () as tot,
             sum(pos) over (order by s desc) as cp, sum(neg) over (order by s desc) as cn from (
             select {_P} as s, cast(sum(finished_top10) as double) as pos, cast(sum(1 - finished_top10) as double) as neg from scored group by 1)))"""))
def _(spark, sf):
    return out(metrics.classifier_metrics(scored_entries(spark, sf), _P, "finished_top10"))


@query("eval13_row_order_invariance",
       "select " + ", ".join(f"0.0::double as {m}" for m in metrics.METRICS))
def _(spark, sf):
    return out(metrics.invariance(scored_entries(spark, sf), "rank_score", False))


part("grades", ("scored", "graded"), "select s.*, relevance from scored s join (select year, round, driver, relevance from graded) using (year, round, driver)")
part("ideal", ("grades",), """select *, row_number() over (partition by year, round order by rank_score desc nulls last, grid_position, driver) as pr,
    row_number() over (partition by year, round order by relevance desc, driver) as ideal,
    pow(2.0::double, relevance - best) - pow(2.0::double, -best) as gain
    from (select *, max(relevance) over (partition by year, round) as best from grades)""")
_NDCG = [f"sum(case when pr <= {k} then gain / log2(1.0 + pr) end) / nullif(sum(case when ideal <= {k} then gain / log2(1.0 + ideal) end), 0) as ndcg_{k}" for k in (1, 3, 10)]


@query("eval15_further_metrics",
       sql("ideal", f"""select year, round, {r('avg(case when finished = 1 then case when pr = result_order then 1.0 else 0.0 end end) as exact_rate',
           'avg(case when finished = 1 then abs(pr - result_order) end) as place_mae', *_NDCG)} from ideal group by 1, 2"""))
def _(spark, sf):
    return out(metrics.further_metrics(relevance(scored_entries(spark, sf)), "rank_score", False))


_CORR = ["grid_position", "rank_score", "win_score"]


@query("eval16_outcome_correlations",
       sql("scored", " union all ".join(f"""select '{c}' as feature, {r('w as overall', 'm as within')} from (select corr({c}, result_order) as w from scored),
           (select avg(x) as m from (select case when min(y) < max(y) and min(z) < max(z) then corr(y, z) end as x from
             (select year, round, {c} as y, result_order as z from scored where {c} is not null and result_order is not null) group by year, round))""" for c in _CORR)))
def _(spark, sf):
    return out(metrics.outcome_correlations(scored_entries(spark, sf), _CORR, "result_order"))


# --- records ---------------------------------------------------------------------------
part("fr", ("forecasts", "results"), """select f.*, x.result_order, x.is_winner, x.is_podium, x.finished_top10,
    row_number() over (partition by year, round order by f.grid_position, driver) as g from forecasts f
    left join (select year, round, driver, result_order, is_winner, is_podium, finished_top10 from results) x using (year, round, driver)
    where (year, round) in (select (year, round) from results where is_winner = 1)""")
part("fr_rho", ("fr",), """select year, round, corr(ra, rb) as spearman from (select year, round, rank() over (partition by year, round order by pred_finish_rank) as ra,
    rank() over (partition by year, round order by result_order) as rb from fr where result_order is not null) group by 1, 2""")
part("fr_score", ("fr", "fr_rho"), """select * from (select year, round, max(event_name) as event_name, max(grid_status) as grid_status,
    count(*) - count(result_order) as drivers_unmatched, coalesce(max(case when pred_finish_rank = 1 then is_winner end), 0) as winner_hit,
    coalesce(max(case when g = 1 then is_winner end), 0) as grid_winner_hit,
    count(case when pred_finish_rank <= 3 and is_podium = 1 then 1 end) / 3.0 as podium_overlap,
    count(case when g <= 3 and is_podium = 1 then 1 end) / 3.0 as grid_podium_overlap,
    count(case when pred_finish_rank <= 10 and finished_top10 = 1 then 1 end) / 10.0 as top10_overlap,
    -ln(greatest(coalesce(max(case when is_winner = 1 then p_win end), 0), 1e-15)) as winner_log_loss, ln(count(*)) as uniform_log_loss,
    avg((p_podium - coalesce(is_podium, 0)) * (p_podium - coalesce(is_podium, 0))) as podium_brier from fr group by 1, 2) join fr_rho using (year, round)""")
_SCORE = "podium_overlap, grid_podium_overlap, top10_overlap, winner_log_loss, uniform_log_loss, podium_brier, spearman"
SCORE_COLS = [*K, "event_name", "grid_status", "drivers_unmatched", "winner_hit", "grid_winner_hit", *_SCORE.split(", ")]


def scored_records(spark, sf):
    return records.score(league.forecasts(spark, sf), league.results(spark, sf))


@query("rec1_archive_nested",
       sql("forecasts", f"""select year, round, event_name, cast(count(*) as int) as field_size, cast(sum(pit_start) as int) as n_pit_starts,
           count(*) as n_predictions, {r('sum(p_win) as p_total')} from forecasts group by 1, 2, 3"""))
def _(spark, sf):
    from .queries_base import archived
    path = archived(spark, sf)
    sums = files.read_predictions(spark, path).groupBy(*K).agg(F.count(F.lit(1)).alias("n_predictions"), F.sum("p_win").alias("p_total"))
    heads = files.read_forecasts(spark, path).select("event.year", "event.round", "event.event_name", F.col("grid.field_size").cast("int").alias("field_size"),
                                                     "grid.n_pit_starts")
    return out(heads.join(sums, K))


@query("rec2_score_forecasts", sql("fr_score", f"select year, round, event_name, grid_status, drivers_unmatched, winner_hit, grid_winner_hit, {r(_SCORE)} from fr_score"))
def _(spark, sf):
    return out(scored_records(spark, sf), *SCORE_COLS)


@query("rec2_pending",
       sql("forecasts results", "select distinct year, round from forecasts where (year, round) not in (select (year, round) from results where is_winner = 1)"))
def _(spark, sf):
    return records.pending(league.forecasts(spark, sf), league.results(spark, sf))


@query("rec3_cumulative_summary",
       sql("fr_score", f"""select count(*) as n_contests, {r('avg(winner_hit) as winner_accuracy', 'avg(grid_winner_hit) as grid_winner_accuracy',
           *[f'avg({c}) as {c}' for c in _SCORE.split(', ')])} from fr_score where (year * 12 + round) % 5 <> 0"""))
def _(spark, sf):
    flags = records.late_flags(league.forecasts(spark, sf), league.schedule(spark, sf)).filter("is_late")
    return out(records.summarise(scored_records(spark, sf), flags))


part("official_order", ("results",), """select year, round, driver, row_number() over (partition by year, round order by result_order, driver) as f
    from results where regexp_full_match(classified_position_raw, '[0-9]+')""")
part("bd", ("forecasts", "official_order"), """select p.year, p.round, p.driver, pred_finish_rank as m, f,
    row_number() over (partition by p.year, p.round order by grid_position, p.driver) as g from forecasts p
    left join official_order o on p.year = o.year and p.round = o.round and p.driver = o.driver""")
part("board", ("bd",), """select year, round, max(case when m = 1 then driver end) as pick, max(case when f = 1 then driver end) as winner,
    max(case when m = 1 and f = 1 then 1 else 0 end) as model_win, max(case when g = 1 and f = 1 then 1 else 0 end) as grid_win,
    count(case when m <= 3 and f <= 3 then 1 end) as model_podium, count(case when g <= 3 and f <= 3 then 1 end) as grid_podium,
    count(case when m <= 10 and f <= 10 then 1 end) as model_top10, count(case when g <= 10 and f <= 10 then 1 end) as grid_top10
    from bd group by 1, 2 having count(f) > 0""")


def _board(spark, sf):
    return records.season_board(league.forecasts(spark, sf), league.results(spark, sf))


@query("rec4_season_board", sql("board", "select * from board"))
def _(spark, sf):
    return _board(spark, sf)


@query("agg16_board_totals",
       sql("board", """select coalesce(cast(year as varchar), 'total') as year, count(*) as n_contests, """ + ", ".join(
           f"cast(sum({c}) as bigint) as {c}" for c in "model_win grid_win model_podium grid_podium model_top10 grid_top10".split())
           + " from board group by rollup (year)"))
def _(spark, sf):
    return records.board_totals(_board(spark, sf))


def _pct_sql(p):
    return f"""case when {p} >= 1.0 then '100%' when {p} >= 0.9995 then '>99.9%' when {p} < 0.0005 then '<0.1%'
        else format('{{:.1f}}%', {p} * 100) end"""


@query("rec5_prediction_table",
       sql("forecasts", f"""select year, round, pred_finish_rank, driver, cast(team as varchar) as team, concat('P', cast(grid_position as int)) as grid,
           {_pct_sql('round(p_win, 6)')} as win, {_pct_sql('round(p_podium, 6)')} as podium, {_pct_sql('round(p_top10, 6)')} as top10 from forecasts"""))
def _(spark, sf):
    rows = league.forecasts(spark, sf).withColumns({c: F.round(c, 6) for c in ("p_win", "p_podium", "p_top10")})
    return records.prediction_table(rows)


@query("rec5_result_table",
       sql("results forecasts", f"""select {IDS}, case when classified_position_raw is null or classified_position_raw = 'R' then 'DNF'
           when classified_position_raw = 'N' then 'NC' else classified_position_raw end as pos,
           case when x.pit_start = 1 then 'Pit' else concat('P', cast(x.grid_position as int)) end as grid, concat('P', pred_finish_rank) as predicted,
           case when v is null then '' when v = 0 then '=' when v > 0 then concat('▲', v) else concat('▼', -v) end as delta
           from (select x.*, pred_finish_rank, pred_finish_rank - try_cast(x.classified_position_raw as int) as v from results x
           left join (select year, round, driver, pred_finish_rank from forecasts) f using ({IDS})) x"""))
def _(spark, sf):
    return records.result_table(league.forecasts(spark, sf), league.results(spark, sf))
