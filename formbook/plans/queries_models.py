"""Registered queries: models, bundles and forecasts (mostly rows-only checks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, folds, grid, impute, models
from ..operators.grouping import with_row
from ..session import materialise, scratch_path
from ..sources.league import K, paced_entries, stored
from .oracle import part, r, sql
from .queries_base import next_contest
from .registry import out, query
from .tables import training_table

ID = [*K, "driver"]


def _parts(spark, sf):
    """Imputed train, validation and test rows of the chronological split."""
    pre = training_table(spark, sf)
    policy = impute.fit(pre.filter(F.col("partition") == folds.TRAIN))
    filled = stored(spark, sf, "filled", lambda: impute.transform(pre, policy))
    return tuple(filled.filter(F.col("partition") == p) for p in (folds.TRAIN, folds.VAL, folds.TEST))


@query("ml1_top10_classifier")
def _(spark, sf):
    train, val, test = _parts(spark, sf)
    model = models.fit_classifier(train, val, "finished_top10")
    return out(models.with_probability(model, test, "p_top10_clf"), *ID, "finished_top10", "p_top10_clf")


@query("ml2_contest_ranker")
def _(spark, sf):
    train, _, test = _parts(spark, sf)
    return out(models.with_rank_score(models.fit_ranker(train), test), *ID, "result_order", "rank_score")


part("cls", ("labelled",), """select year, round, driver, grid_position, row_number() over (partition by year, round order by result_order, driver) as pl
    from labelled where officially_classified = 1 and year <= (select max(year) - 2 from labelled)""")


@query("join11_comparison_pairs",
       sql("cls", f"""select year, round, cast(a.pl + o as int) as at_place, o as offset_places, {r('a.grid_position - b.grid_position as grid_gap')}
           from cls a cross join (select unnest([1, 2, 4, 8, 16]) as o) join cls b using (year, round) where b.pl = a.pl + o"""))
def _(spark, sf):
    train, _, _ = _parts(spark, sf)
    return out(models.comparison_pairs(train), *K, F.col("_at").alias("at_place"), F.col("_offset").alias("offset_places"),
               F.col("in_grid_position").alias("grid_gap"))


@query("ml2_grade_challenger")
def _(spark, sf):
    train, _, test = _parts(spark, sf)
    return out(models.with_grade(models.fit_grade_ranker(train), test), *ID, "relevance", "rank_score")


@query("ml3_specialist_heads")
def _(spark, sf):
    from ..operators.probability import log_odds
    train, val, test = _parts(spark, sf)
    for head, label in (("winner_head", "is_winner"), ("podium_head", "is_podium")):
        model = models.fit_classifier(train, val, label, balanced=True)
        test = models.with_probability(model, test, head)
    test = materialise(test, "heads").withColumns({h: log_odds(h) for h in ("winner_head", "podium_head")})
    return out(test, *ID, "winner_head", "podium_head")


@query("ml4_bounded_search")
def _(spark, sf):
    return out(_search(spark, sf))


def _search(spark, sf):
    def build():
        train, val, _ = _parts(spark, sf)
        return models.search(train, val)
    return stored(spark, sf, "search", build)


@query("ml4_search_facts",
       "select 9::bigint as n_configs, 1::bigint as n_chosen, 0::bigint as n_better, 0::bigint as n_outside")
def _(spark, sf):
    """What holds for any search: each configuration judged once, one chosen, none better and none equal before it."""
    table = _search(spark, sf)
    won = table.filter("chosen").select(F.col("ndcg_3").alias("_s"), F.col("config").alias("_c"))
    better = (F.col("ndcg_3") > F.col("_s")) | ((F.col("ndcg_3") == F.col("_s")) & (F.col("config") < F.col("_c")))
    inside = F.coalesce((F.col("ndcg_3") >= 0) & (F.col("ndcg_3") <= 1 + 1e-9), F.lit(False))
    return with_row(table, won).agg(F.count_distinct("config").alias("n_configs"), F.count_if("chosen").alias("n_chosen"),
                                    F.count_if(better).alias("n_better"), F.count_if(~inside).alias("n_outside"))


@query("ml4_tuned_ranker")
def _(spark, sf):
    """The grade ranker in the chosen configuration, on the test year."""
    train, _, test = _parts(spark, sf)
    best = _search(spark, sf).filter("chosen").first()
    model = models.fit_grade_ranker(train, **models.SEARCH[best["config"]])
    return out(models.with_grade(model, test), *ID, "relevance", "rank_score")


def _predictions(spark, sf):
    def build():
        pre = training_table(spark, sf)
        return models.run_folds(pre, folds.season_folds(pre))
    return stored(spark, sf, "fold_predictions", build)


@query("ml5_fold_runner")
def _(spark, sf):
    return out(_predictions(spark, sf))


part("held", ("entries",), """select year, row_number() over (order by year) as i, count(*) as n_rows, count(distinct round) as n_contests
    from entries group by year""")


@query("ml5_fold_facts",
       sql("held", """select concat('season-', year) as fold, n_rows, n_contests, cast(n_contests as double) as p_win_total, cast(n_contests as double) as p_win_grid_total,
           0::bigint as n_outside, 1::bigint as n_choices, true as choices_in_grids from held where i > 3"""))
def _(spark, sf):
    """What holds for any fit: each test row once, probabilities that add up and stay in bounds, choices from the grids."""
    from ..functions import vocab
    from ..operators.probability import temperature_grid
    chances = ("p_top10_clf", "p_winner_head", "p_podium_head", "p_win", "p_podium", "p_top10", "p_win_grid", "p_podium_grid")
    inside = [F.coalesce((F.col(c) >= 0) & (F.col(c) <= 1 + 1e-9), F.lit(False)) for c in chances]
    swept = (F.col("alpha").isin(*map(float, vocab.ALPHA_GRID)) & F.col("w_win").isin(*map(float, vocab.WEIGHT_GRID))
             & F.col("w_pod").isin(*map(float, vocab.WEIGHT_GRID))
             & F.col("temperature").isin(*temperature_grid()) & F.col("grid_temperature").isin(*temperature_grid()))
    choice = F.struct("alpha", "w_win", "w_pod", "temperature", "grid_temperature")
    return out(_predictions(spark, sf).groupBy("fold").agg(
        F.count_distinct(*ID).alias("n_rows"), F.count_distinct(*K).alias("n_contests"), F.sum("p_win").alias("p_win_total"),
        F.sum("p_win_grid").alias("p_win_grid_total"), F.count(F.when(~F.forall(F.array(*inside), lambda x: x), 1)).alias("n_outside"),
        F.count_distinct(choice).alias("n_choices"), F.bool_and(swept).alias("choices_in_grids")))


@query("ml5_fold_gates")
def _(spark, sf):
    from ..operators import gates
    return out(gates.probability_gates(_predictions(spark, sf)))


@query("eval14_feature_importance")
def _(spark, sf):
    train, val, _ = _parts(spark, sf)
    return out(models.importances(models.fit_classifier(train, val, "finished_top10"), spark))


def _bundle(spark, sf):
    """Bundle trained on all contests, refitted once per session."""
    path = scratch_path(spark, "bundle")
    return stored(spark, sf, "bundle", lambda: models.develop_and_refit(training_table(spark, sf), path))


@query("ml6_develop_then_refit")
def _(spark, sf):
    return out(_bundle(spark, sf).drop("path").select("*", "validation.*").drop("validation"))


@query("ml6_validation_facts",
       sql("labelled", f"""select cast(max(year) as int) as val_season, count(*) as n_val_contests, {r('avg(case when w = 1 then ln(n) end) as uniform_log_loss')},
           true as frozen_in_grid, true as metrics_inside from (select year, round, count(*) as n, max(is_winner) as w from labelled
           where year = (select max(year) - 1 from labelled) group by year, round)"""))
def _(spark, sf):
    """What holds for any bundle: its validation year, the loss of a uniform guess, counts from the grid, metrics in bounds."""
    v = lambda c: F.col(f"validation.{c}")
    shares = [v(c).between(0, 1 + 1e-9) for c in ("ndcg_3", "winner_accuracy", "podium_overlap", "top10_overlap")]
    inside = F.forall(F.array(*shares, v("spearman_all").between(-1 - 1e-9, 1 + 1e-9), v("winner_log_loss") >= 0), lambda x: x)
    return out(_bundle(spark, sf).select(
        v("val_season").alias("val_season"), v("n_val_contests").alias("n_val_contests"), v("uniform_log_loss").alias("uniform_log_loss"),
        F.col("iterations").isin(*models.ITERATIONS).alias("frozen_in_grid"), F.coalesce(inside, F.lit(False)).alias("metrics_inside")))


@query("ml7_bundle_manifest",
       sql("entries", """select 1 as bundle_version, cast(max(date) as timestamp) as cutoff, count(*) as n_train_rows,
           count(distinct (year, round)) as n_train_contests, min(year) as train_year_min, max(year) as train_year_max,
           38::bigint as n_features, 0::bigint as n_problems from entries"""))
def _(spark, sf):
    m = _bundle(spark, sf)
    problems = models.manifest_problems(m).agg(F.count(F.lit(1)).alias("n_problems"))
    return with_row(m.select("bundle_version", F.col("training_cutoff_utc").cast("timestamp_ntz").alias("cutoff"), "n_train_rows", "n_train_contests",
                    "train_year_min", "train_year_max", F.size("feature_cols").cast("bigint").alias("n_features")), problems)


@query("ml8_cutoff_guard",
       sql("contests", """select c.year, c.round, case when max(b.year) is not null then concat('bundle-', max(b.year)) end as bundle
           from contests c left join (select year, max(date) as cutoff from contests group by 1) b on b.cutoff < c.date group by 1, 2"""))
def _(spark, sf):
    table = folds.contests(paced_entries(spark, sf))
    seasons = table.groupBy("year").agg(F.max("date").cast("timestamp").alias("training_cutoff_utc")).select(
        "training_cutoff_utc", F.concat(F.lit("bundle-"), F.col("year").cast("string")).alias("path"))
    return models.usable_bundles(table, seasons)


def _forecast(spark, sf):
    history, future = next_contest(spark, sf)
    year, rnd = future.select(*K).first()
    rows = features.asof_features(history, future).filter((F.col("year") == year) & (F.col("round") == rnd))
    order = grid.provisional(rows, "q3_s")
    path = _bundle(spark, sf).first()["path"]
    return models.forecast(grid.overlay(rows, order), models.load_bundle(spark, path))


@query("ml9_forecast_table")
def _(spark, sf):
    return out(stored(spark, sf, "forecast", lambda: _forecast(spark, sf)))


@query("ml9_forecast_facts",
       sql("entries", """select count(*) as n_rows, count(*) as n_ranks, 1::int as best_rank, count(*)::int as last_rank, 1.0::double as p_win_total,
           least(count(*), 3)::double as p_podium_total, least(count(*), 3) as n_podium, 0::bigint as n_outside
           from entries where d = (select max(d) from entries)"""))
def _(spark, sf):
    """What holds for any forecast: every entry once, ranks without gaps, chances that add up and stay in bounds."""
    rows = stored(spark, sf, "forecast", lambda: _forecast(spark, sf))
    inside = [F.coalesce(F.col(c).between(0, 1 + 1e-9), F.lit(False)) for c in ("p_win", "p_podium", "p_top10")]
    return out(rows.agg(
        F.count_distinct("driver").alias("n_rows"), F.count_distinct("pred_finish_rank").alias("n_ranks"),
        F.min("pred_finish_rank").cast("int").alias("best_rank"), F.max("pred_finish_rank").cast("int").alias("last_rank"),
        F.sum("p_win").alias("p_win_total"), F.sum("p_podium").alias("p_podium_total"), F.count_if("predicted_podium").alias("n_podium"),
        F.count_if(~F.forall(F.array(*inside), lambda x: x)).alias("n_outside")))
