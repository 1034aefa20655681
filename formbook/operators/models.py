"""Models: classifier, contest ranker, heads, search, folds and bundles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import CONTEST
from ..functions import vocab
from ..functions.expr import flag
from ..session import materialise
from ..sources.schema import FEATURE_COLS, NATIVE_MISSING
from . import boosting, folds, impute, pairwise, placing, probability
from .asof import asof_join
from .grouping import ranks, with_row
from .metrics import contest_metrics, further_metrics, predicted_rank

K = list(CONTEST)
ID = [*K, "driver"]
BUNDLE_VERSION, POLICY_VERSION = 1, 2

# A tree learner here has no native missing branch: a deliberately missing value
# becomes a constant plus an indicator.
INDICATED = tuple(c for c in FEATURE_COLS if c in NATIVE_MISSING)
INPUTS = (*FEATURE_COLS, *[f"{c}_missing" for c in INDICATED])
FILLED = tuple(f"in_{c}" for c in INPUTS)

# Search grid: tree depth stands for 7 / 15 / 31 leaves, then minimum rows per leaf.
SEARCH = tuple({"maxDepth": d, "minInstancesPerNode": n} for d in (3, 4, 5) for n in (20, 40, 80))


def _together(*tasks, width: int = 4) -> list:
    """Independent fits submitted side by side: small jobs fill each other's gaps."""
    keep = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(width) as pool:
        return [f.result() for f in [pool.submit(keep(t)) for t in tasks]]


def inputs(df: DataFrame) -> DataFrame:
    """Add the model inputs (`in_*`): doubles without NULLs, next to the untouched columns."""
    values = {f"in_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURE_COLS}
    marks = {f"in_{c}_missing": flag(F.col(c).isNull()).cast("double") for c in INDICATED}
    return df.withColumns({**values, **marks})


def _score(model: PipelineModel, df: DataFrame, value, out: str) -> DataFrame:
    """Rows with one model output added."""
    return model.transform(inputs(df)).select(*df.columns, value().alias(out))


def _config(maxDepth: int = 3, minInstancesPerNode: int = 1) -> boosting.Config:
    return boosting.Config(maxDepth, minInstancesPerNode)


def fit_classifier(train: DataFrame, val: DataFrame, label: str, balanced: bool = False,
                   max_iter: int = 40, **params) -> boosting.Model:
    """Boosted trees that stop on the later validation block. `balanced` weights the rare class up."""
    return fit_classifiers(train, val, {label: balanced}, max_iter, **params)[0]


def fit_classifiers(train: DataFrame, val: DataFrame, labels: Mapping[str, bool], max_iter: int = 40, **params) -> list[boosting.Model]:
    """The classifier of each label, balanced or not; all learn in the same passes over the same blocks."""
    both = (inputs(train).withColumn("_is_val", F.lit(False))
            .unionByName(inputs(val).withColumn("_is_val", F.lit(True)), allowMissingColumns=True)
            .withColumns({f"_label_{c}": F.col(c).cast("double") for c in labels}))
    rare = [c for c, balanced in labels.items() if balanced]
    if rare:
        both = with_row(both, train.agg(*[F.avg(F.col(c).cast("double")).alias(f"_share_{c}") for c in rare]))
        both = both.withColumns({f"_weight_{c}": F.when(F.col(f"_label_{c}") == 1, F.col(f"_share_{c}") ** -1)
                                 .otherwise((1 - F.col(f"_share_{c}")) ** -1) for c in rare})
    wanted = {f"_label_{c}": f"_weight_{c}" if c in rare else None for c in labels}
    return [m[0] for m in boosting.fit_labels(both, FILLED, wanted, [_config(**params)], max_iter, "logistic", held="_is_val")]


def with_probability(model: boosting.Model, df: DataFrame, out: str) -> DataFrame:
    """Positive-class probability of a fitted classifier."""
    return _boosted(model, df, lambda: 1.0 / (1.0 + F.exp(-2.0 * F.col("_raw"))), out)


def _boosted(model: boosting.Model, df: DataFrame, value, out: str) -> DataFrame:
    return boosting.with_raw(model, inputs(df), "_raw").select(*df.columns, value().alias(out))


# An entry is compared with those so many places behind it.
OFFSETS = (1, 2, 4, 8, 16)


def comparison_pairs(df: DataFrame, offsets: Sequence[int] = OFFSETS) -> DataFrame:
    """Feature differences between entries a fixed number of places apart.

    Near and far comparisons grow as rows x offsets; all pairs of a contest are
    never formed. Joins are on (contest, place), which no contest can skew.
    """
    keep = df.filter(F.col("officially_classified") == 1)
    placed = ranks(keep, K, {"_place": [("result_order", "asc"), ("driver", "asc")]})
    placed = materialise(inputs(placed).select(*K, "_place", *FILLED), "places")
    lower = placed.select(*K, F.col("_place"), *[F.col(c).alias(f"_b_{c}") for c in FILLED])
    upper = placed.withColumn("_offset", F.explode(F.array(*[F.lit(o) for o in offsets])))
    upper = upper.withColumn("_at", F.col("_place") + F.col("_offset")).drop("_place")
    joined = upper.join(lower.withColumnRenamed("_place", "_at"), [*K, "_at"])
    return joined.select(*K, "_at", "_offset", *[(F.col(c) - F.col(f"_b_{c}")).alias(c) for c in FILLED])


def ranker_pairs(train: DataFrame) -> DataFrame:
    """Labelled feature differences for the pairwise ranker, pair by pair; `fit_rankers` learns from them without forming them."""
    pairs = comparison_pairs(train)
    # Mirror half of the pairs by a row hash, so both labels occur equally often.
    pairs = pairs.withColumn("_turn", F.when(F.pmod(F.xxhash64(*K, "_at", "_offset"), F.lit(2)) == 0, 1.0).otherwise(-1.0))
    return pairs.select(((F.col("_turn") + 1) / 2).alias("_label"), *[(F.col(c) * F.col("_turn")).alias(c) for c in FILLED])


def fit_rankers(train: DataFrame, counts: Sequence[int], reg: float = 0.01, offsets: Sequence[int] = OFFSETS) -> list[PipelineModel]:
    """The pairwise ranker after each iteration count: the fits share one path, as a shorter one is its beginning."""
    keep = train.filter(F.col("officially_classified") == 1)
    placed = inputs(ranks(keep, K, {"_place": [("result_order", "asc"), ("driver", "asc")]}))
    table = materialise(pairwise.blocks(placed, FILLED, offsets), "places")
    path = pairwise.fit(table, len(FILLED), offsets, reg, max(counts))
    return [_linear(path[min(n, len(path) - 1)]) for n in counts]


def _linear(weights: Sequence[float]) -> PipelineModel:
    """A model that adds the weighted sum of the inputs as `_rank_value`."""
    total = " + ".join(f"{float(w)!r}D * `{c}`" for c, w in zip(FILLED, weights, strict=True))
    return PipelineModel([SQLTransformer(statement=f"SELECT *, {total} AS _rank_value FROM __THIS__")])


def fit_ranker(train: DataFrame, reg: float = 0.01, max_iter: int = 20) -> PipelineModel:
    """Pairwise logistic ranker: which of two entries finishes ahead."""
    return fit_rankers(train, [max_iter], reg)[0]


def with_rank_score(model: PipelineModel, df: DataFrame, out="rank_score") -> DataFrame:
    """Linear score of the pairwise ranker; higher finishes ahead."""
    return _score(model, df, lambda: F.col("_rank_value"), out)


def fit_grade_ranker(train: DataFrame, max_iter: int = 20, **params) -> boosting.Model:
    """Challenger: boosted regression on the relevance grade as a share of the field."""
    return fit_grade_rankers(train, [params], max_iter)[0]


def fit_grade_rankers(train: DataFrame, grid: Sequence[dict], max_iter: int = 20) -> list[boosting.Model]:
    """The grade ranker in each configuration; all learn in the same passes."""
    rows = inputs(train).withColumn("_grade", F.col("relevance") / F.col("field_size"))
    return boosting.fit(rows, FILLED, "_grade", [_config(**c) for c in grid], max_iter)


def with_grade(model: boosting.Model, df: DataFrame, out="rank_score") -> DataFrame:
    return _boosted(model, df, lambda: F.col("_raw"), out)


# Iteration counts among which early stopping chooses.
ITERATIONS = (5, 10, 20, 40)


def best_round(scores: DataFrame, by: Sequence[str], index: str, value: str) -> DataFrame:
    """Per group the candidate with the largest value; ties go to the smallest index. NULL values never win."""
    kept = scores.filter(F.col(value).isNotNull())
    return kept.groupBy(*by).agg(F.max_by(F.struct(index, value), F.struct(value, -F.col(index))).alias("_b")).select(*by, "_b.*")


def stop_early(train: DataFrame, val: DataFrame, counts: Sequence[int] = ITERATIONS) -> DataFrame:
    """Validation NDCG@3 of the pairwise ranker after each iteration count: one row per count, `chosen` the first best."""
    return stopped_rankers(train, val, counts)[0]


def stopped_rankers(train: DataFrame, val: DataFrame, counts: Sequence[int] = ITERATIONS) -> tuple[DataFrame, dict[int, PipelineModel]]:
    """The table of `stop_early` and the ranker of each count; all come from one fit, their validation rows are judged in one job."""
    models = dict(zip(counts, fit_rankers(train, counts), strict=True))
    judged = [*K, "driver", "grid_position", "relevance", "finished", "result_order", "rank_score"]
    parts = [with_rank_score(m, val).select(F.lit(n).alias("iterations"), *judged) for n, m in models.items()]
    scored = materialise(reduce(DataFrame.unionByName, parts), "stopping")
    table = (further_metrics(scored, "rank_score", False, contest=["iterations", *K])
             .groupBy("iterations").agg(F.avg("ndcg_3").alias("ndcg_3")))
    table = materialise(table, "stopping-scores")
    chosen = best_round(table, [], "iterations", "ndcg_3").select(F.col("iterations").alias("_best"))
    return with_row(table, chosen).withColumn("chosen", F.col("iterations") == F.col("_best")).drop("_best"), models


def search(train: DataFrame, val: DataFrame, grid: Sequence[dict] = SEARCH, max_iter: int = 20) -> DataFrame:
    """Validation NDCG@3 of each configuration; ties go to the first (smallest) one."""
    one = lambda df, role: df.withColumns({"fold": F.lit("only"), "role": F.lit(role)})
    both = one(train, folds.TRAIN).unionByName(one(val, folds.VAL), allowMissingColumns=True)
    table, _ = search_folds(both, ["only"], grid, max_iter)
    return table.drop("fold")


def search_folds(filled: DataFrame, names: Sequence[str], grid: Sequence[dict] = SEARCH, max_iter: int = 20,
                 width: int = 8) -> tuple[DataFrame, dict[tuple[str, int], boosting.Model]]:
    """`search` of several folds: a fold's configurations learn together, all validation rows are judged in one job keyed by fold.

    Returns the table (fold, configuration, NDCG@3, `chosen`) and the fitted models by (fold, configuration);
    both are bounded by folds x grid.
    """
    def role(fold, r):
        return filled.filter((F.col("fold") == fold) & (F.col("role") == r))

    keys = [(f, i) for f in names for i in range(len(grid))]
    fits = _together(*[lambda f=f: fit_grade_rankers(role(f, folds.TRAIN), grid, max_iter) for f in names], width=width)
    fitted = dict(zip(keys, (m for models in fits for m in models), strict=True))
    judged = ["fold", *K, "driver", "grid_position", "relevance", "finished", "result_order"]
    parts = [boosting.with_raws(models, inputs(role(f, folds.VAL)), "_raws").select(*judged, F.posexplode("_raws").alias("config", "rank_score"))
             for f, models in zip(names, fits, strict=True)]
    scored = materialise(reduce(DataFrame.unionByName, parts), "search")
    score = (further_metrics(scored, "rank_score", False, contest=["fold", "config", *K])
             .groupBy("fold", "config").agg(F.avg("ndcg_3").alias("ndcg_3")))
    score = materialise(score, "search-scores")
    facts = filled.sparkSession.createDataFrame(
        [(f, i, grid[i].get("maxDepth"), grid[i].get("minInstancesPerNode")) for f, i in keys], "fold string, config int, max_depth int, min_rows int")
    best = best_round(score, ["fold"], "config", "ndcg_3").select("fold", F.col("config").alias("_best"))
    table = facts.join(score, ["fold", "config"], "left").join(best, "fold", "left")
    return table.withColumn("chosen", F.coalesce(F.col("config") == F.col("_best"), F.lit(False))).drop("_best"), fitted


def tuned_rankers(filled: DataFrame, names: Sequence[str], grid: Sequence[dict] = SEARCH, max_iter: int = 20) -> dict[str, boosting.Model]:
    """Each fold's grade ranker in the configuration that its own validation block chose."""
    table, fitted = search_folds(filled, names, grid, max_iter)
    return {r["fold"]: fitted[r["fold"], r["config"]] for r in table.filter("chosen").collect()}


def importances(model: boosting.Model, spark) -> DataFrame:
    """Feature importances of the fitted trees with their names."""
    rows = [(n, float(v)) for n, v in zip(INPUTS, model.importances(), strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


HEADS = {"winner_head": "is_winner", "podium_head": "is_podium"}
FOLD_OUT = ("team", "grid_position", "result_order", "is_winner", "is_podium", "finished_top10", "finished", "p_top10_clf",
            "p_winner_head", "p_podium_head", "rank_score", "blend_score", "ensemble", "p_win", "p_podium", "p_top10",
            "p_win_grid", "p_podium_grid", "alpha", "w_win", "w_pod", "temperature", "grid_temperature")


def fold_rows(prefill: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of every fold and role, filled by the fold's own policy, which sees its training rows only."""
    rows = prefill.join(table.select("fold", "role", *K), K)
    return impute.transform(rows, impute.fit(rows.filter(F.col("role") == folds.TRAIN), ["fold"]), ["fold"])


def fold_scores(filled: DataFrame, max_iter: int = 40, width: int = 8, tune: Sequence[dict] = ()) -> DataFrame:
    """Validation and test rows with the scores of their fold's models.

    A fold's classifiers learn together. All fits of all folds wait in one flat pool,
    so small jobs of one fit fill the gaps of others and no pool waits inside another. With a grid in `tune` the
    ranker of a fold is the grade ranker that its validation block chose from it.
    """
    names = [r["fold"] for r in filled.select("fold").distinct().orderBy("fold").collect()]

    def fits(fold):
        train, val = (filled.filter((F.col("fold") == fold) & (F.col("role") == r)) for r in (folds.TRAIN, folds.VAL))
        return [lambda: fit_classifiers(train, val, {"finished_top10": False} | dict.fromkeys(HEADS.values(), True), max_iter),
                lambda: None if tune else fit_ranker(train)]

    models = _together(*[task for n in names for task in fits(n)], width=width)
    tuned = tuned_rankers(filled, names, tune, max_iter) if tune else {}
    parts = []
    for i, fold in enumerate(names):
        (clf, *heads), ranker = models[2 * i:2 * i + 2]
        part = filled.filter((F.col("fold") == fold) & F.col("role").isin(folds.VAL, folds.TEST))
        part = with_probability(clf, part, "p_top10_clf")
        part = with_grade(tuned[fold], part) if tune else with_rank_score(ranker, part)
        for h, m in zip(HEADS, heads, strict=True):
            part = with_probability(m, part, f"p_{h}")
        parts.append(part)
    # Written before use: an expression over a model output would run the model once per mention.
    return materialise(reduce(DataFrame.unionByName, parts), "fold-scored")


def fold_choices(val: DataFrame) -> DataFrame:
    """One row per fold: blend weight, head weights and temperatures, each swept for all folds in one job."""
    by = ["fold"]
    alpha = probability.select_alpha(probability.alpha_table(val, "rank_score", by=by), by)
    weights = probability.select_weights(probability.weight_losses(val, "rank_score_z", tuple(f"{h}_z" for h in HEADS), by), by)
    own = probability.fit_temperature(probability.temperature_losses(val, "rank_score", by), by)
    grid = probability.fit_temperature(probability.temperature_losses(val.withColumn("_u", -F.col("grid_position")), "_u", by), by)
    return (alpha.join(weights.select("fold", "w_win", "w_pod"), by).join(own.select("fold", "temperature"), by)
            .join(grid.select("fold", F.col("temperature").alias("grid_temperature")), by))


def run_folds(prefill: DataFrame, table: DataFrame, n_draws: int = vocab.PL_DRAWS, max_iter: int = 40,
              tune: Sequence[dict] = ()) -> DataFrame:
    """Fit, choose and predict in every fold: its test rows with the columns `FOLD_OUT`.

    The fill policy and the models see training rows, stopping and all choices
    see validation rows only. Classifier and Plackett-Luce top-10 stay separate
    columns. Only the fits run per fold; filling, scoring, sweeps, draws and
    blends are single jobs keyed by fold. `tune` is a grid for the ranker (`SEARCH`).
    """
    scored = fold_scores(materialise(fold_rows(prefill, table), "fold-rows"), max_iter, tune=tune)
    scored = scored.withColumns({h: probability.log_odds(f"p_{h}") for h in HEADS})
    group = ["fold", "role", *K]
    scored = materialise(probability.standardise(scored, ["rank_score", *HEADS], contest=group), "fold-standard")
    val, test = (scored.filter(F.col("role") == r) for r in (folds.VAL, folds.TEST))
    chosen = materialise(fold_choices(val), "fold-choices")
    group = ["fold", *K]
    # Written so that scans, not fits or sweeps, lie under the draws.
    test = materialise(test.join(chosen, "fold"), "fold-test")
    test = probability.blend(test, "rank_score", F.col("alpha"), contest=group).withColumn("ensemble", sum(
        (F.col(w) * F.col(f"{h}_z") for w, h in (("w_win", "winner_head"), ("w_pod", "podium_head"))), F.col("rank_score_z")))
    test = probability.softmax(test, "rank_score", F.col("temperature"), contest=group)
    test = probability.softmax(test.withColumn("_known", -F.col("grid_position")), "_known", F.col("grid_temperature"), "p_win_grid", group)
    shares = placing.sampled_shares(test, {"": F.col("rank_score") / F.col("temperature"), "_grid": F.col("_known") / F.col("grid_temperature")},
                                    n_draws, contest=group, draw_keys=K)
    test = test.join(shares, [*group, "driver"], "left").fillna(0.0, ["p_podium", "p_top10", "p_podium_grid"])
    return test.select("fold", *ID, *FOLD_OUT)


# --- bundles -------------------------------------------------------------------------
VALIDATION = ("val_season", "n_val_contests", "ndcg_3", "winner_accuracy", "podium_overlap", "top10_overlap", "spearman_all",
              "winner_log_loss", "uniform_log_loss")


def validation_block(scored: DataFrame, temperature: float) -> DataFrame:
    """One row: how the drafted recipe did on the contests that chose it."""
    means = [("ndcg_3",), ("winner_accuracy", "podium_overlap", "top10_overlap", "spearman_all"), ("winner_log_loss",), ("uniform_log_loss",)]
    parts = [further_metrics(scored, "rank_score", False), contest_metrics(scored, "rank_score", False),
             probability.winner_losses(probability.softmax(scored, "rank_score", temperature)), probability.uniform_losses(scored)]
    one = scored.agg(F.max("year").alias("val_season"), F.count_distinct(*K).alias("n_val_contests"))
    for names, part in zip(means, parts, strict=True):
        one = with_row(one, part.agg(*[F.avg(c).alias(c) for c in names]))
    return one.select(F.struct(*VALIDATION).alias("validation"))


def develop_and_refit(prefill: DataFrame, path: str) -> DataFrame:
    """Choose iterations, alpha and temperature on the validation year, refit the frozen recipe on
    all rows, save, and return the one-row manifest."""
    train, val = (prefill.filter(F.col("partition") == p) for p in (folds.TRAIN, folds.VAL))
    policy = impute.fit(train)
    train = materialise(impute.transform(train, policy), "develop-train")
    val = materialise(impute.transform(val, policy), "develop-val")
    table, drafts = stopped_rankers(train, val)
    iterations = table.filter("chosen").first()["iterations"]
    val = materialise(with_rank_score(drafts[iterations], val), "develop")
    alpha = probability.select_alpha(probability.alpha_table(val, "rank_score")).first()["alpha"]
    temperature = probability.fit_temperature(probability.temperature_losses(val, "rank_score")).first()["temperature"]
    block = validation_block(val, temperature)

    policy = impute.fit(prefill)
    fit_ranker(impute.transform(prefill, policy), max_iter=iterations).write().overwrite().save(f"{path}/ranker")
    policy.write.mode("overwrite").json(f"{path}/policy")
    manifest = prefill.agg(
        F.lit(BUNDLE_VERSION).alias("bundle_version"), F.max("date").cast("timestamp").alias("training_cutoff_utc"),
        F.lit(POLICY_VERSION).alias("fill_policy_schema"), F.count(F.lit(1)).alias("n_train_rows"),
        F.count_distinct(*K).alias("n_train_contests"), F.min("year").alias("train_year_min"),
        F.max("year").alias("train_year_max")).select(
        "*", F.array(*[F.lit(c) for c in FEATURE_COLS]).alias("feature_cols"),
        F.lit(float(alpha)).alias("alpha"), F.lit(float(temperature)).alias("temperature"),
        F.lit(path).alias("path"), F.lit(iterations).alias("iterations"))
    manifest = with_row(manifest, block)
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    # Read back, so that what a caller sees is what was saved and nothing is computed again.
    return prefill.sparkSession.read.schema(MANIFEST_SCHEMA).json(f"{path}/manifest")


MANIFEST_SCHEMA = ("bundle_version int, training_cutoff_utc timestamp, fill_policy_schema int, n_train_rows bigint, "
                   "n_train_contests bigint, train_year_min int, train_year_max int, feature_cols array<string>, "
                   "alpha double, temperature double, path string, iterations int, validation struct<val_season: int, "
                   "n_val_contests: bigint, " + ", ".join(f"{c}: double" for c in VALIDATION[2:]) + ">")


def manifest_problems(manifests: DataFrame, feature_cols: Sequence[str] = FEATURE_COLS) -> DataFrame:
    """One row per bundle and broken check: version, feature list, policy schema, frozen iterations, validation block."""
    wanted = F.array(*[F.lit(c) for c in feature_cols])
    checks = {"bundle_version": F.col("bundle_version") != BUNDLE_VERSION,
              "feature_list": F.coalesce(F.col("feature_cols") != wanted, F.lit(True)),
              "policy_schema": F.col("fill_policy_schema") != POLICY_VERSION,
              "iterations": F.coalesce(F.col("iterations") < 1, F.lit(True)),
              "validation": F.col("validation").isNull()}
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return manifests.select("path", F.explode(found).alias("problem"))


def usable_bundles(contests: DataFrame, manifests: DataFrame) -> DataFrame:
    """For each contest the newest bundle trained strictly before it, NULL when there is none."""
    left = contests.select(*K, F.col("date").cast("timestamp").alias("_at"), F.lit(0).alias("_one"))
    right = manifests.select(F.lit(0).alias("_one"), "training_cutoff_utc", F.col("path").alias("bundle"))
    return asof_join(left, right, ["_one"], "_at", "training_cutoff_utc", ["bundle"], "bundle").select(*K, "bundle")


def load_bundle(spark, path: str) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Ranker, policy and manifest of a saved bundle; a broken check is refused."""
    manifest = spark.read.schema(MANIFEST_SCHEMA).json(f"{path}/manifest")
    broken = [r["problem"] for r in manifest_problems(manifest).collect()]
    if broken:
        raise ValueError(f"bundle {path} refused: {', '.join(broken)}")
    return PipelineModel.load(f"{path}/ranker"), spark.read.json(f"{path}/policy"), manifest


def forecast(upcoming: DataFrame, bundle: tuple[PipelineModel, DataFrame, DataFrame],
             n_draws: int = vocab.PL_DRAWS) -> DataFrame:
    """Ordered forecast rows of contests that have not run, from their prefill features.

    Contests on or before the training cutoff are refused.
    """
    ranker, policy, manifest = bundle
    one = manifest.first()
    upcoming = materialise(upcoming, "upcoming")
    early = upcoming.filter(F.col("date").cast("timestamp") <= F.lit(one["training_cutoff_utc"]))
    if not early.isEmpty():
        raise ValueError("a bundle may only score contests after its training cutoff")
    rows = materialise(with_rank_score(ranker, impute.transform(upcoming, policy)), "forecast")
    rows = probability.blend(rows, "rank_score", one["alpha"])
    rows = probability.plackett_luce(rows, "rank_score", one["temperature"], n_draws, shares=placing.sampled_shares)
    rows = predicted_rank(rows, "blend_score", True, "pred_finish_rank")
    return rows.select("pred_finish_rank", *ID, "team", "grid_position", (F.col("pred_finish_rank") <= 3)
                       .alias("predicted_podium"), "p_win", "p_podium", "p_top10")
