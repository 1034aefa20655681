"""Per-contest metrics of an ordering, pooled tables and classifier metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import CONTEST
from ..functions.expr import correlation, ratio
from ..session import materialise
from .grouping import has_hot_group, ranks, sized, tie_ranks, with_row
from .labels import METRIC_LABELS, ensure_labels
from .scan import prefix_scan

K = list(CONTEST)
METRICS = ("winner_accuracy", "podium_overlap", "top10_overlap", "top_pick_finished_top10",
           "spearman_all", "spearman_finishers")
EPSILON = 2.220446049250313e-16
HEADLINE = ("winner_accuracy", "podium_overlap", "top10_overlap", "spearman_all", "spearman_finishers")
DENOMINATORS = {"n_contests_winner": "winner_accuracy", "n_contests_podium": "podium_overlap",
                "n_contests_top10": "top10_overlap", "n_contests_spearman_all": "spearman_all",
                "n_contests_spearman_finishers": "spearman_finishers"}


def predicted_rank(df: DataFrame, score: str, ascending: bool, out="pred_rank",
                   contest: Sequence[str] = CONTEST, split: bool | None = None) -> DataFrame:
    """Places by score, then known order, then id."""
    gone = [c for c in ("grid_position", "driver") if c not in df.columns]
    if gone:
        raise KeyError(f"tie-breaker columns missing: {gone}")
    order = [(score, "asc" if ascending else "desc"), ("grid_position", "asc"), ("driver", "asc")]
    return ranks(df, contest, {out: order}, split)


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str, out: str,
             split: bool | None = None) -> DataFrame:
    """Rank correlation over complete pairs; NULL under 3 pairs or without variation."""
    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, "driver", a, b)
    if split is None:
        split = has_hot_group(pairs, keys)
    pairs = tie_ranks(pairs, keys, a, "_ra", ["driver"], split)
    pairs = tie_ranks(pairs, keys, b, "_rb", ["driver"], split)
    enough = F.count(F.lit(1)) >= 3
    return pairs.groupBy(*keys).agg(F.when(enough, correlation("_ra", "_rb")).alias(out))


def contest_metrics(df: DataFrame, score: str, ascending: bool, by: Sequence[str] = (),
                    contest: Sequence[str] = CONTEST) -> DataFrame:
    """One row per contest; a metric is NULL where it is undefined.

    `by` adds leading keys (a method or a fold), so that several orderings are
    scored in one pass. The places are written once, and each correlation too:
    a task sorts a few contests for one of them at a time.
    """
    keys = [*by, *contest]
    wanted = [*keys, "driver", "grid_position", score, *METRIC_LABELS]
    data = ensure_labels(df)
    data = data.select(*[c for c in dict.fromkeys(wanted) if c in data.columns])
    split = has_hot_group(data, keys)
    placed = predicted_rank(data if split else sized(data, *keys), score, ascending, contest=keys, split=split)
    placed = materialise(placed.select(*keys, "driver", "pred_rank", *METRIC_LABELS), "placed")
    apart = placed if split else sized(placed, *keys)
    hit = lambda k, flag_: F.count(F.when((F.col("pred_rank") <= k) & (F.col(flag_) == 1), 1))
    known = lambda flag_: F.max(flag_) == 1
    first = F.max(F.when(F.col("pred_rank") == 1, F.col("is_winner"))).cast("double")
    first10 = F.max(F.when(F.col("pred_rank") == 1, F.col("finished_top10"))).cast("double")
    base = placed.groupBy(*keys).agg(
        F.when(known("is_winner"), first).alias("winner_accuracy"),
        F.when(known("is_podium"), hit(3, "is_podium") / F.lit(3.0)).alias("podium_overlap"),
        F.when(known("finished_top10"), hit(10, "finished_top10") / F.lit(10.0)).alias("top10_overlap"),
        F.when(known("finished_top10"), first10).alias("top_pick_finished_top10"))
    every = spearman(apart, keys, "pred_rank", "result_order", "spearman_all", split)
    done = spearman(apart.filter(F.col("finished") == 1), keys, "pred_rank", "result_order",
                    "spearman_finishers", split)
    every, done = materialise(every, "spearman-all"), materialise(done, "spearman-finishers")
    return base.join(every, keys, "left").join(done, keys, "left")


def pooled(per_contest: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means over contests with the denominator of each metric."""
    return per_contest.groupBy(*by).agg(
        *[F.avg(m).alias(m) for m in METRICS], F.count(F.lit(1)).alias("n_contests"),
        *[F.count(m).alias(n) for n, m in DENOMINATORS.items()])


def stack_orderings(df: DataFrame, orderings: Mapping[str, tuple[str, bool]]) -> DataFrame:
    """Rows repeated per ordering with one ascending `_score`."""
    items = [F.struct(F.lit(name).alias("method"),
                      (F.col(c) if asc else -F.col(c)).cast("double").alias("_score"))
             for name, (c, asc) in orderings.items()]
    return df.select("*", F.inline(F.array(*items)))


def orderings_metrics(df: DataFrame, orderings: Mapping[str, tuple[str, bool]],
                      contest: Sequence[str] = CONTEST) -> DataFrame:
    """`contest_metrics` of several orderings in one pass."""
    return contest_metrics(stack_orderings(ensure_labels(df), orderings), "_score", True, ["method"], contest)


def further_metrics(df: DataFrame, score: str, ascending: bool, ks: Sequence[int] = (1, 3, 10),
                    contest: Sequence[str] = CONTEST) -> DataFrame:
    """Exact-place rate and mean absolute error of finishers, and NDCG at k, per contest.

    The grade is a row's `relevance`; its gain is 2^grade - 1 over log2(1 + place).
    NDCG is a ratio, so all gains are divided by 2^best first and stay finite in
    any field.
    """
    keys = list(contest)
    sizes = df.groupBy(*keys).agg(F.max("relevance").alias("_best"))
    placed = predicted_rank(df, score, ascending, contest=contest)
    placed = ranks(placed, contest, {"_ideal": [("relevance", "desc"), ("driver", "asc")]})
    placed = placed.join(F.broadcast(sizes), keys)
    gain = F.pow(F.lit(2.0), F.col("relevance") - F.col("_best")) - F.pow(F.lit(2.0), -F.col("_best"))
    done = F.col("finished") == 1
    off = F.abs(F.col("pred_rank") - F.col("result_order"))
    parts = [F.avg(F.when(done, F.when(off == 0, 1.0).otherwise(0.0))).alias("exact_rate"),
             F.avg(F.when(done, off)).alias("place_mae")]
    for k in ks:
        got = F.sum(F.when(F.col("pred_rank") <= k, gain / F.log2(1.0 + F.col("pred_rank"))))
        best = F.sum(F.when(F.col("_ideal") <= k, gain / F.log2(1.0 + F.col("_ideal"))))
        parts.append(ratio(got, best).alias(f"ndcg_{k}"))
    return placed.groupBy(*keys).agg(*parts)


def classifier_metrics(df: DataFrame, p: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy at 0.5, ROC-AUC, average precision, log loss, Brier and confusion counts.

    Rows collapse to one per distinct probability first; the cumulative counts
    run over those, as a prefix scan whose parts follow the scores. Rows
    without a score or label are left out; a group without positives (or
    negatives) has no average precision (or AUC).
    """
    df = df.where(F.col(p).isNotNull() & F.col(label).isNotNull())
    y = F.col(label)
    per = df.groupBy(*by, p).agg(F.sum(y).cast("double").alias("pos"),
                                 F.sum(1 - y).cast("double").alias("neg"))
    run = prefix_scan(per, by, F.col(p), {"pos_below": ("sum", "pos"), "neg_below": ("sum", "neg")}, tie=[])
    run = run.fillna(0.0, ["pos_below", "neg_below"])
    rise = run.groupBy(*by).agg(
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"),
        # Per score: positives times negatives scored lower, ties half.
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)).alias("_pairs"))
    ap = (run.join(F.broadcast(rise), list(by)) if by else with_row(run, rise))
    above_pos = F.col("_p") - F.col("pos_below")
    above_all = above_pos + F.col("_n") - F.col("neg_below")
    ap = ap.groupBy(*by).agg(F.sum(ratio(F.col("pos"), F.col("_p")) * ratio(above_pos, above_all)).alias("average_precision"))
    # Log loss clips by the spacing of doubles at 1, as the usual definition does.
    q = F.greatest(F.least(F.col(p), F.lit(1 - EPSILON)), F.lit(EPSILON))
    said = F.col(p) >= 0.5
    flat = df.groupBy(*by).agg(
        F.avg(F.when(said == (y == 1), 1.0).otherwise(0.0)).alias("accuracy"),
        F.avg(-F.when(y == 1, F.ln(q)).otherwise(F.ln(1 - q))).alias("log_loss"),
        F.avg((F.col(p) - y) * (F.col(p) - y)).alias("brier"),
        F.count(F.when(said & (y == 1), 1)).alias("true_pos"), F.count(F.when(said & (y == 0), 1)).alias("false_pos"),
        F.count(F.when(~said & (y == 1), 1)).alias("false_neg"), F.count(F.when(~said & (y == 0), 1)).alias("true_neg"))
    auc = rise.select(*by, ratio("_pairs", F.col("_p") * F.col("_n")).alias("roc_auc"))
    if by:
        return flat.join(auc, list(by)).join(ap, list(by))
    return with_row(with_row(flat, auc), ap)


def invariance(df: DataFrame, score: str, ascending: bool, seeds: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Spread of the pooled metrics over shuffled and re-partitioned copies; 0 when order never matters."""
    base = ensure_labels(df)
    runs = None
    for s in seeds:
        tag = F.md5(F.concat_ws("/", F.lit(str(s)), *[F.col(c).cast("string") for c in (*K, "driver")]))
        shuffled = base.repartition(5 + s, tag).sortWithinPartitions(tag)
        one = pooled(contest_metrics(shuffled, score, ascending)).withColumn("seed", F.lit(s))
        runs = one if runs is None else runs.unionByName(one)
    return runs.agg(*[(F.max(m) - F.min(m)).alias(m) for m in METRICS])


def outcome_correlations(df: DataFrame, features: Sequence[str], outcome: str,
                         contest: Sequence[str] = CONTEST) -> DataFrame:
    """Correlation of each feature with the outcome, overall and averaged within contests."""
    def r(f):
        return correlation(f, outcome)
    whole = df.agg(*[r(f).alias(f) for f in features]).unpivot([], list(features), "feature", "overall")
    per = df.groupBy(*contest).agg(*[r(f).alias(f) for f in features])
    mean = per.agg(*[F.avg(f).alias(f) for f in features]).unpivot([], list(features), "feature", "within")
    return whole.join(mean, "feature")


def slot_reliability(df: DataFrame, p="p_win", slot="grid_position") -> DataFrame:
    """Win rate and mean predicted probability by known order."""
    return df.groupBy(slot).agg(F.avg("is_winner").alias("win_rate"), F.avg(p).alias("mean_p"),
                                F.count(F.lit(1)).alias("n_rows"))


def slot_baseline(train: DataFrame, test: DataFrame, smoothing: float = 0.5, slot="grid_position",
                  contest: Sequence[str] = CONTEST) -> DataFrame:
    """Win rate of each slot on earlier seasons, smoothed, renormalised per scored contest."""
    rates = train.groupBy(slot).agg(((F.sum("is_winner") + smoothing)
                                     / (F.count(F.lit(1)) + 2 * smoothing)).alias("_rate"))
    scored = test.join(rates, slot, "left").withColumn("_rate", F.coalesce("_rate", F.lit(smoothing / (1 + 2 * smoothing))))
    norm = scored.groupBy(*contest).agg(F.sum("_rate").alias("_norm"))
    return (scored.join(F.broadcast(norm), list(contest))
            .withColumn("p_win", F.col("_rate") / F.col("_norm")).drop("_rate", "_norm"))
