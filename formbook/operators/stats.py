"""Paired statistics with the contest as the unit of observation.

Inputs are per-contest tables, so every size here follows the calendar and the
number of replicates, never the number of entries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import CONTEST
from ..functions import draws, vocab
from ..functions.expr import ratio
from .grouping import spread

K = list(CONTEST)


def paired(candidate: DataFrame, baseline: DataFrame, metrics: Sequence[str],
           contest: Sequence[str] = CONTEST) -> DataFrame:
    """Long per-contest differences; a contest missing on either side drops out per metric."""
    a = candidate.unpivot(list(contest), list(metrics), "metric", "a")
    b = baseline.unpivot(list(contest), list(metrics), "metric", "b")
    return (a.join(b, [*contest, "metric"])
            .select(*contest, "metric", (F.col("a") - F.col("b")).alias("difference"))
            .filter(F.col("difference").isNotNull()))


def bootstrap(differences: DataFrame, by: Sequence[str] = ("metric",), n: int = vocab.BOOTSTRAP_REPLICATES,
              seed: int = vocab.SEED, confidence: float = vocab.CONFIDENCE,
              contest: Sequence[str] = CONTEST) -> DataFrame:
    """Mean difference with a percentile interval from resampled contests."""
    by = list(by)
    # Ordinals over contests: calendar-sized.
    order = Window.partitionBy(*by).orderBy(*contest)
    slots = differences.withColumn("slot", F.row_number().over(order) - 1)
    sizes = differences.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"),
                                         F.avg("difference").alias("mean_difference"))
    picks = _resample(slots.select(*by, "slot").join(F.broadcast(sizes.select(*by, "_n")), by), by, n, seed)
    means = (picks.join(F.broadcast(slots.select(*by, "slot", "difference")), [*by, "slot"])
             .groupBy("_block", *by, "rep").agg(F.avg("difference").alias("m")))
    return _interval(means, by, confidence).join(sizes, by).select(
        *by, F.col("_n").alias("n_contests"), "mean_difference", "ci_low", "ci_high",
        ((F.col("ci_low") > 0) | (F.col("ci_high") < 0)).alias("resolves"))


def _resample(slots: DataFrame, by: list[str], n: int, seed: int, block: int = 50) -> DataFrame:
    """One drawn slot per (replicate, slot). Blocks of replicates spread over the tasks,
    and a replicate stays within its block, so its mean needs no further shuffle."""
    blocks = slots.select("*", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // block))).alias("_block"))
    first = F.col("_block") * block + 1
    reps = F.sequence(first, F.least(first + block - 1, F.lit(n)))
    return (spread(blocks, "_block").select("_block", *by, "_n", "slot", F.explode(reps).alias("rep"))
            .select("_block", *by, "rep", draws.draw_index("_n", seed, F.col("rep"), F.col("slot")).alias("slot")))


def _interval(means: DataFrame, by: list[str], confidence: float) -> DataFrame:
    tail = (1.0 - confidence) / 2.0
    return means.groupBy(*by).agg(F.percentile("m", F.lit(tail)).alias("ci_low"),
                                  F.percentile("m", F.lit(1.0 - tail)).alias("ci_high"))


def cluster_bootstrap(differences: DataFrame, cluster="year", by: Sequence[str] = ("metric",),
                      n: int = vocab.BOOTSTRAP_REPLICATES, seed: int = vocab.SEED,
                      confidence: float = vocab.CONFIDENCE) -> DataFrame:
    """Resample whole seasons; a season enters through its sum and count."""
    by = list(by)
    per = differences.groupBy(*by, cluster).agg(F.sum("difference").alias("s"), F.count(F.lit(1)).alias("c"))
    slots = per.withColumn("slot", F.row_number().over(Window.partitionBy(*by).orderBy(cluster)) - 1)
    sizes = slots.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    picks = _resample(slots.select(*by, "slot").join(F.broadcast(sizes), by), by, n, seed)
    means = (picks.join(F.broadcast(slots.select(*by, "slot", "s", "c")), [*by, "slot"])
             .groupBy("_block", *by, "rep").agg((F.sum("s") / F.sum("c")).alias("m")))
    mean = differences.groupBy(*by).agg(F.avg("difference").alias("mean_difference"))
    return _interval(means, by, confidence).join(sizes, by).join(mean, by).select(
        *by, F.col("_n").alias("n_clusters"), "mean_difference", "ci_low", "ci_high")


def discordance(candidate: DataFrame, baseline: DataFrame, hit="winner_accuracy",
                contest: Sequence[str] = CONTEST) -> DataFrame:
    """Contests by (candidate hit, baseline hit)."""
    both = candidate.select(*contest, F.col(hit).alias("a")).join(
        baseline.select(*contest, F.col(hit).alias("b")), list(contest)).dropna(subset=["a", "b"])
    return both.groupBy(F.col("a").cast("int").alias("candidate_hit"),
                        F.col("b").cast("int").alias("baseline_hit")).agg(F.count(F.lit(1)).alias("n_contests"))


def mcnemar(table: DataFrame) -> DataFrame:
    """Exact two-sided p from the discordant counts of `discordance`."""
    def only(a, b):
        hit = (F.col("candidate_hit") == a) & (F.col("baseline_hit") == b)
        return F.coalesce(F.sum(F.when(hit, F.col("n_contests"))), F.lit(0)).cast("int")
    one = table.agg(only(1, 0).alias("only_candidate"), only(0, 1).alias("only_baseline"))
    n, low = F.col("only_candidate") + F.col("only_baseline"), F.least("only_candidate", "only_baseline")
    # ln C(n, k) accumulated term by term: C(n, k) = C(n, k - 1) (n - k + 1) / k.
    tail = F.aggregate(
        F.sequence(F.lit(0), low),
        F.struct(F.lit(0.0).alias("ln_c"), F.lit(0.0).alias("total")),
        lambda acc, k: F.struct(
            (acc["ln_c"] + F.when(k > 0, F.ln((n - k + 1).cast("double")) - F.ln(F.greatest(k, F.lit(1)).cast("double")))
             .otherwise(0.0)).alias("ln_c"),
            (acc["total"] + F.exp(
                acc["ln_c"] + F.when(k > 0, F.ln((n - k + 1).cast("double"))
                                     - F.ln(F.greatest(k, F.lit(1)).cast("double"))).otherwise(0.0)
                - n * F.ln(F.lit(2.0)))).alias("total")),
        lambda acc: acc["total"])
    return one.withColumn("p_value", F.least(F.lit(1.0), 2.0 * tail))


def wilcoxon(differences: DataFrame, by: Sequence[str] = ("metric",)) -> DataFrame:
    """Signed-rank statistic and its normal z; differences that are zero up to float noise are left out."""
    by = list(by)
    rows = differences.withColumn("_a", F.round(F.abs("difference"), 12)).filter(F.col("_a") > 0)
    w = Window.partitionBy(*by).orderBy("_a")
    same = Window.partitionBy(*by, "_a")
    rows = rows.withColumn("_r", F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / F.lit(2.0))
    one = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("difference") > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("difference") < 0, F.col("_r")).otherwise(0.0)).alias("w_minus"),
        F.sum(F.col("_r") * F.col("_r")).alias("_sq"))
    z = ratio(F.col("w_plus") - F.col("w_minus"), F.sqrt("_sq"))
    return one.withColumn("z", z).drop("_sq")


def window_slices(differences: DataFrame, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """Mean difference per year, overall, and for named year windows."""
    rolled = (differences.rollup("metric", "year")
              .agg(F.avg("difference").alias("mean_difference"), F.count(F.lit(1)).alias("n_contests"),
                   F.grouping("metric").alias("_g"))
              .filter(F.col("_g") == 0)
              .select("metric", F.coalesce(F.col("year").cast("string"), F.lit("all")).alias("slice"),
                      "mean_difference", "n_contests"))
    named = differences.select("metric", "year", "difference", F.inline(F.array(*[
        F.struct(F.lit(n).alias("slice"), F.lit(a).alias("lo"), F.lit(b).alias("hi"))
        for n, (a, b) in windows.items()]))).filter(F.col("year").between(F.col("lo"), F.col("hi")))
    named = named.groupBy("metric", "slice").agg(F.avg("difference").alias("mean_difference"),
                                                 F.count(F.lit(1)).alias("n_contests"))
    return rolled.unionByName(named)
