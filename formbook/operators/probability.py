"""Blends, contest softmax, Plackett-Luce probabilities and calibration.

Normalisers are contest-level aggregates joined back; parameter sweeps expand
rows by the candidate list and collapse in the same stage through partial
aggregation, so a sweep shuffles contests x candidates and not rows x candidates.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import CONTEST
from ..functions import draws, vocab
from ..functions.expr import col, ratio
from ..session import materialise
from . import hashed
from .grouping import attach, group_totals, has_hot_group, ranks, same_keys, spread, top_k

K = list(CONTEST)


def temperature_grid(low=vocab.TEMPERATURE_LOW, high=vocab.TEMPERATURE_HIGH,
                     steps=vocab.TEMPERATURE_STEPS) -> list[float]:
    """Log-spaced temperatures."""
    a, b = math.log(low), math.log(high)
    return [math.exp(a + (b - a) * i / (steps - 1)) for i in range(steps)]


def _candidates(values: Sequence[float], name: str, index: str) -> Column:
    """Explode a fixed list of candidates into (index, value)."""
    items = F.array(*[F.struct(F.lit(i).alias(index), F.lit(float(v)).alias(name))
                      for i, v in enumerate(values)])
    return F.inline(items)


def standardise(df: DataFrame, columns: Sequence[str], contest: Sequence[str] = CONTEST) -> DataFrame:
    """z-score within the contest; a constant field scores 0."""
    totals = {}
    for c in columns:
        totals |= {f"_m_{c}": F.avg(c), f"_s_{c}": F.stddev_samp(c)}
    out = group_totals(df, contest, totals, calendar=True)
    z = {c: F.coalesce(ratio(F.col(c) - F.col(f"_m_{c}"), f"_s_{c}"), F.lit(0.0)) for c in columns}
    return out.withColumns({f"{c}_z": v for c, v in z.items()}).drop(*totals)


def combine(weights: dict[str, float]) -> Column:
    """Weighted sum of standardised utilities."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.lit(float(w)) * F.col(name)
    return total


def log_odds(p) -> Column:
    """Log-odds with the probability clipped away from 0 and 1."""
    q = F.greatest(F.least(col(p), F.lit(1 - vocab.LOG_ODDS_CLIP)), F.lit(vocab.LOG_ODDS_CLIP))
    return F.ln(q / (1.0 - q))


def softmax(df: DataFrame, score: str, temperature: float | Column, out="p_win",
            contest: Sequence[str] = CONTEST) -> DataFrame:
    """exp(score / T) normalised per contest, shifted by the contest maximum."""
    if not isinstance(temperature, Column):
        if temperature <= 0:
            raise ValueError(f"temperature must be positive, got {temperature}")
        temperature = F.lit(float(temperature))
    top = df.groupBy(*contest).agg(F.max(score).alias("_top"))
    weighed = attach(df, top, contest, calendar=True).withColumn(
        "_e", F.exp((F.col(score) - F.col("_top")) / temperature))
    # The normaliser is summed from its own branch so that rows need no second shuffle.
    norm = weighed.groupBy(*contest).agg(F.sum("_e").alias("_norm"))
    return (attach(weighed, norm, contest, calendar=True)
            .withColumn(out, F.col("_e") / F.col("_norm")).drop("_top", "_e", "_norm"))


def blend(df: DataFrame, score: str, alpha, out="blend_score", split: bool | None = None,
          contest: Sequence[str] = CONTEST) -> DataFrame:
    """alpha x known-order rank + (1 - alpha) x model rank; lower is better."""
    placed = ranks(df, contest, {"_g": [("grid_position", "asc"), ("driver", "asc")],
                                 "_m": [(score, "desc"), ("grid_position", "asc"), ("driver", "asc")]}, split)
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return placed.withColumn(out, a * F.col("_g") + (1 - a) * F.col("_m")).drop("_g", "_m")


def alpha_table(df: DataFrame, score: str, alphas: Sequence[float] = vocab.ALPHA_GRID,
                by: Sequence[str] = (), contest: Sequence[str] = CONTEST) -> DataFrame:
    """Winner accuracy and podium overlap of every blend weight."""
    group = [*by, *contest]
    placed = ranks(df, group, {"_g": [("grid_position", "asc"), ("driver", "asc")],
                               "_m": [(score, "desc"), ("grid_position", "asc"), ("driver", "asc")]})
    wide = placed.select(*group, "driver", "grid_position", "is_winner", "is_podium", "_g", "_m",
                         _candidates(alphas, "alpha", "_i"))
    wide = wide.withColumn("_b", F.col("alpha") * F.col("_g") + (1 - F.col("alpha")) * F.col("_m"))
    first = top_k(wide, [*group, "alpha"], [("_b", "asc"), ("grid_position", "asc"), ("driver", "asc")], 3)
    known = df.groupBy(*group).agg(F.max("is_winner").alias("_w"), F.max("is_podium").alias("_p"))
    per = (first.groupBy(*group, "alpha")
           .agg(F.max(F.when(F.col("place") == 1, F.col("is_winner"))).alias("hit"),
                F.sum("is_podium").alias("podium"))
           .join(F.broadcast(known), group))
    return per.groupBy(*by, "alpha").agg(
        F.avg(F.when(F.col("_w") == 1, F.col("hit"))).alias("winner_accuracy"),
        F.avg(F.when(F.col("_p") == 1, F.col("podium") / 3.0)).alias("podium_overlap"))


def select_alpha(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Best winner accuracy, then podium overlap, then the higher weight."""
    key = F.struct(F.coalesce("winner_accuracy", F.lit(-1.0)), F.coalesce("podium_overlap", F.lit(-1.0)),
                   "alpha")
    return table.groupBy(*by).agg(F.max_by("alpha", key).alias("alpha"))


def winner_losses(df: DataFrame, p="p_win", contest: Sequence[str] = CONTEST) -> DataFrame:
    """-ln of the probability given to the winner, one row per contest that has one."""
    loss = -F.ln(F.greatest(F.col(p), F.lit(vocab.PROBABILITY_FLOOR)))
    return (df.filter(F.col("is_winner") == 1).groupBy(*contest)
            .agg(F.min_by(loss, "driver").alias("winner_log_loss")))


def temperature_losses(df: DataFrame, score: str, by: Sequence[str] = (),
                       grid: Sequence[float] | None = None, contest: Sequence[str] = CONTEST) -> DataFrame:
    """Mean winner log loss of every temperature, for all `by` keys in one job."""
    grid = temperature_grid() if grid is None else grid
    group = [*by, *contest]
    top = df.groupBy(*group).agg(F.max(score).alias("_top"), F.max("is_winner").alias("_w"))
    scored = attach(df, top, group, calendar=True).filter(F.col("_w") == 1)
    shifted = spread(scored, *group, "driver").select(
        *group, "is_winner", (F.col(score) - F.col("_top")).alias("_d"),
        _candidates(grid, "temperature", "t_index"))
    e = F.exp(F.col("_d") / F.col("temperature"))
    per = shifted.groupBy(*group, "t_index", "temperature").agg(
        F.sum(e).alias("_norm"), F.max(F.when(F.col("is_winner") == 1, e)).alias("_won"))
    loss = -F.ln(F.greatest(F.col("_won") / F.col("_norm"), F.lit(vocab.PROBABILITY_FLOOR)))
    return per.groupBy(*by, "t_index", "temperature").agg(F.avg(loss).alias("log_loss"))


def fit_temperature(losses: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The first temperature with the smallest loss, and whether it sits on a bound."""
    key = F.struct(F.round("log_loss", 12), "t_index")
    best = losses.groupBy(*by).agg(
        F.min_by("temperature", key).alias("temperature"), F.min_by("t_index", key).alias("t_index"),
        F.min("log_loss").alias("log_loss"), F.max("t_index").alias("_last"))
    return best.withColumn("on_bound", (F.col("t_index") == 0) | (F.col("t_index") == F.col("_last"))).drop("_last")


def weight_losses(df: DataFrame, base: str, heads: tuple[str, str], by: Sequence[str] = (),
                  weights: Sequence[float] = vocab.WEIGHT_GRID, grid: Sequence[float] | None = None,
                  contest: Sequence[str] = CONTEST) -> DataFrame:
    """Loss of every pair of head weights, the temperature refitted for each pair."""
    pairs = [(a, b) for a in weights for b in weights]
    items = F.array(*[F.struct(F.lit(i).alias("w_index"), F.lit(float(a)).alias("w_win"),
                               F.lit(float(b)).alias("w_pod")) for i, (a, b) in enumerate(pairs)])
    wide = df.select(*by, *contest, "driver", "is_winner", base, *heads, F.inline(items)).withColumn(
        "_u", F.col(base) + F.col("w_win") * F.col(heads[0]) + F.col("w_pod") * F.col(heads[1]))
    losses = temperature_losses(wide, "_u", [*by, "w_index", "w_win", "w_pod"], grid, contest)
    return fit_temperature(losses, [*by, "w_index", "w_win", "w_pod"])


def select_weights(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The first pair with the smallest loss."""
    key = F.struct(F.round("log_loss", 12), "w_index")
    return table.groupBy(*by).agg(*[F.min_by(c, key).alias(c)
                                    for c in ("w_win", "w_pod", "temperature", "log_loss")])


def plackett_luce(df: DataFrame, score: str, temperature: float | Column, n_draws: int = vocab.PL_DRAWS,
                  seed: int = vocab.SEED, contest: Sequence[str] = CONTEST, draw_keys: Sequence[str] | None = None,
                  shares: Callable[..., DataFrame] | None = None) -> DataFrame:
    """p_win in closed form; podium and top-10 shares from draws, Gumbel-max orderings unless `shares` names another sampler.

    Draws depend on the seed and on `draw_keys` (the contest's columns unless named).
    """
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    rows = softmax(df, score, temperature, contest=contest)
    share = (shares or drawn_shares)(rows, {"": F.col(score) / t}, n_draws, seed, contest, draw_keys)
    return (rows.join(share, [*contest, "driver"], "left")
            .withColumns({"p_podium": F.coalesce("p_podium", F.lit(0.0)),
                          "p_top10": F.coalesce("p_top10", F.lit(0.0)),
                          "mc_error": F.lit(math.sqrt(0.25 / n_draws))}))


def drawn_shares(df: DataFrame, utilities: Mapping[str, Column], n_draws: int, seed: int = vocab.SEED,
                 contest: Sequence[str] = CONTEST, draw_keys: Sequence[str] | None = None) -> DataFrame:
    """`p_podium<suffix>` and `p_top10<suffix>` of each utility, all from the same draws; entries that no draw places are missing.

    Only the first ten of a draw matter. The noise has bounds, so an entry that
    cannot pass the tenth largest utility, even with the largest noise against
    the smallest, is in no draw's first ten and is not drawn at all: sums are
    monotonic in floating point too, so this leaves every share as it is. What is
    left of a contest is drawn in blocks of draws; a contest of which more is left
    than one task should hold is ranked draw by draw.
    """
    names = {i: f"_u{i}" for i in range(len(utilities))}
    rows = df.select(*contest, "driver", *[u.alias(names[i]) for i, u in enumerate(utilities.values())])
    reach = {}
    for i, u in names.items():
        tenth = top_k(rows.select(*contest, "driver", u), contest, [(u, "desc"), ("driver", "asc")], 10)
        tenth = tenth.groupBy(*contest).agg(F.max(F.when(F.col("place") == 10, F.col(u))).alias(f"_t{i}"))
        rows = attach(rows, tenth, contest, calendar=True)
        # Without ten known utilities every entry may be placed.
        reach[i] = F.col(f"_t{i}").isNull() | (F.col(u) + F.lit(draws.GUMBEL_HIGH) >= F.col(f"_t{i}") + F.lit(draws.GUMBEL_LOW))
    rows = rows.withColumns({f"_r{i}": F.coalesce(r, F.lit(False)) for i, r in reach.items()})
    rows = rows.where(reduce(operator.or_, [F.col(f"_r{i}") for i in names])).drop(*[f"_t{i}" for i in names])
    # Written, as the largest contest of what is left is measured before it is drawn.
    rows = materialise(spread(rows, *contest, "driver"), "reachable")
    of = hashed.ranked_draws if has_hot_group(rows, contest) else hashed.hashed_draws
    counts = of(rows, names, n_draws, seed, list(contest), draw_keys or contest)
    shares = [(F.coalesce(F.sum(F.when(F.col("_of") == i, F.col(c))), F.lit(0)) / F.lit(float(n_draws))).alias(name + suffix)
              for i, suffix in enumerate(utilities) for name, c in (("p_podium", "_podium"), ("p_top10", "_top"))]
    return counts.groupBy(*contest, "driver").agg(*shares)


def _nodes(low: float = -46.0, high: float = 5.8, step: float = 0.25) -> list[tuple[float, float]]:
    """Trapezoid rule in log time on (0, inf): points and weights."""
    return [(math.exp(low + step * i), step * math.exp(low + step * i)) for i in range(int((high - low) / step) + 1)]


def exact_podium(df: DataFrame, p="p_win", out="p_podium_exact", contest: Sequence[str] = CONTEST) -> DataFrame:
    """Podium probability without sampling and without enumerating triples.

    Plackett-Luce orders independent exponential arrivals with rates p. An entry
    is in the first three when at most two others arrive before it, so its
    probability is one integral over the arrival time. Contest totals per time
    point replace all pairs and triples: cost grows with rows, not cubes.

    The two largest rates are held apart and enter in closed form; the totals run
    over the rest, scaled by the largest rate of the rest, and time is measured in
    the rest's total rate. So nothing overflows or cancels, however large the
    favourites' rates are.
    """
    rows = df.select(*contest, "driver", F.col(p).cast("double").alias("_p"))
    lead = top_k(rows.where(F.col("_p") > 0), contest, [("_p", "desc"), ("driver", "asc")], 3, "_place")
    pick = lambda c, k: F.max(F.when(F.col("_place") == k, F.col(c)))
    lead = lead.groupBy(*contest).agg(pick("driver", 1).alias("_d1"), pick("_p", 1).alias("_p1"), pick("driver", 2).alias("_d2"),
                                      pick("_p", 2).alias("_p2"), pick("_p", 3).alias("_a"))
    size = rows.where(F.col("_p") > 0).groupBy(*contest).agg(F.count(F.lit(1)).alias("_n"))
    # Tables of one row, or one row per time point, per contest are calendar-sized: rows never shuffle by contest.
    rows = attach(rows, lead.join(size, list(contest)), contest, calendar=True)
    rows = rows.withColumn("_which", F.when(F.col("driver") == F.col("_d1"), 1).when(F.col("driver") == F.col("_d2"), 2).otherwise(0))
    rest = rows.where((F.col("_which") == 0) & (F.col("_p") > 0)).groupBy(*contest).agg(F.sum("_p").alias("_s"))
    rows = attach(rows, rest, contest, calendar=True)
    nodes = F.inline(F.array(*[F.struct(F.lit(u).alias("_u"), F.lit(w).alias("_w")) for u, w in _nodes()]))
    wide = spread(rows.where((F.col("_p") > 0) & (F.col("_n") > 3)), *contest, "driver").select("*", nodes)
    t = F.col("_u") / F.col("_s")
    wide = wide.withColumn("_t", t).withColumn("_o", F.when(F.col("_which") == 0, F.exp((F.col("_p") - F.col("_a")) * F.col("_t"))
                                                            - F.exp(-F.col("_a") * F.col("_t"))).otherwise(0.0))
    sums = wide.groupBy(*contest, "_u").agg(F.sum("_o").alias("_e1"), F.sum(F.col("_o") * F.col("_o")).alias("_s2"))
    both = attach(wide, sums, [*contest, "_u"], calendar=True)
    one = F.col("_e1") - F.col("_o")
    two = (one * one - (F.col("_s2") - F.col("_o") * F.col("_o"))) / 2
    a, s, p1, p2 = (F.col(c) for c in ("_a", "_s", "_p1", "_p2"))
    decay = lambda rate: F.exp(-rate * F.col("_t"))
    # Rates that are left when the named entries have arrived: all is p1 + p2 + s.
    pairs = decay(p1 + p2 + s - 2 * a) * two
    inner = decay(s) + (decay(p2 + s - a) + decay(p1 + s - a) - decay(p1 + p2 + s - a)) * one + pairs
    first = decay(p1 + s) + decay(p1 + s - a) * one + pairs   # for the largest rate
    second = decay(p2 + s) + decay(p2 + s - a) * one + pairs
    term = F.col("_w") * F.col("_p") / s * F.when(F.col("_which") == 1, first).when(F.col("_which") == 2, second).otherwise(inner)
    got = both.groupBy(*contest, "driver").agg(F.sum(term).alias(out))
    few = rows.where(F.col("_p").isNull() | (F.col("_p") <= 0) | (F.col("_n") <= 3)).select(
        *contest, "driver", F.when(F.col("_p").isNull(), F.lit(None).cast("double")).when(F.col("_p") > 0, 1.0).otherwise(0.0).alias(out))
    return same_keys(df, got.unionByName(few), [*contest, "driver"])


def uniform_losses(df: DataFrame, contest: Sequence[str] = CONTEST) -> DataFrame:
    """ln(field size) of every contest with a winner."""
    per = df.groupBy(*contest).agg(F.count(F.lit(1)).alias("_n"), F.max("is_winner").alias("_w"))
    return per.filter(F.col("_w") == 1).select(*contest, F.ln(F.col("_n").cast("double")).alias("uniform_log_loss"))


def podium_briers(df: DataFrame, p="p_podium", contest: Sequence[str] = CONTEST) -> DataFrame:
    """Mean squared error on the podium flag, one row per contest."""
    gap = F.col(p) - F.col("is_podium")
    return df.groupBy(*contest).agg(F.avg(gap * gap).alias("podium_brier"))


def coherence(df: DataFrame, tolerance: float = vocab.COHERENCE_TOLERANCE,
              contest: Sequence[str] = CONTEST) -> DataFrame:
    """One row per broken total or nesting rule."""
    n = F.count(F.lit(1)).cast("double")
    per = df.groupBy(*contest).agg(
        F.struct(F.sum("p_win").alias("total"), F.lit(1.0).alias("expected")).alias("sum_p_win"),
        F.struct(F.sum("p_podium").alias("total"), F.least(F.lit(3.0), n).alias("expected")).alias("sum_p_podium"),
        F.struct(F.sum("p_top10").alias("total"), F.least(F.lit(10.0), n).alias("expected")).alias("sum_p_top10"),
        F.struct(F.max(F.col("p_win") - F.col("p_podium")).alias("total"), F.lit(0.0).alias("expected"))
        .alias("win_over_podium"),
        F.struct(F.max(F.col("p_podium") - F.col("p_top10")).alias("total"), F.lit(0.0).alias("expected"))
        .alias("podium_over_top10"))
    rules = ["sum_p_win", "sum_p_podium", "sum_p_top10", "win_over_podium", "podium_over_top10"]
    long = per.unpivot([*contest], rules, "rule", "v").select(*contest, "rule", "v.total", "v.expected")
    nested = F.col("rule").isin("win_over_podium", "podium_over_top10")
    off = F.when(nested, F.col("total")).otherwise(F.abs(F.col("total") - F.col("expected")))
    return long.filter(off > tolerance)


def select_alpha_spearman(df: DataFrame, score: str, alphas: Sequence[float] = vocab.ALPHA_GRID,
                          contest: Sequence[str] = CONTEST) -> DataFrame:
    """Blend weight with the highest mean rank correlation; ties go to the lowest weight."""
    from .metrics import predicted_rank, spearman
    placed = ranks(df, contest, {"_g": [("grid_position", "asc"), ("driver", "asc")],
                                 "_m": [(score, "desc"), ("grid_position", "asc"), ("driver", "asc")]})
    wide = placed.select(*contest, "driver", "grid_position", "result_order", "_g", "_m",
                         _candidates(alphas, "alpha", "_i"))
    wide = wide.withColumn("_b", F.col("alpha") * F.col("_g") + (1 - F.col("alpha")) * F.col("_m"))
    keys = ["alpha", *contest]
    ranked = predicted_rank(wide, "_b", True, contest=keys)
    mean = (spearman(ranked, keys, "pred_rank", "result_order", "_rho").groupBy("alpha")
            .agg(F.avg("_rho").alias("spearman")))
    return mean.agg(F.max_by("alpha", F.struct(F.round("spearman", 9), -F.col("alpha"))).alias("alpha"),
                    F.max("spearman").alias("spearman"))
