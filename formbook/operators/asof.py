"""Point-in-time history: every value is built from strictly earlier events.

Three shapes, by how many rows one key can have:

* `past_*` columns: keys with one row per dated contest. A history is then no
  longer than the calendar, so a window per key is safe.
* `past_by_contest`: keys with many rows per contest (a group). Rows are first
  summed to one row per (key, contest), the window runs over that, and the
  result is joined back; the whole current contest is excluded.
* `long_*`: event streams where one key may hold any number of rows, at any
  times: prefix scans over measured parts of the order (`scan`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .. import CONTEST
from ..functions.expr import col, ratio
from .grouping import attach, same_keys
from .scan import prefix_scan


def event_us(time="date") -> Column:
    """Event time as a long, so that RANGE frames can exclude peers."""
    return F.unix_micros(col(time).cast("timestamp"))


def before(keys: Sequence[str], time="date") -> WindowSpec:
    """All rows of the key at strictly earlier event times."""
    return (Window.partitionBy(*keys).orderBy(event_us(time))
            .rangeBetween(Window.unboundedPreceding, -1))


def past_mean(keys, value, time="date") -> Column:
    return F.avg(col(value)).over(before(keys, time))


def past_min(keys, value, time="date") -> Column:
    return F.min(col(value)).over(before(keys, time))


def past_sum(keys, value, time="date") -> Column:
    """NULL without history. A NULL value is skipped rather than poisoning the next row."""
    return F.sum(col(value)).over(before(keys, time))


def past_count(keys, time="date") -> Column:
    return F.count(F.lit(1)).over(before(keys, time))


def past_rolling_mean(keys, value, n: int, time="date") -> Column:
    """Mean of the last n rows; a NULL occupies a slot. One row per (key, contest)."""
    w = Window.partitionBy(*keys).orderBy(event_us(time)).rowsBetween(-n, -1)
    return F.avg(col(value)).over(w)


def past_mean_where(keys, value, mask: Column, time="date") -> Column:
    """Past mean over the rows where `mask` holds."""
    return F.avg(F.when(mask, col(value))).over(before(keys, time))


def past_count_where(keys, mask: Column, time="date") -> Column:
    return F.count(F.when(mask, F.lit(1))).over(before(keys, time))


# Weights are powers of two within blocks of so many half-lives; what is older than
# the block before has a weight below 2^-60 and vanishes in double precision.
BLOCK_HALF_LIVES = 60


class PastEwm(NamedTuple):
    """A requested exponentially weighted mean: `with_past_ewm` turns it into a column."""

    keys: Sequence[str]
    value: Column
    half_life: float
    time: str


def past_ewm(keys, value, half_life: float, time="date") -> PastEwm:
    """Exponentially weighted past mean; NULL values take no step.

    Weight of the i-th of n known values is 2^((i - n) / half_life); rows at one
    time share a step. Histories may have any length.
    """
    return PastEwm(keys, col(value), float(half_life), time)


def with_past_ewm(df: DataFrame, wanted: Mapping[str, PastEwm]) -> DataFrame:
    """Add `past_ewm` columns, each step of all of them in one select.

    A known value's step is cut into a block and a weight that grows inside the
    block, so nothing overflows. The mean up to a value adds its own block's
    earlier sums and the whole block before, faded by a block; a row takes the
    mean up to the last value that is strictly earlier.
    """
    names = df.columns
    asked = list(enumerate(wanted.items()))

    def added(rows: DataFrame, make) -> DataFrame:
        return rows.select("*", *[c for i, (_, p) in asked for c in make(i, p)])

    def size(p: PastEwm) -> int:
        return max(1, round(BLOCK_HALF_LIVES * p.half_life))

    def step(i, p):
        upto = (Window.partitionBy(*p.keys).orderBy(event_us(p.time))
                .rangeBetween(Window.unboundedPreceding, Window.currentRow))
        return [p.value.cast("double").alias(f"_x{i}"), F.count(p.value).over(upto).alias(f"_n{i}")]

    def weight(i, p):
        n = F.col(f"_n{i}")
        return [F.floor(n / size(p)).alias(f"_k{i}"),
                F.when(F.col(f"_x{i}").isNotNull(), F.pow(F.lit(2.0), F.pmod(n, F.lit(size(p))) / F.lit(p.half_life))).alias(f"_g{i}")]

    def mean(i, p):
        block = (Window.partitionBy(*p.keys, f"_k{i}").orderBy(event_us(p.time))
                 .rangeBetween(Window.unboundedPreceding, Window.currentRow))
        older = Window.partitionBy(*p.keys).orderBy(f"_k{i}").rangeBetween(-1, -1)
        fade = F.lit(2.0 ** (-size(p) / p.half_life))

        def total(c):
            return F.sum(c).over(block) + F.coalesce(fade * F.sum(c).over(older), F.lit(0.0))

        g = F.col(f"_g{i}")
        return [F.when(g.isNotNull(), total(F.col(f"_x{i}") * g) / total(g)).alias(f"_m{i}")]

    rows = added(added(added(df, step), weight), mean)
    return rows.select(*names, *[F.last(f"_m{i}", ignorenulls=True).over(before(p.keys, p.time)).alias(out) for i, (out, p) in asked])


# --- groups with several rows per contest ------------------------------------
def contest_sums(df: DataFrame, group: Sequence[str], values: Mapping[str, Column | str],
                 contest: Sequence[str] = CONTEST, time="date", extra: Sequence[str] = ()) -> DataFrame:
    """One row per (group, contest): `<name>_s` sums and `<name>_c` known-value counts."""
    parts = [F.min(time).alias(time), *[F.min(e).alias(e) for e in extra]]
    for name, v in values.items():
        parts += [F.sum(col(v)).alias(f"{name}_s"), F.count(col(v)).alias(f"{name}_c")]
    return df.groupBy(*group, *contest).agg(*parts)


def prior_ratio(keys: Sequence[str], name: str, time="date") -> Column:
    """Past mean over `contest_sums` rows, the whole current contest excluded."""
    w = before(keys, time)
    return ratio(F.sum(f"{name}_s").over(w), F.sum(f"{name}_c").over(w))


def past_by_contest(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column | str],
                    contest: Sequence[str] = CONTEST, time="date", salts: int = 8) -> DataFrame:
    """Past means that leave out every row of the current contest, attached to `df`."""
    per = contest_sums(df, keys, values, contest, time)
    per = per.select(*keys, *contest, *[prior_ratio(keys, n, time).alias(n) for n in values])
    return attach(df, per, [*keys, *contest], salts=salts)


def past_ewm_by_contest(df: DataFrame, keys: Sequence[str], value: str,
                        half_lives: Mapping[str, float], contest: Sequence[str] = CONTEST,
                        time="date", salts: int = 8) -> DataFrame:
    """Exponentially weighted past mean of the group's contest means."""
    per = (df.groupBy(*keys, *contest)
           .agg(F.min(time).alias(time), F.avg(value).alias("_v")))
    per = with_past_ewm(per, {out: past_ewm(keys, "_v", h, time) for out, h in half_lives.items()})
    return attach(df, per.select(*keys, *contest, *half_lives), [*keys, *contest], salts=salts)


# --- long histories ------------------------------------------------------------
def long_prefix(df: DataFrame, keys: Sequence[str], time: str,
                wanted: Mapping[str, tuple[str, Column | str]], tie: Sequence[str] | None = None,
                inclusive: bool = False, reverse: bool = False) -> DataFrame:
    """Running sum / count / min / max over earlier events of each key.

    `wanted` maps output name to (fold, value). With `tie`, earlier means lower
    in (time, tie); without it, rows at the same time are peers and excluded
    (or included with `inclusive`). `reverse` looks at later events instead. A
    prefix scan: neither a key nor an instant meets in one task.
    """
    at = -event_us(time) if reverse else event_us(time)
    ties = None if tie is None else [-F.col(t) if reverse else F.col(t) for t in tie]
    return prefix_scan(df, keys, at, wanted, ties, inclusive)


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str,
              right_time: str, payload: Sequence[str], right_tie: str,
              allow_exact: bool = False, direction: str = "backward",
              tolerance_seconds: float | None = None, suffix: str = "") -> DataFrame:
    """The nearest earlier (or later) right row of the same key for every left row.

    Strict unless `allow_exact`. Both sides are unioned; the right payload
    travels as one struct led by its time, so the running maximum of that
    struct is the last right row and NULL payload fields survive. Equal right
    times resolve to the highest `right_tie`. `tolerance_seconds` blanks
    matches further away.
    """
    forward = direction == "forward"
    names = left.columns
    sign = -1 if forward else 1
    pack = F.struct((F.lit(sign) * event_us(right_time)).alias("_rt"),
                    F.col(right_tie).alias("_tie"), *[F.col(p) for p in payload])
    left_side = left.select(F.struct(*[F.col(c) for c in names]).alias("_left"),
                            *[F.col(b) for b in by], col(left_time).alias("_time"))
    right_side = right.dropna(subset=list(by)).select(  # a NULL key matches nothing
        *[F.col(b) for b in by], col(right_time).alias("_time"), pack.alias("_right"))
    both = left_side.unionByName(right_side, allowMissingColumns=True)
    found = long_prefix(both, by, "_time", {"_match": ("max", "_right")},
                        inclusive=allow_exact, reverse=forward).filter(F.col("_left").isNotNull())
    hit = F.col("_match").isNotNull()
    if tolerance_seconds is not None:
        gap = F.abs(event_us("_time") - F.lit(sign) * F.col("_match._rt"))
        hit = hit & (gap <= F.lit(int(tolerance_seconds * 1e6)))
    return found.select(
        "_left.*", *[F.when(hit, F.col("_match")[p]).alias(p + suffix) for p in payload])


def long_ewm_state(df: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str], value: str,
                   half_life: float, also: Mapping[str, tuple[str, Column | str]] | None = None) -> DataFrame:
    """Weighted sum `num`, weight `den` and count `seen` of the known values before each row.

    `also` names further running folds that share the scan.

    Known values are numbered per key and cut into blocks of 60 half-lives.
    Inside a block the closed form cannot overflow; older than the previous
    block a weight is below 2^-60 and vanishes in double precision. No task
    holds more than one block of a key.
    """
    h, size = float(half_life), int(60 * half_life)
    rows = long_prefix(df, keys, time, {"seen": ("count", value), **(also or {})}, tie=tie)
    known = (rows.filter(col(value).isNotNull())
             .select(*keys, (F.col("seen") + 1).alias("seen"), col(value).cast("double").alias("_x"))
             .withColumn("_block", F.floor((F.col("seen") - 1) / size))
             .withColumn("_grow", F.pow(F.lit(2.0), ((F.col("seen") - 1) % size) / F.lit(h))))
    upto = (Window.partitionBy(*keys, "_block").orderBy("seen")
            .rowsBetween(Window.unboundedPreceding, 0))
    state = known.select(*keys, "seen", "_block", "_grow",
                         (F.sum(F.col("_x") * F.col("_grow")).over(upto) / F.col("_grow")).alias("_a"),
                         (F.sum("_grow").over(upto) / F.col("_grow")).alias("_b"))
    ends = (state.filter(F.col("seen") % size == 0)
            .select(*keys, (F.col("_block") + 1).alias("_block"),
                    F.col("_a").alias("_ea"), F.col("_b").alias("_eb")))
    fade = F.pow(F.lit(2.0), F.lit(-1.0 / h)) / F.col("_grow")
    state = (same_keys(state, ends, [*keys, "_block"], "left")
             .select(*keys, "seen", (F.col("_a") + F.coalesce(F.col("_ea") * fade, F.lit(0.0))).alias("num"),
                     (F.col("_b") + F.coalesce(F.col("_eb") * fade, F.lit(0.0))).alias("den")))
    return same_keys(rows, state, [*keys, "seen"], "left")


def long_ewm(df: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str], value: str,
             half_life: float, out: str) -> DataFrame:
    """Exponentially weighted past mean for histories of any length."""
    state = long_ewm_state(df, keys, time, tie, value, half_life)
    return state.select(*df.columns, (F.col("num") / F.col("den")).alias(out))


def long_rolling_mean(df: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str], value: str,
                      n: int, out: str) -> DataFrame:
    """Mean of the last n rows for histories of any length; a NULL occupies a slot.

    Rows are numbered per key; each row then serves the n rows after it, so the
    mean is a partial aggregate on (key, number) instead of a window per key.
    """
    rows = long_prefix(df, keys, time, {"_i": ("count", F.lit(1))}, tie=tie)
    serves = (rows.select(*keys, F.col(value).alias("_v"),
                          F.explode(F.sequence(F.col("_i") + 1, F.col("_i") + n)).alias("_i"))
              .groupBy(*keys, "_i").agg(F.avg("_v").alias(out)))
    return same_keys(rows, serves, [*keys, "_i"], "left").drop("_i")
