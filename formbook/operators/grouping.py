"""Group-wise building blocks that survive a hot group.

A contest is one group, and one contest may hold a large share of all rows, so
nothing here sends a whole group to one task once the group is large:

* totals are partial aggregates joined back (`attach`), never windows;
* ranks are a window for small groups and a range-split sort for large ones;
  both forms give the same rows and values, NULL keys and NULL values included,
  so the measured size decides the plan only;
* quantiles are selected inside brackets that a mergeable sketch gives.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import col
from ..session import hot_group_rows, materialise

Order = tuple  # (column name, "asc" | "desc")


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[str], calendar: bool = False,
           salts: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Left-join a one-row-per-key `table` back onto `rows`.

    `calendar=True` states that the keys are dated contests: the table then has
    one row per calendar slot whatever the data volume, which bounds the
    broadcast. Otherwise the join shuffles, and `salts` spreads the rows of one
    key over that many tasks by repeating the small table; they are told by the
    columns `by`, or by all, which then must all be carried to the join.
    """
    if calendar:
        return rows.join(F.broadcast(table), list(keys), "left")
    if salts > 1:
        names = by or rows.columns
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*names), F.lit(salts)).cast("int"))
        spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return salted.join(spread, [*keys, "_salt"], "left").drop("_salt")
    return rows.join(table, list(keys), "left")


def with_row(rows: DataFrame, one: DataFrame) -> DataFrame:
    """Attach the columns of a one-row table: an aggregate without keys, so never a product."""
    return rows.crossJoin(F.broadcast(one))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over the full shuffle width before they are multiplied.

    A small input sits in few partitions; an expansion by draws or candidates
    would then run in few tasks. The partition count is explicit, so adaptive
    coalescing (which sees only the small input) leaves it alone.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(width, *keys)


# Rows that one task of a chain of windows should hold: each of its windows sorts or buffers wide rows.
WINDOW_ROWS = 50_000


def sized(rows: DataFrame, *keys: str) -> DataFrame:
    """Hash rows into as many partitions as their number asks for, so that a task's share does not grow with the input.

    The shuffle width is fixed and adaptive coalescing goes by compressed bytes; windows over many columns hold far more.
    """
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-rows.count() // WINDOW_ROWS)), *keys)


def group_totals(rows: DataFrame, keys: Sequence[str], totals: Mapping[str, Column],
                 calendar: bool = False, salts: int = 1) -> DataFrame:
    """Attach aggregates of each group to its rows."""
    table = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()])
    return attach(rows, table, keys, calendar, salts)


def has_hot_group(rows: DataFrame, keys: Sequence[str], limit: int | None = None) -> bool:
    """Whether some group has more rows than one task should hold."""
    limit = hot_group_rows(rows.sparkSession) if limit is None else limit
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return not sizes.filter(F.col("n") > limit).select("n").limit(1).isEmpty()


def _ordering(order: Sequence[Order]) -> list[Column]:
    return [col(c).desc_nulls_last() if d == "desc" else col(c).asc_nulls_last() for c, d in order]


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL; the keys are kept once."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = one if cond is None else cond & one
    return left.join(right, cond, how).drop(*[f"_r_{k}" for k in keys])


def _split_rank(rows: DataFrame, keys: Sequence[str], order: Sequence[Order], out: str, parts: bool = False) -> DataFrame:
    """Row numbers by one global sort: place = rows before me - rows before my group.

    The sort is range-partitioned on keys and order, so a hot group spreads over
    as many tasks as its size needs. The sorted table is written once; the
    offsets hold one row per file part (bounded by the shuffle width). A group's
    first index and size reach its rows by (keys, part), so no join brings a hot
    group together. NULL keys are one group. `parts` keeps `_part` and `_size`.
    """
    by_place = rows.orderBy(*[F.col(k) for k in keys], *_ordering(order))
    placed = materialise(by_place.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part, slot = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumn("_part", part.cast("int")).withColumn("_slot", slot).drop("_at")

    before = (Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = (placed.groupBy("_part").agg((F.max("_slot") + 1).alias("_n"))
               .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    indexed = (placed.join(F.broadcast(offsets), "_part")
               .withColumn("_index", F.col("_off") + F.col("_slot")))
    group = Window.partitionBy(*keys)  # one row per part of a group
    first = indexed.groupBy(*keys, "_part").agg(F.min("_index").alias("_low"), F.count(F.lit(1)).alias("_here"))
    first = first.select(*keys, "_part", F.min("_low").over(group).alias("_first"), F.sum("_here").over(group).alias("_size"))
    ranked = (same_keys(indexed, first, [*keys, "_part"])
              .withColumn(out, (F.col("_index") - F.col("_first") + 1).cast("int"))
              .drop("_slot", "_off", "_index", "_first"))
    return ranked if parts else ranked.drop("_part", "_size")


def ranks(rows: DataFrame, keys: Sequence[str], specs: Mapping[str, Sequence[Order]],
          split: bool | None = None) -> DataFrame:
    """Deterministic 1..n places per group, NULL last. Orders must end in a unique id.

    `split=None` measures the largest group and picks the window or the
    range-split sort.
    """
    if split is None:
        split = has_hot_group(rows, keys)
    for out, order in specs.items():
        if split:
            rows = _split_rank(rows, keys, order, out)
        else:
            w = Window.partitionBy(*keys).orderBy(*_ordering(order))
            rows = rows.withColumn(out, F.row_number().over(w))
    return rows


def tie_ranks(rows: DataFrame, keys: Sequence[str], value: str, out: str, tie: Sequence[str],
              split: bool | None = None) -> DataFrame:
    """Ascending ranks where equal values share the mean of their places."""
    if split is None:
        split = has_hot_group(rows, keys)
    if not split:
        by_value = Window.partitionBy(*keys).orderBy(col(value).asc_nulls_last())
        same = Window.partitionBy(*keys, value)
        return rows.withColumn(
            out, F.rank().over(by_value) + (F.count(F.lit(1)).over(same) - 1) / F.lit(2.0))
    placed = _split_rank(rows, keys, [(value, "asc"), *[(t, "asc") for t in tie]], "_place", parts=True)
    # Equal values, NULLs among them, stand together: the mean of their places is that of the first and last.
    equal = Window.partitionBy(*keys, value)
    shared = placed.groupBy(*keys, value, "_part").agg(F.min("_place").alias("_lo"), F.max("_place").alias("_hi"))
    shared = shared.select(*keys, value, "_part",
                           ((F.min("_lo").over(equal) + F.max("_hi").over(equal)) / F.lit(2.0)).alias(out))
    return same_keys(placed.drop("_place", "_size"), shared, [*keys, value, "_part"]).drop("_part")


def top_k(rows: DataFrame, keys: Sequence[str], order: Sequence[Order], k: int,
          out: str = "place") -> DataFrame:
    """The first k rows of each group.

    The rank filter lets Spark keep k rows per group in every map task before
    the shuffle, so a hot group reaches the final sort already cut down.
    """
    w = Window.partitionBy(*keys).orderBy(*_ordering(order))
    return rows.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


# Ranks of a sketch are off by at most a share 1 / accuracy; a bracket keeps four times that to each side.
SKETCH_ACCURACY = 10_000


def group_quantiles(rows: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float]],
                    extra: Mapping[str, Column] | None = None, having: Column | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per group; NULLs are skipped, NULL keys are a group.

    Distributed selection in one plan at any group size, without a job while
    planning. A mergeable sketch brackets each wanted rank; the rows below a
    bracket are only counted, those inside are counted by value, both map-side.
    The running count over a bracket's values, a share 8 / `SKETCH_ACCURACY` of
    its group's rows, holds the exact rank. Should a sketch ever break its error
    bound the query fails instead of answering. `extra` aggregates of the same
    groups share the pass of the sketches.
    """
    asked = list(enumerate(wanted.items()))
    slack = 4.0 / SKETCH_ACCURACY
    aggs = [c.alias(n) for n, c in (extra or {}).items()]
    for i, (_, (value, q)) in asked:
        x = col(value).cast("double")
        ends = F.array(*[F.lit(min(max(p, 0.0), 1.0)) for p in (q - slack, q + slack)])
        aggs += [F.count(x).alias(f"_n{i}"), F.min(x).alias(f"_min{i}"), F.max(x).alias(f"_max{i}"),
                 F.percentile_approx(x, ends, SKETCH_ACCURACY).alias(f"_b{i}")]
    table = rows.groupBy(*keys).agg(*aggs)
    table = table if having is None else table.where(having)

    bounds = table.select(*keys, *[F.struct(
        F.col(f"_n{i}").alias("n"), (F.col(f"_min{i}") if q <= slack else F.col(f"_b{i}")[0]).alias("lo"),
        (F.col(f"_max{i}") if q >= 1 - slack else F.col(f"_b{i}")[1]).alias("hi")).alias(f"_e{i}") for i, (_, (_, q)) in asked])
    values = list(dict.fromkeys(value for value, _ in wanted.values()))
    near = same_keys(rows.select(*keys, *values), bounds, keys)
    tags = []
    for i, (_, (value, _)) in asked:
        x, e = col(value).cast("double"), F.col(f"_e{i}")
        tags.append(F.when(x.isNotNull(), F.struct(
            F.lit(i).alias("_i"), F.when((x >= e["lo"]) & (x <= e["hi"]), x).alias("_x"), F.when(x <= e["hi"], 1).otherwise(0).alias("_upto"),
            F.when(x < e["lo"], x).alias("_under"), F.when(x > e["hi"], x).alias("_over"), e["n"].alias("_n"))))
    counted = (near.select(*keys, F.inline(F.filter(F.array(*tags), lambda t: t.isNotNull()))).groupBy(*keys, "_i", "_x")
               .agg(F.sum("_upto").alias("_c"), F.max("_under").alias("_under"), F.min("_over").alias("_over"), F.max("_n").alias("_n")))
    upto = Window.partitionBy(*keys, "_i").orderBy(F.col("_x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_upto", F.sum("_c").over(upto))
    # A short group's neighbouring rank may be the first value beyond its bracket.
    picks, values_of = [], []
    for i, (out, (_, q)) in asked:
        at, mine = (F.col("_n") - 1) * F.lit(float(q)), F.col("_i") == i
        for name, rank in (("low", F.floor(at)), ("high", F.ceil(at))):
            holds = mine & (F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank)
            picks.append(F.max(F.when(holds, F.col("_x"))).alias(f"_{name}{i}"))
        picks += [F.max(F.when(mine & F.col("_x").isNull(), F.col("_c"))).alias(f"_below{i}"), F.max(F.when(mine, F.col("_upto"))).alias(f"_all{i}"),
                  F.max(F.when(mine, F.col("_under"))).alias(f"_under{i}"), F.min(F.when(mine, F.col("_over"))).alias(f"_over{i}"),
                  F.max(F.when(mine, at)).alias(f"_at{i}")]
        at = F.col(f"_at{i}")
        low, high = (F.coalesce(f"_{name}{i}", F.when(rank == F.col(f"_below{i}") - 1, F.col(f"_under{i}")),
                                F.when(rank == F.col(f"_all{i}"), F.col(f"_over{i}"))) for name, rank in (("low", F.floor(at)), ("high", F.ceil(at))))
        # Weighed, not stepped from the lower value: the rounding is then that of SQL engines, so near ties fall alike.
        share = at - F.floor(at)
        values_of.append((low * (1 - share) + high * share).alias(out))
    chosen = ranked.groupBy(*keys).agg(*picks).select(*keys, *values_of)
    found = same_keys(table.drop(*[f"{c}{i}" for i, _ in asked for c in ("_min", "_max", "_b")]), chosen, keys, "left")
    checked = [F.when(F.col(f"_n{i}") == 0, F.lit(None).cast("double")).when(F.col(out).isNotNull(), F.col(out)).otherwise(
        F.raise_error(F.lit("a quantile left its bracket")).cast("double")).alias(out) for i, (out, _) in asked]
    return found.select(*keys, *(extra or {}), *checked)
