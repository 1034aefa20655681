"""Starting-order contract for all contests at once: violations are rows, not exceptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import CONTEST
from ..functions import vocab
from ..functions.expr import flag
from .grouping import attach, ranks

K = list(CONTEST)


def violations(grid: DataFrame, roster: DataFrame, contest: Sequence[str] = CONTEST) -> DataFrame:
    """One row per (contest, rule, offender).

    Rules: an entity named twice, a roster member without information, a name
    outside the roster, an on-grid entry without a place, a place used twice, a
    place outside 1..n.
    """
    keys = list(contest)
    who, place = F.col("driver").cast("string"), F.col("grid_position")

    def rows(df: DataFrame, rule: str, offender: Column) -> DataFrame:
        return df.select(*keys, F.lit(rule).alias("rule"), offender.alias("offender"))

    twice = grid.groupBy(*keys, "driver").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    absent = roster.select(*keys, "driver").join(grid.select(*keys, "driver"), [*keys, "driver"], "left_anti")
    extra = grid.select(*keys, "driver").join(roster.select(*keys, "driver"), [*keys, "driver"], "left_anti")
    sizes = grid.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    on_grid = attach(grid.filter(F.col("pit_start") == 0), sizes, keys, calendar=True)
    blank = on_grid.filter(place.isNull())
    shared = (on_grid.filter(place.isNotNull()).groupBy(*keys, "grid_position")
              .agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1))
    outside = on_grid.filter((place < 1) | (place > F.col("_size"))).select(*keys, "grid_position").distinct()
    number = place.cast("bigint").cast("string")
    out = rows(twice, "duplicate_entity", who)
    for part in (rows(absent, "absent_from_grid", who), rows(extra.distinct(), "not_in_roster", who),
                 rows(blank, "missing_place", who), rows(shared, "repeated_place", number),
                 rows(outside, "place_out_of_range", number)):
        out = out.unionByName(part)
    return out


def confirmed(roster: DataFrame, grid: DataFrame, pit_starts: DataFrame,
              contest: Sequence[str] = CONTEST) -> DataFrame:
    """Published order: declared pit starts go to the back, absence stays a missing place."""
    keys = [*contest, "driver"]
    sizes = roster.groupBy(*contest).agg(F.count(F.lit(1)).cast("double").alias("_size"))
    pit = pit_starts.select(*keys).distinct().withColumn("_pit", F.lit(1))
    places = grid.select(*keys, F.col("grid_position").alias("_place"))
    out = attach(roster.select(*keys), sizes, contest, calendar=True)
    out = out.join(places, keys, "left").join(pit, keys, "left")
    return out.select(
        *keys, F.when(F.col("_pit") == 1, F.col("_size")).otherwise(F.col("_place")).alias("grid_position"),
        F.coalesce("_pit", F.lit(0)).alias("pit_start"), F.lit(vocab.CONFIRMED).alias("grid_status"),
        flag(F.col("_pit").isNull() & F.col("_place").isNull()).alias("is_error"))


def provisional(entries: DataFrame, quali: str, pit: str = "pit_start", status: str = vocab.PROVISIONAL,
                contest: Sequence[str] = CONTEST) -> DataFrame:
    """Order closed up from qualifying: pit starters out, no time last, id breaks ties.

    With `quali` set to prior form and status `assumed` this is the guess used
    before qualifying has run.
    """
    sizes = entries.groupBy(*contest).agg(F.count(F.lit(1)).cast("double").alias("_size"))
    # Pit starters sort behind everyone, so the others close up without gaps.
    placed = ranks(entries, contest, {"_r": [(pit, "asc"), (quali, "asc"), ("driver", "asc")]})
    placed = attach(placed, sizes, contest, calendar=True)
    return placed.select(
        *contest, "driver", F.col(quali).cast("double").alias("qualifying_position"),
        F.when(F.col(pit) == 1, F.col("_size")).otherwise(F.col("_r").cast("double")).alias("grid_position"),
        F.col(pit).alias("pit_start"), F.lit(status).alias("grid_status"))


def snapshot(grid: DataFrame, source: str, cutoff: Column, notes: Sequence[str] = (),
             contest: Sequence[str] = CONTEST) -> DataFrame:
    """Status and provenance of each contest's order."""
    return grid.groupBy(*contest).agg(
        F.max("grid_status").alias("status"), F.lit(source).alias("source"),
        F.max(cutoff.cast("string")).alias("cutoff_utc"), F.count(F.lit(1)).cast("int").alias("field_size"),
        F.count(F.when(F.col("pit_start") == 1, 1)).cast("int").alias("n_pit_starts"),
        F.array_join(F.array(*[F.lit(n) for n in notes]), "; ").alias("notes")) \
        .withColumn("is_post_qualifying", F.col("status").isin(vocab.CONFIRMED, vocab.PROVISIONAL))


def overlay(rows: DataFrame, grid: DataFrame, contest: Sequence[str] = CONTEST) -> DataFrame:
    """Places and pit starts of a snapshot laid over forecast rows."""
    keys = [*contest, "driver"]
    new = grid.select(*keys, F.col("grid_position").alias("_g"), F.col("pit_start").alias("_p"))
    return (rows.join(new, keys, "left")
            .withColumns({"grid_position": F.coalesce("_g", "grid_position"),
                          "pit_start": F.coalesce("_p", "pit_start")}).drop("_g", "_p"))


def quality_by_status(per_contest: DataFrame, snapshots: DataFrame, metrics: Sequence[str],
                      contest: Sequence[str] = CONTEST) -> DataFrame:
    """Mean metrics by the status of the order a forecast was made against."""
    return (per_contest.join(F.broadcast(snapshots.select(*contest, "status")), list(contest))
            .groupBy("status").agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("n_contests")))
