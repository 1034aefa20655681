"""Data-quality reports and leakage audits."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import CONTEST
from ..functions.expr import col


def duplicate_contests(df: DataFrame, keys: Sequence[str], contest: Sequence[str] = CONTEST) -> DataFrame:
    """Contests in which some key occurs more than once."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return twice.select(*contest).distinct()


def overlapping(history: DataFrame, upcoming: DataFrame, contest: Sequence[str] = CONTEST) -> DataFrame:
    """Contests of `upcoming` that already have results."""
    known = history.select(*contest).distinct()
    return upcoming.select(*contest).distinct().join(known, list(contest), "left_semi")


def hollow_contests(df: DataFrame, contest: Sequence[str] = CONTEST) -> DataFrame:
    """Contests with entries but neither any status text nor any point."""
    blank = F.trim(F.coalesce(F.col("status"), F.lit(""))) == ""
    return (df.groupBy(*contest)
            .agg(F.count(F.lit(1)).alias("n_rows"), F.bool_and(blank).alias("_blank"),
                 F.sum(F.coalesce("points", F.lit(0.0))).alias("_points"))
            .filter(F.col("_blank") & (F.col("_points") == 0)).select(*contest, "n_rows"))


def without_hollow(df: DataFrame, contest: Sequence[str] = CONTEST) -> DataFrame:
    """Rows of the contests that carry a real result."""
    return df.join(hollow_contests(df, contest).drop("n_rows"), list(contest), "left_anti")


def coverage_by_season(df: DataFrame) -> DataFrame:
    """Rows, contests, field sizes and holes in the round numbers, per year."""
    per = df.groupBy("year", "round").agg(F.count(F.lit(1)).alias("n"))
    held = F.collect_set("round")
    return per.groupBy("year").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("contests"),
        F.max("round").alias("max_round"), F.min("n").alias("min_field"), F.max("n").alias("max_field"),
        F.array_sort(F.array_except(F.sequence(F.lit(1), F.max("round")), held)).alias("missing_rounds"))


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row of counts, dates, label means and contradictions."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("year", "round").alias("n_contests"),
        F.min("date").alias("date_min"), F.max("date").alias("date_max"),
        F.avg("finished_top10").alias("top10_rate"), F.avg("is_dnf").alias("dnf_rate"),
        F.sum("pit_start").alias("pit_starts"),
        F.count(F.when((F.col("is_dnf") == 1) & (F.col("classified") == 1), 1)).alias("dnf_and_classified"))


def coverage_manifest(expected: DataFrame, ingested: DataFrame, contest: Sequence[str] = CONTEST) -> DataFrame:
    """Requested, ingested and skipped contests per season, and whether it is complete."""
    have = ingested.select(*contest).distinct().withColumn("_have", F.lit(1))
    marked = expected.select(*contest).distinct().join(have, list(contest), "left")
    return marked.groupBy("year").agg(
        F.count(F.lit(1)).alias("requested"), F.count("_have").alias("ingested"),
        F.count(F.when(F.col("_have").isNull(), 1)).alias("skipped"),
        (F.count(F.lit(1)) == F.count("_have")).alias("complete"))


def session_coverage(expected: DataFrame, observed: DataFrame, summaries: DataFrame, contest: Sequence[str] = CONTEST,
                     entity="driver") -> DataFrame:
    """Per expected contest: the practice session used, its entities, and why there is none.

    `observed` are the landed observations, `summaries` the rows of `observe.best_runs`
    over a preferred session.
    """
    keys = list(contest)
    used = summaries.groupBy(*keys).agg(F.max("practice_session").alias("practice_session"), F.count_distinct(entity).alias("n_entities"))
    rows = (expected.select(*keys).distinct().join(observed.select(*keys).distinct().withColumn("_seen", F.lit(True)), keys, "left")
            .join(used, keys, "left"))
    reason = F.when(F.col("_seen").isNull(), "no session").when(F.col("practice_session").isNull(), "no session with long runs")
    return rows.select(*keys, "practice_session", F.coalesce("n_entities", F.lit(0)).alias("n_entities"), reason.alias("reason"))


def missing_counts(df: DataFrame, columns: Sequence[str], allowed: Sequence[str] = ()) -> DataFrame:
    """Columns outside the allow-list that still hold NULLs, with counts, in one pass."""
    checked = [c for c in columns if c not in allowed and c in df.columns]
    one = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in checked])
    return one.unpivot([], checked, "column", "n_missing").filter(F.col("n_missing") > 0)


def mismatches(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str],
               atol: float = 1e-9) -> DataFrame:
    """Per column: rows compared and rows whose values differ (NULL equals NULL)."""
    both = left.select(*keys, *[F.col(c).cast("double").alias(f"a_{c}") for c in columns]).join(
        right.select(*keys, *[F.col(c).cast("double").alias(f"b_{c}") for c in columns]),
        list(keys), "full")
    bad = []
    for c in columns:
        a, b = F.col(f"a_{c}"), F.col(f"b_{c}")
        same = (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= atol, F.lit(False))
        bad.append(F.count(F.when(~same, 1)).alias(c))
    one = both.agg(F.count(F.lit(1)).alias("n_rows"), *bad)
    return one.unpivot(["n_rows"], list(columns), "feature", "n_mismatches")


def naive_history(df: DataFrame, key: Sequence[str], wanted: Mapping[str, tuple[Column, int | None]],
                  contest: Sequence[str] = CONTEST) -> DataFrame:
    """Audit path: each contest of a key with the mean of its strictly earlier ones, or of the last n of these.

    Independent of the window path and linear: rows are reduced to one per (key,
    contest) and sorted by key and date, then one running fold passes over them
    in numpy; all of a key's histories share the pass. A contest without a date
    has no past and is nobody's past. A key's contests, no more than the
    calendar has, are held at once.
    """
    key, contest = list(key), list(contest)
    sums = [F.sum(v).cast("double").alias(f"_s{i}") for i, (v, _) in enumerate(wanted.values())]
    known = [F.count(v).alias(f"_c{i}") for i, (v, _) in enumerate(wanted.values())]
    per = df.groupBy(*key, *contest).agg(F.unix_micros(F.min("date").cast("timestamp")).alias("_at"), *sums, *known)
    rows = per.repartition(*key).sortWithinPartitions(*key, F.col("_at").asc_nulls_last(), *contest)
    outs, lasts = list(wanted), [last for _, last in wanted.values()]
    schema = T.StructType([*per.select(*key, *contest).schema.fields, *[T.StructField(o, T.DoubleType()) for o in wanted]])
    return rows.mapInPandas(lambda b: _folded(b, key, contest, outs, lasts), schema)


def _folded(batches: Iterator[pd.DataFrame], key: list[str], contest: list[str], outs: list[str],
            lasts: list[int | None]) -> Iterator[pd.DataFrame]:
    """Past means of rows sorted by (key, time); the last key of a batch waits for the next batch."""
    waiting = None
    for batch in batches:
        rows = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
        starts = np.flatnonzero(_changes(rows[key]))
        if len(starts) == 0:
            continue
        waiting = rows.iloc[starts[-1]:]
        if starts[-1]:
            yield _past_means(rows.iloc[:starts[-1]], key, contest, outs, lasts)
    if waiting is not None and len(waiting):
        yield _past_means(waiting, key, contest, outs, lasts)


def _changes(columns: pd.DataFrame) -> np.ndarray:
    """Whether a row differs from the one before; missing values are equal."""
    new = np.zeros(len(columns), bool)
    new[:1] = True
    for c in columns:
        code, _ = pd.factorize(columns[c], use_na_sentinel=False)
        new[1:] |= code[1:] != code[:-1]
    return new


def _past_means(rows: pd.DataFrame, key: list[str], contest: list[str], outs: list[str], lasts: list[int | None]) -> pd.DataFrame:
    at = np.arange(len(rows))
    new_key = _changes(rows[key])
    first = np.maximum.accumulate(np.where(new_key, at, 0))
    end = np.maximum.accumulate(np.where(_changes(rows[[*key, "_at"]]), at, 0))  # the past ends before the row's own date
    made = rows[[*key, *contest]].copy()
    dated = rows["_at"].notna().to_numpy()
    for i, (out, last) in enumerate(zip(outs, lasts, strict=True)):
        start = first if last is None else np.maximum(first, end - last)
        total, n = (np.concatenate([[0], np.cumsum(rows[f"_{c}{i}"].fillna(0).to_numpy(np.longdouble))]) for c in "sc")
        count = np.where(dated, n[end] - n[start], 0)
        made[out] = np.where(count > 0, (total[end] - total[start]) / np.maximum(count, 1), np.nan).astype(float)
        made[out] = made[out].astype(object).where(count > 0, None)
    return made


def first_rows(df: DataFrame, keys: Sequence[str], time="date") -> DataFrame:
    """The first contest row(s) of each key, by an aggregate and a join rather than a sort."""
    first = df.groupBy(*keys).agg(F.min(time).alias("_first"))
    return (df.join(first, list(keys)).filter(F.col(time) == F.col("_first")).drop("_first"))


def debut_report(features: DataFrame, entity="driver", venue="circuit_id") -> DataFrame:
    """Rule violations at the first appearance of an entity and at each first venue visit."""
    unknown = ("form_avg_finish_3", "form_avg_points_3", "form_avg_quali_3", "form_dnf_rate_5",
               "season_avg_finish", "momentum", "driver_overall_avg_finish", "driver_wet_delta",
               "driver_circuit_avg_finish", "driver_circuit_best_finish",
               "driver_circuit_podium_rate", "driver_dnf_rate")
    zero = ("driver_wet_n", "driver_races_at_circuit", "quali_gap_to_teammate",
            "form_finish_vs_teammate", "teammate_available")
    at_venue = ("driver_circuit_avg_finish", "driver_circuit_best_finish", "driver_circuit_podium_rate")

    def count_bad(df, rule, conditions):
        one = df.agg(F.count(F.lit(1)).alias("n_rows"),
                     *[F.count(F.when(c, 1)).alias(n) for n, c in conditions.items()])
        return (one.unpivot(["n_rows"], list(conditions), "feature", "n_violations")
                .select(F.lit(rule).alias("rule"), "feature", "n_rows", "n_violations"))

    debut = first_rows(features, [entity])
    visit = first_rows(features, [entity, venue])
    return (count_bad(debut, "debut_unknown", {c: F.col(c).isNotNull() for c in unknown})
            .unionByName(count_bad(debut, "debut_zero", {c: F.coalesce(col(c), F.lit(0)) != 0 for c in zero}))
            .unionByName(count_bad(visit, "first_visit_unknown", {c: F.col(c).isNotNull() for c in at_venue})))


def differing_sections(frozen: DataFrame, current: DataFrame) -> DataFrame:
    """Sections of a (section, key, value) record that differ in either direction."""
    cols = ["section", "key", "value"]
    a, b = frozen.select(*cols), current.select(*cols)
    gone = a.exceptAll(b).withColumn("side", F.lit("frozen"))
    new = b.exceptAll(a).withColumn("side", F.lit("current"))
    return gone.unionByName(new).groupBy("section").agg(
        F.count(F.when(F.col("side") == "frozen", 1)).alias("only_frozen"),
        F.count(F.when(F.col("side") == "current", 1)).alias("only_current"))
