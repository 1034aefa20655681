"""Hand fixtures for the contest operators."""

import itertools
import math
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from formbook.functions import text, vocab
from formbook.operators import (features, folds, gates, grid, impute, labels, metrics, models, observe,
                                probability, quality, records, stats)
from formbook.session import scratch_path as scratch
from formbook.sources import files, schema

K = ["year", "round"]


def column(df, expr):
    return [r[0] for r in df.select(expr).collect()]


@pytest.mark.parametrize("status,want", [
    ("Finished", "finished"), ("+1  Lap", "finished"), ("+12 laps", "finished"), (" Lapped ", "finished"),
    ("Retired", "retired_unspecified"), ("Engine", "mechanical"), ("Spun off", "accident"),
    ("Did not start", "did_not_start"), ("", "unknown"), (None, "unknown"), ("Teleported", "unknown")])
def test_status_category(frame, status, want):
    assert column(frame("s string", (status,)), text.status_category("s")) == [want]


@pytest.mark.parametrize("raw,want", [("1", True), ("12.0", True), ("R", False), ("d", False), ("", None),
                                      ("nan", None), (None, None), ("x", None)])
def test_classification(frame, raw, want):
    assert column(frame("s string", (raw,)), text.classification_flag("s")) == [want]


@pytest.mark.parametrize("name,want", [("BWT Alpine F1 Team", "alpine"), ("RB", "racing_bulls"), ("Orb Racing", "orb_racing"),
                                       ("  ", "unknown"), (None, "unknown"), ("Stake F1 Team Kick Sauber", "sauber")])
def test_canonical_name(frame, name, want):
    assert column(frame("s string", (name,)), text.canonical_name("s")) == [want]


@pytest.mark.parametrize("p,want", [(1.0, "100%"), (0.9996, ">99.9%"), (0.0004, "<0.1%"), (0.125, "12.5%"), (0.0095, "0.9%")])
def test_percent(frame, p, want):
    assert column(frame("p double", (p,)), text.percent("p")) == [want]


def test_place_delta(frame):
    df = frame("w int, pos string", (3, "1"), (1, "2"), (4, "4"), (5, "DNF"))
    assert column(df, text.place_delta("w", "pos")) == ["▲2", "▼1", "=", ""]


RACE9 = [("A", 1.0, 1.0, "Finished"), ("B", 2.0, 2.0, "Finished"), ("C", 3.0, 3.0, "Finished"), ("D", 4.0, 4.0, "Finished"),
         ("E", 5.0, 5.0, "Lapped"), ("F", 6.0, 6.0, "+1 Lap"), ("G", 7.0, 7.0, "Retired"), ("H", 8.0, 8.0, "Disqualified"),
         ("I", 9.0, 9.0, "Did not start")]


@pytest.fixture
def race9(frame):
    return frame("year int, round int, driver string, grid_position double, position double, status string, score double",
                 *[(2024, 1, d, g, p, s, 0.9 - i / 10) for i, (d, g, p, s) in enumerate(RACE9)])


def test_labels_and_relevance(race9):
    out = {r["driver"]: r for r in labels.relevance(labels.derive_labels(race9)).collect()}
    assert out["A"]["is_winner"] == 1 and out["A"]["relevance"] == 9
    assert out["H"]["relevance"] == 0 and out["I"]["relevance"] == 0 and out["I"]["started"] == 0
    assert out["G"]["officially_classified"] == 1 and out["G"]["finished"] == 0


def test_metrics_of_a_perfect_order_and_row_order(race9):
    base = metrics.contest_metrics(race9, "score", False).first()
    assert base["winner_accuracy"] == 1.0 and base["podium_overlap"] == 1.0
    assert base["top10_overlap"] == pytest.approx(0.7) and base["spearman_all"] == pytest.approx(1.0)
    shuffled = race9.orderBy(F.desc("driver")).repartition(3)
    assert metrics.contest_metrics(shuffled, "score", False).first() == base
    assert set(metrics.invariance(race9, "score", False).first().asDict().values()) == {0.0}


def test_metrics_join_without_sorting_contests_again(race9, monkeypatch):
    """Places and correlations are each written by tasks of their own, with the metrics' columns alone."""
    written, real = {}, metrics.materialise
    monkeypatch.setattr(metrics, "materialise", lambda df, label: written.setdefault(label, real(df, label)))
    monkeypatch.setattr("formbook.operators.grouping.WINDOW_ROWS", 1)
    got = metrics.contest_metrics(race9.withColumn("wide", F.lit("x")), "score", False)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert set(written) == {"placed", "spearman-all", "spearman-finishers"} and "wide" not in written["placed"].columns
    assert got.first()["spearman_all"] == pytest.approx(1.0)


def test_unread_columns_stay_out_of_the_salted_join(frame):
    """The salt of the group join is told by the entity, so that what nobody reads is not carried to it."""
    rows = frame("year int, round int, date date, driver string, team string, circuit_id string, position double, is_dnf int, points double, note string")
    plan = features.reliability(rows).select("driver", "team_dnf_rate")._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(driver#" in plan


def test_ties_fall_to_the_known_order(race9):
    got = metrics.predicted_rank(race9.withColumn("score", F.lit(1.0)), "score", False)
    assert {r["driver"]: r["pred_rank"] for r in got.collect()} == {d: i + 1 for i, (d, *_) in enumerate(RACE9)}


def test_unscorable_frame_names_the_gap(race9):
    with pytest.raises(KeyError, match="status"):
        labels.ensure_labels(race9.drop("status"))


def test_spearman_needs_variation(race9):
    flat = race9.withColumn("b", F.lit(2.0))
    assert metrics.spearman(flat, K, "score", "b", "rho").first()["rho"] is None


def test_back_of_grid_uses_the_field_size(frame):
    df = frame("year int, round int, driver string, grid_raw double", *[(2026, 1, f"D{i:02d}", float(i)) for i in range(22)])
    assert labels.back_of_grid(df).filter("driver = 'D00'").first()["grid_position"] == 22.0


def test_qualifying_features(frame):
    q1 = [80.5, 80.7, 80.9, 81.2, 81.4, 82.0]
    rows = [(2024, 1, datetime(2024, 3, 1), d, t, q, q - 0.3 if i < 5 else None, q - 0.6 if i < 3 else None)
            for i, (d, t, q) in enumerate(zip("ABCDEF", "xxyyzz", q1))]
    df = frame("year int, round int, date timestamp, driver string, team string, q1_s double, q2_s double, q3_s double", *rows)
    out = {r["driver"]: r for r in features.qualifying_pace(df).collect()}
    assert [out[d]["quali_stage_reached"] for d in "ABCDEF"] == [3, 3, 3, 2, 2, 1]
    assert out["F"]["quali_gap_pct"] == pytest.approx(100 * (82.0 / 80.5 - 1))
    assert out["E"]["quali_pace_vs_teammate_pct"] == pytest.approx(100 * (81.4 / 82.0 - 1))


LAPS = "year int, round int, driver string, stint string, compound string, secs double, track_status string, " \
       "is_accurate boolean, pit_in_time timestamp, pit_out_time timestamp, tyre_life double, deleted boolean"


def lap(driver, secs, life, stint="1", status="1", deleted=False):
    return (2024, 1, driver, stint, "M", secs, status, True, None, None, float(life), deleted)


def test_observation_summaries(frame):
    rows = [lap(d, b + 0.05 * i, i) for d, b in (("AAA", 90.0), ("BBB", 91.0)) for i in range(5)]
    rows += [lap("AAA", 70.0, i, stint="2") for i in range(3)] + [lap("AAA", 60.0, 9, status="4"), lap("BBB", 60.0, 9, deleted=True)]
    df = frame(LAPS, *rows)
    runs = observe.long_runs(df)
    assert runs.count() == 2 and column(runs, "deg_slope") == pytest.approx([0.05, 0.05])
    best = {r["driver"]: r for r in observe.best_runs(runs).collect()}
    assert best["AAA"]["practice_pace_pct"] < 0 < best["BBB"]["practice_pace_pct"]


def test_slope_needs_varying_age(frame):
    df = frame(LAPS, *[lap("AAA", 90.0 + i, 3) for i in range(5)])
    assert column(observe.long_runs(df), "deg_slope") == [None]


def fill_rows(frame):
    cols = {**{c: None for c in (*impute.POSITION_SCALED, *impute.RATES, *impute.ZERO_FILL, *impute.FLAG_DEFAULTS)}}
    base = "year int, round int, position double, is_dnf int, grid_position double, driver_overall_avg_finish double, " + \
        ", ".join(f"{c} {'int' if c in impute.FLAG_DEFAULTS else 'double'}" for c in cols)
    names = list(cols)
    def row(prior, venue):
        v = dict(cols, driver_circuit_avg_finish=venue)
        return (2024, 1, 6.0, 0, None, prior, *[v[n] for n in names])
    return frame(base, row(7.5, None), row(None, None), row(9.0, 4.0))


def test_fill_chain(frame):
    df = fill_rows(frame)
    out = impute.transform(df, impute.fit(df))
    assert sorted(column(out, "driver_circuit_avg_finish")) == [4.0, 6.0, 7.5]
    assert set(column(out, "grid_position")) == {20.0} and set(column(out, "is_rookie_here")) == {1}
    again = impute.transform(out, impute.fit(df))
    assert out.exceptAll(again).isEmpty()


def test_empty_fit_is_refused(frame):
    with pytest.raises(Exception, match="no rows"):
        impute.fit(fill_rows(frame).filter("year = 1")).collect()


def test_policy_version_is_checked(spark, frame):
    path = scratch(spark, "policy-test")
    files.write_policy(impute.fit(fill_rows(frame)), f"{path}/ok")
    assert files.read_policy(spark, f"{path}/ok").first()["global_mean_finish"] == 6.0
    impute.fit(fill_rows(frame)).withColumn("schema_version", F.lit(99)).write.json(f"{path}/bad")
    with pytest.raises(Exception, match="policy version"):
        files.read_policy(spark, f"{path}/bad").collect()


@pytest.fixture
def seasons(frame):
    rows, at = [], datetime(2020, 1, 1)
    for y in range(2020, 2024):
        for r in range(1, 11):
            at += timedelta(days=14)
            rows += [(y, r, at, f"D{d}", float(d)) for d in range(1, 7)]
    return frame("year int, round int, date timestamp, driver string, position double", *rows)


def test_folds(seasons):
    season, rolling = folds.season_folds(seasons), folds.rolling_folds(seasons, 10, 5, 5)
    assert season.select("fold").distinct().count() == 1
    assert rolling.select("fold").distinct().count() == 5
    assert folds.overlaps(season).isEmpty() and folds.overlaps(rolling).isEmpty()
    edges = rolling.groupBy("fold").pivot("role", ["train", "val", "test"]).agg(F.max("date").alias("x")).collect()
    assert all(e["train"] < e["val"] < e["test"] for e in edges)
    first, second = (column(folds.manifest(folds.season_folds(df)), "sha256") for df in (seasons, seasons.repartition(7)))
    assert first == second


def test_split_needs_three_seasons(seasons):
    with pytest.raises(Exception, match="three parts"):
        folds.chronological_split(seasons.filter("year >= 2022")).collect()


@pytest.fixture
def prob_race(frame):
    return frame("year int, round int, driver bigint, grid_position double, rank_score double, is_winner int, is_podium int",
                 *[(2024, 1, i, i + 1.0, 3.0 - 10.0 * i / 19, int(i == 0), int(i < 3)) for i in range(20)])


def test_plackett_luce_is_coherent(prob_race):
    pl = probability.plackett_luce(prob_race, "rank_score", 1.0, n_draws=2000)
    sums = pl.agg(*[F.sum(c).alias(c) for c in ("p_win", "p_podium", "p_top10")]).first()
    assert [sums[c] for c in sums.asDict()] == pytest.approx([1, 3, 10], abs=0.02)
    assert probability.coherence(pl).isEmpty()


@pytest.mark.parametrize("weights", [[0.8], [0.95], [0.99], [0.999], [0.9, 0.0999], [0.5, 0.4999], [0.0], [0.34, 0.33, 0.32]])
def test_exact_podium_of_favourites(frame, weights):
    left = 20 - len(weights)
    ps = weights + [(1 - sum(weights)) * (i + 1) / (left * (left + 1) / 2) for i in range(left)]
    df = frame("year int, round int, driver int, p_win double", *[(2024, 1, i, p) for i, p in enumerate(ps)])
    got = {r["driver"]: r["p_podium_exact"] for r in probability.exact_podium(df).collect()}
    rest = lambda *out: sum(p for k, p in enumerate(ps) if k not in out)
    want = dict.fromkeys(range(20), 0.0)
    for a in range(20):
        for b in range(20):
            for c in range(20):
                if len({a, b, c}) == 3:
                    chance = ps[a] / rest() * ps[b] / rest(a) * ps[c] / rest(a, b) if ps[a] and ps[b] and ps[c] else 0.0
                    for k in (a, b, c):
                        want[k] += chance
    assert got == pytest.approx(want, abs=1e-9)
    assert sum(got.values()) == pytest.approx(3.0, abs=1e-8)


def test_exact_podium_of_small_fields(frame):
    df = frame("year int, round int, driver int, p_win double", (1, 1, 1, 0.6), (1, 1, 2, 0.4), (1, 1, 3, 0.0), (1, 1, 4, None))
    assert {r["driver"]: r["p_podium_exact"] for r in probability.exact_podium(df).collect()} == {1: 1.0, 2: 1.0, 3: 0.0, 4: None}


def test_classifier_metrics_without_positives_or_scores(frame):
    df = frame("fold string, p double, y int", ("a", 0.2, 0), ("a", 0.7, 0), ("b", 0.9, 1), ("b", None, 0), ("b", 0.1, 0), ("b", 0.3, None))
    got = {r["fold"]: r for r in metrics.classifier_metrics(df, "p", "y", by=["fold"]).collect()}
    assert got["a"]["average_precision"] is None and got["a"]["roc_auc"] is None and got["a"]["accuracy"] == 0.5
    assert got["b"]["average_precision"] == 1.0 and got["b"]["roc_auc"] == 1.0 and got["b"]["accuracy"] == 1.0


def test_exact_podium_equals_enumeration(frame):
    scores = [1.5, 1.0, 0.2, -0.3, -2.0, 0.9]
    df = frame("year int, round int, driver bigint, s double", *[(1, 1, i, s) for i, s in enumerate(scores)])
    got = {r["driver"]: r["p_podium_exact"] for r in probability.exact_podium(probability.softmax(df, "s", 0.8)).collect()}
    w = [math.exp(s / 0.8) for s in scores]
    want = dict.fromkeys(range(6), 0.0)
    for a, b, c in itertools.permutations(range(6), 3):
        t = sum(w)
        p = w[a] / t * w[b] / (t - w[a]) * w[c] / (t - w[a] - w[b])
        for i in (a, b, c):
            want[i] += p
    assert got == pytest.approx(want, abs=1e-9)


def test_exact_podium_of_a_contest_with_most_rows(frame):
    """One contest holds nine tenths of the rows; an entry without id or probability keeps its row, rows never shuffle by contest alone."""
    rng = random.Random(3)
    rates = [rng.random() ** 3 for _ in range(36)]
    big = [r / sum(rates) for r in rates]
    rows = [(1, 1, i, p) for i, p in enumerate(big)] + [(1, 2, i, p) for i, p in enumerate((0.4, 0.3, 0.2, 0.1))] + [(1, 1, None, None)]
    found = probability.exact_podium(frame("year int, round int, driver bigint, p_win double", *rows))
    got = {(r["round"], r["driver"]): r["p_podium_exact"] for r in found.collect()}
    assert len(got) == len(rows) and got[1, None] is None
    for rnd, w in ((1, big), (2, [0.4, 0.3, 0.2, 0.1])):
        want = [0.0] * len(w)
        for a, b, c in itertools.permutations(range(len(w)), 3):
            p = w[a] * w[b] / (1 - w[a]) * w[c] / (1 - w[a] - w[b])
            for i in (a, b, c):
                want[i] += p
        assert [got[rnd, i] for i in range(len(w))] == pytest.approx(want, abs=1e-8)


def test_draws_leave_out_entries_that_cannot_be_placed(frame, monkeypatch):
    """Drawn rows follow the entries in reach of the tenth, not the field; the shares are those of drawing every entry."""
    rows = [(2024, r, d, u) for r in (1, 2) for d, u in enumerate(
        [-d / 2.0 for d in range(300)] if r == 1 else [-1.0] * 20 + [-1e6] * 100 + [None] * 5)]
    rows += [(2024, 3, d, u) for d, u in enumerate([0.0, -1e9, -50.0, None])]
    df = frame("year int, round int, driver int, u double", *rows)
    drawn = []
    monkeypatch.setattr(probability, "spread", lambda df, *keys: drawn.append(df) or df)
    names = ["p_podium", "p_top10", "p_podium_turned", "p_top10_turned"]
    def shares():
        both = probability.drawn_shares(df, {"": F.col("u"), "_turned": -F.col("u")}, 40)
        return {tuple(r) for r in both.select("round", "driver", *names).collect() if any(r[n] for n in names)}
    got = shares()
    monkeypatch.setattr(probability.draws, "GUMBEL_LOW", -1e12)
    assert got == shares()
    in_reach, all_rows = (d.groupBy("round").count().collect() for d in drawn)
    assert {r[0]: r[1] for r in all_rows} == {1: 300, 2: 120, 3: 4}  # ten known utilities stand before every NULL
    assert {r[0]: r[1] for r in in_reach}[1] < 300


def test_temperature_moves_both_ways(prob_race):
    sure = probability.fit_temperature(probability.temperature_losses(prob_race, "rank_score")).first()
    upset = prob_race.withColumn("is_winner", F.when(F.col("driver") == 12, 1).otherwise(0))
    unsure = probability.fit_temperature(probability.temperature_losses(upset, "rank_score")).first()
    assert sure["temperature"] < unsure["temperature"] and sure["on_bound"]
    with pytest.raises(ValueError):
        probability.softmax(prob_race, "rank_score", 0.0)


def per_contest(frame, values, base=0.5):
    schema_ = "year int, round int, winner_accuracy double, podium_overlap double, top10_overlap double, spearman_all double"
    return frame(schema_, *[(2020 + i // 10, i % 10, *[base + v for v in values]) for i in range(70)])


def test_identical_orders_do_not_resolve(frame):
    a = per_contest(frame, (0, 0, 0, 0))
    ci = stats.bootstrap(stats.paired(a, a, ["winner_accuracy"]), n=200).first()
    assert (ci["mean_difference"], ci["ci_low"], ci["ci_high"], ci["resolves"]) == (0.0, 0.0, 0.0, False)
    assert ci["n_contests"] == 70


@pytest.mark.parametrize("values,failing", [
    ((0.1, 0.1, 0.0, 0.0), set()), ((0.02, 0.1, 0.0, 0.0), {"winner_gain"}), ((0.1, 0.01, 0.0, 0.0), {"podium_gain"}),
    ((0.1, 0.1, -0.05, 0.0), {"top10_guard"}), ((0.1, 0.1, 0.0, -0.05), {"spearman_guard"})])
def test_each_gate_fails_alone(frame, values, failing):
    diff = stats.paired(per_contest(frame, values), per_contest(frame, (0, 0, 0, 0)),
                        ["winner_accuracy", "podium_overlap", "top10_overlap", "spearman_all"])
    rows = gates.promotion(stats.bootstrap(diff, n=100), frame("n_folds int", (3,))).collect()
    assert {r["gate"] for r in rows if not r["passed"]} == failing


def test_mcnemar_is_exact(frame):
    df = frame("candidate_hit int, baseline_hit int, n_contests bigint", (1, 0, 17), (0, 1, 11), (1, 1, 60))
    want = min(1.0, 2 * sum(math.comb(28, k) for k in range(12)) / 2 ** 28)
    assert stats.mcnemar(df).first()["p_value"] == pytest.approx(want)


GRID = "year int, round int, driver string, grid_position double, pit_start int"


def test_grid_contract(frame):
    roster = frame("year int, round int, driver string", *[(1, 1, d) for d in ("AAA", "BBB", "CCC", "DDD")])
    order = frame(GRID, (1, 1, "AAA", 1.0, 0), (1, 1, "BBB", 1.0, 0), (1, 1, "CCC", 9.0, 0), (1, 1, "EEE", None, 0))
    got = {(r["rule"], r["offender"]) for r in grid.violations(order, roster).collect()}
    assert got == {("absent_from_grid", "DDD"), ("not_in_roster", "EEE"), ("missing_place", "EEE"),
                   ("repeated_place", "1"), ("place_out_of_range", "9")}
    pits = frame("year int, round int, driver string", (1, 1, "CCC"))
    rows = {r["driver"]: r for r in grid.confirmed(roster, order.filter("driver in ('AAA', 'BBB')"), pits).collect()}
    assert rows["CCC"]["grid_position"] == 4.0 and rows["DDD"]["is_error"] == 1 and rows["DDD"]["pit_start"] == 0


def test_provisional_closes_gaps(frame):
    df = frame("year int, round int, driver string, q double, pit_start int",
               (1, 1, "AAA", 90.0, 0), (1, 1, "BBB", 89.0, 1), (1, 1, "CCC", None, 0), (1, 1, "DDD", 88.0, 0))
    got = {r["driver"]: r["grid_position"] for r in grid.provisional(df, "q").collect()}
    assert got == {"DDD": 1.0, "AAA": 2.0, "CCC": 3.0, "BBB": 4.0}


def forecast_rows(frame):
    rows = [(2026, 14, date(2026, 9, 6), "GP", datetime(2026, 9, 5), "confirmed", i + 1, d, 1, g, 0, p, min(1.0, 2 * p), 1.0)
            for i, (d, g, p) in enumerate(((1, 2.0, 0.5), (2, 1.0, 0.25), (3, 3.0, 0.15), (4, 4.0, 0.10)))]
    return frame("year int, round int, date date, event_name string, created_utc timestamp, grid_status string, pred_finish_rank int,"
                 " driver bigint, team int, grid_position double, pit_start int, p_win double, p_podium double, p_top10 double", *rows)


HEADER = lambda: {"source": F.lit("test"), "training_cutoff_utc": F.lit("2026-08-30"), "temperature": F.lit(1.0), "alpha": F.lit(0.3)}


def test_records_round_trip_once(spark, frame):
    path = scratch(spark, "archive-test")
    split = records.split_record(forecast_rows(frame), HEADER())
    files.archive_forecasts(*split, path)
    assert files.read_forecasts(spark, path).select("grid.field_size", "event.event_name").collect() == [(4, "GP")]
    back = files.read_predictions(spark, path)
    assert sorted(column(back, "p_win")) == [0.1, 0.15, 0.25, 0.5] and set(column(back, "grid_status")) == {"confirmed"}
    with pytest.raises(FileExistsError):
        files.archive_forecasts(*split, path)


def test_records_of_a_huge_field_with_text_ids(spark):
    """10,001 entries stay one record, and ids that look like numbers come back as the text they were."""
    path = scratch(spark, "archive-test")
    text_id = F.concat(F.lit("0"), F.col("id").cast("string"))
    rows = spark.range(10_001).select(
        F.lit(2026).alias("year"), F.lit(14).alias("round"), F.lit(date(2026, 9, 6)).alias("date"), F.lit("GP").alias("event_name"),
        F.lit(datetime(2026, 9, 5)).alias("created_utc"), F.lit("confirmed").alias("grid_status"), (F.col("id") + 1).cast("int").alias("pred_finish_rank"),
        text_id.alias("driver"), F.lit("0x7").alias("team"), F.col("id").cast("double").alias("grid_position"), F.lit(1).alias("pit_start"),
        F.lit(0.0001).alias("p_win"), F.lit(0.0003).alias("p_podium"), F.lit(0.001).alias("p_top10"))
    files.archive_forecasts(*records.split_record(rows, HEADER()), path)
    head = files.read_forecasts(spark, path).collect()
    assert len(head) == 1 and head[0]["grid"]["field_size"] == head[0]["grid"]["n_pit_starts"] == 10_001
    back = files.read_predictions(spark, path)
    assert dict(back.dtypes)["driver"] == "string" and back.select("driver", "team").exceptAll(rows.select("driver", "team")).isEmpty()
    assert back.count() == 10_001 and back.select("driver").distinct().count() == 10_001


def test_nested_records_of_other_writers(spark, tmp_path):
    record = ('{"event": {"year": 2026, "round": 3, "event_name": "GP", "date": "2026-05-01"}, "created_utc": "2026-04-30T10:00:00",\n'
              ' "grid": {"status": "provisional"}, "predictions": [{"pred_finish_rank": 1, "driver": "007", "team": "X", "p_win": 0.5}]}')
    (tmp_path / "one.json").write_text(record)
    rows = files.read_nested(spark, str(tmp_path), "string", "string")
    assert column(rows, "source_file") == ["one.json"]
    flat = files.explode_predictions(rows).first()
    assert (flat["year"], flat["driver"], flat["team"], flat["p_win"], flat["grid_status"]) == (2026, "007", "X", 0.5, "provisional")


def test_calibration_with_text_ids(frame):
    from formbook.operators import gates
    df = frame("year int, round int, driver string, grid_position double, p_win double, is_winner int",
               (1, 1, "b", 2.0, 0.4, 0), (1, 1, "a", 2.0, 0.4, 1), (1, 1, "c", None, 0.4, 0), (1, 1, "d", 1.0, None, 0))
    assert tuple(gates.calibration(df).first()) == (0.4, 1.0)


def test_scoring_uses_archived_probability(frame):
    results = frame("year int, round int, driver bigint, result_order double, is_winner int, is_podium int, finished_top10 int",
                    (2026, 14, 1, 1.0, 1, 1, 1), (2026, 14, 2, 3.0, 0, 1, 1), (2026, 14, 3, 2.0, 0, 1, 1))
    row = records.score(forecast_rows(frame), results).first()
    assert row["winner_hit"] == 1 and row["grid_winner_hit"] == 0 and row["drivers_unmatched"] == 1
    assert row["winner_log_loss"] == pytest.approx(-math.log(0.5)) and row["podium_overlap"] == 1.0
    assert records.pending(forecast_rows(frame), results.filter("year = 1")).count() == 1


def test_overlapping_parts_are_refused(spark, frame):
    base = scratch(spark, "parts-test")
    part = lambda rounds: frame("year int, round int, date timestamp, driver string", *[(2024, r, datetime(2024, r, 1), "A") for r in rounds])
    part((1, 2, 3)).write.parquet(f"{base}/a")
    part((3, 4)).write.parquet(f"{base}/b")
    part((7, 8, 9)).write.parquet(f"{base}/c")
    with pytest.raises(ValueError, match="2024/3"):
        files.read_parts(spark, [f"{base}/a", f"{base}/b"])
    whole = files.read_parts(spark, [f"{base}/a", f"{base}/c"])
    assert quality.coverage_by_season(whole).first()["missing_rounds"] == [4, 5, 6]


def test_hollow_payload(frame):
    df = frame("year int, round int, status string, points double", (1, 1, "", 0.0), (1, 1, None, None),
               (1, 2, "", 25.0), (1, 3, "Finished", 0.0))
    assert column(quality.hollow_contests(df), "round") == [1]


def test_roles_and_missing_columns(frame):
    assert schema.role_problems() == []
    assert schema.role_problems(features=("is_wet",)) == [("feature_is_removed", "is_wet"), ("feature_is_identifier", "is_wet")]
    df = schema.complete(frame("a int", (1,)), {"a": "int", "b": "double"})
    assert df.first().asDict() == {"a": 1, "b": None}


def test_practice_session_used_and_reasons(frame):
    runs = frame("year int, round int, driver int, stint string, compound string, laps int, sd_s double, deg_slope double, median_s double, session string",
                 (1, 1, 7, "1", "S", 5, 0.1, None, 90.0, "FP1"), (1, 1, 7, "1", "S", 5, 0.1, None, 91.0, "FP2"), (1, 1, 8, "1", "S", 5, 0.1, None, 93.0, "FP2"))
    chosen = observe.best_runs(observe.preferred_session(runs, order=("FP2", "FP3", "FP1")))
    assert {r["driver"]: r["practice_session"] for r in chosen.collect()} == {7: "FP2", 8: "FP2"}
    keys = "year int, round int"
    got = quality.session_coverage(frame(keys, (1, 1), (1, 2), (1, 3), (1, 3)), frame(keys, (1, 1), (1, 2), (9, 9)), chosen)
    assert {r["round"]: tuple(r)[2:] for r in got.collect()} == {
        1: ("FP2", 2, None), 2: (None, 0, "no session with long runs"), 3: (None, 0, "no session")}


def test_bundle_checks(frame):
    good = list(schema.FEATURE_COLS)
    block = (2025, 12, *[0.5] * 7)
    df = frame(models.MANIFEST_SCHEMA,
               (1, datetime(2026, 9, 6), 2, 9, 3, 2020, 2026, good, 0.5, 1.0, "ok", 20, block),
               (2, datetime(2026, 1, 1), 1, 9, 3, 2020, 2026, good[:-1], 0.5, 1.0, "bad", 0, None))
    assert {(r["path"], r["problem"]) for r in models.manifest_problems(df).collect()} == {
        ("bad", "bundle_version"), ("bad", "feature_list"), ("bad", "policy_schema"), ("bad", "iterations"), ("bad", "validation")}
    contests = frame("year int, round int, date date", (2026, 1, date(2026, 8, 1)), (2026, 2, date(2026, 9, 6)), (2026, 3, date(2026, 9, 20)))
    use = models.usable_bundles(contests, df.filter("path = 'ok'"))
    assert {r["round"]: r["bundle"] for r in use.collect()} == {1: None, 2: None, 3: "ok"}


def test_best_round_prefers_the_smallest_of_equals(frame):
    df = frame("fold string, n int, v double", ("a", 20, 0.7), ("a", 5, 0.7), ("a", 40, 0.6), ("b", 5, None), ("b", 10, 0.1), ("c", 5, None))
    got = {r["fold"]: (r["n"], r["v"]) for r in models.best_round(df, ["fold"], "n", "v").collect()}
    assert got == {"a": (5, 0.7), "b": (10, 0.1)}


def test_upcoming_contest_must_be_new(frame):
    df = frame("year int, round int", (2024, 1))
    with pytest.raises(ValueError, match="already has results"):
        features.asof_features(df, df)
