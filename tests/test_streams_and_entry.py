"""Streams against batch results, and the driver contract."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import TABLES, canonical
from formbook.session import scratch_path as scratch
from formbook.streaming import online

SF = "/root/testdata/sf0.001"


def test_late_events_do_not_change_history(spark):
    base = scratch(spark, "stream-test")
    at = datetime(2024, 1, 1)
    schema = "id bigint, k int, ts timestamp, v double"
    first = [(i, 1, at + timedelta(hours=i), float(i)) for i in range(4)]
    second = [(10, 1, at, 99.0), (11, 1, at + timedelta(hours=9), 5.0)]
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    online.online_history(stream, ["k"], "ts", "id", "v", 3.0, f"{base}/out", f"{base}/state", f"{base}/cp").awaitTermination()
    rows = {r["id"]: r for r in spark.read.parquet(f"{base}/out/rows").collect()}
    assert rows[0]["n_before"] == 0 and rows[0]["mean_before"] is None
    assert rows[11]["n_before"] == 4 and rows[11]["mean_before"] == pytest.approx(1.5)
    assert [r["id"] for r in spark.read.parquet(f"{base}/out/late").collect()] == [10]


def test_history_writes_touched_keys_only_and_forgets_old_versions(spark, monkeypatch):
    """Four batches, a hot key in each: change logs, bases, a repeated batch, and rows equal to brute force."""
    import random

    from formbook.session import child_names
    monkeypatch.setattr(online, "COMPACT_EVERY", 2)
    base, rng, schema = scratch(spark, "history-test"), random.Random(8), "id bigint, k int, ts timestamp, v double"
    batches, n = [], 0
    for b in range(4):
        keys = [0] * 30 + [1 + b % 3] * 4 + ([None] if b == 2 else [])
        at = [datetime(2024, 1, 1 + b) + timedelta(minutes=i) for i in range(len(keys))]
        batches.append([(n + i, k, t, None if rng.random() < 0.1 else float(rng.randrange(9))) for i, (k, t) in enumerate(zip(keys, at))])
        n += len(keys)
    options = dict(keys=["k"], time="ts", tie="id", value="v", half_life=2.0, out=f"{base}/out", state=f"{base}/state")
    for b, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema)
        online.fold_batch(df, b, **options)
        if b == 2:  # a restart repeats the batch
            first = spark.read.parquet(f"{base}/out/rows/batch={b}").collect()
            online.fold_batch(df, b, **options)
            assert sorted(spark.read.parquet(f"{base}/out/rows/batch={b}").collect()) == sorted(first)
        log = spark.read.parquet(f"{base}/state/log={b}")
        assert {r["k"] for r in log.collect()} == {0, 1 + b % 3}
    assert child_names(spark, f"{base}/state") == ["base=1", "base=3", "edge=1", "edge=2", "edge=3", "log=2", "log=3"]
    got = {r["id"]: r for r in spark.read.parquet(f"{base}/out/rows").collect()}
    past = {}
    for i, k, _, v in sum(batches, []):
        if k is None:
            assert i not in got
            continue
        known = past.setdefault(k, [])
        weights = [2 ** ((j - len(known)) / 2.0) for j in range(len(known))]
        assert got[i]["n_before"] == len(known) and got[i]["min_before"] == min(known, default=None)
        if known:
            assert got[i]["ewm_before"] == pytest.approx(sum(w * x for w, x in zip(weights, known)) / sum(weights))
            assert got[i]["sum_before"] == pytest.approx(sum(known))
        known += [v] if v is not None else []


def test_a_batch_scores_from_the_files_of_its_own_contests(spark):
    """Contests that land in parts, one again later: latest scores equal a single batch, and old contests are not read."""
    from formbook.operators import records
    from formbook.sources import league
    base, forecasts, results = scratch(spark, "scoring-test"), league.forecasts(spark, SF), league.results(spark, SF)
    half = results.filter("driver % 2 = 0"), results.filter("driver % 2 = 1")
    first, last = (results.agg(getattr(F, f)("year")).first()[0] for f in ("min", "max"))
    nobody = results.limit(1).withColumn("round", F.lit(None).cast(results.schema["round"].dataType))
    steps = [half[0].filter(F.col("year") == first), half[0].filter(F.col("year") != first),
             half[1].filter(F.col("year") != last).unionByName(nobody), half[1].filter(F.col("year") == last)]
    for b, rows in enumerate(steps):
        online.score_batch(rows, b, forecasts, base)
    online.score_batch(steps[2], 2, forecasts, base)  # repeated by a restart
    read = online.landed_rows(steps[3], 3, base)
    assert all(f"_at_year={last}/" in f for f in read.inputFiles())
    assert read.count() == results.filter(F.col("year") == last).count()
    assert spark.read.parquet(f"{base}/unkeyed").count() == 1
    got = online.latest_scores(spark.read.parquet(f"{base}/scored"))
    want = records.score(forecasts, results)
    names = sorted(want.columns)
    rounded = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(*names).collect())
    assert rounded(got) == rounded(want) and want.count() > 0
    online.score_batch(results.limit(0), 4, forecasts, base)  # an empty batch scores nothing
    assert rounded(online.latest_scores(spark.read.parquet(f"{base}/scored"))) == rounded(want)


def test_watermark_refuses_forecasts_far_behind(spark):
    """Repeats are kept once; a forecast below the watermark is counted and listed; NULL times pass."""
    base, at = scratch(spark, "late-test"), datetime(2024, 1, 1)
    schema = "year int, round int, driver bigint, created_utc timestamp"
    schedule = spark.createDataFrame([(2024, 1, at + timedelta(days=30))], "year int, round int, start_utc timestamp")
    lands = [[(2024, 1, 1, at + timedelta(days=29)), (2024, 1, 2, at + timedelta(days=31)), (2024, 1, 4, None), (2024, None, 5, at + timedelta(days=30))],
             [(2024, 1, 3, at), (2024, 1, 1, at + timedelta(days=29)), (2024, 1, 3, at + timedelta(days=28))]]
    refused = 0
    for rows in lands:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        q = online.flag_late(spark.readStream.schema(schema).parquet(f"{base}/in"), schedule, f"{base}/out", f"{base}/cp")
        q.awaitTermination()
        refused += online.refused_count(q)
    got = {(r["round"], r["driver"], r["created_utc"]): r["is_late"] for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {(1, 1, at + timedelta(days=29)): False, (1, 2, at + timedelta(days=31)): True, (1, 4, None): False,
                   (None, 5, at + timedelta(days=30)): False, (1, 3, at + timedelta(days=28)): False}
    listed = online.refused_forecasts(spark.read.parquet(f"{base}/in"), spark.read.parquet(f"{base}/out")).collect()
    assert [(r["driver"], r["created_utc"]) for r in listed] == [(3, at)] and refused == 1


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 150
    assert entry.entry(spark).count() == 2


@pytest.mark.parametrize("name", ["win6_past_mean_excluding_contest", "feat14_asof_features", "agg6_best_runs",
                                  "join5_asof_backward", "fold4_rolling_folds", "prob5_plackett_luce",
                                  "eval4_comparison_table", "rec2_score_forecasts", "grid1_violations"])
def test_oracle_agrees_on_the_smallest_scale(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == \
        canonical([d[0] for d in cur.description], cur.fetchall())


def test_folds_run_to_their_end(spark):
    """All folds with few rounds and draws: every test row once, probabilities that add up, choices of each fold."""
    from formbook.operators import folds, models
    from formbook.plans.tables import training_table
    pre = training_table(spark, SF)
    table = folds.season_folds(pre)
    rows = models.run_folds(pre, table, n_draws=200, max_iter=2).toPandas()
    want = pre.join(table.filter("role = 'test'").select("fold", "year", "round"), ["year", "round"]).select("fold", "year", "round", "driver")
    assert sorted(map(tuple, rows[["fold", "year", "round", "driver"]].values)) == sorted(map(tuple, want.collect()))
    contests = rows.groupby(["fold", "year", "round"])
    for c in ("p_win", "p_win_grid"):
        assert contests[c].sum().values == pytest.approx(1.0)
    sizes = contests.size()
    assert contests["p_podium"].sum().values == pytest.approx(sizes.clip(upper=3).values)
    assert contests["p_top10"].sum().values == pytest.approx(sizes.clip(upper=10).values)
    choices = rows.groupby("fold")[["alpha", "w_win", "w_pod", "temperature", "grid_temperature"]].nunique()
    assert (choices == 1).all().all() and len(choices) == table.select("fold").distinct().count()
    assert rows[[c for c in models.FOLD_OUT if c != "result_order"]].notna().all().all()


def test_tuned_folds_and_frozen_iterations(spark):
    """The ranker of a fold comes from its own search; a bundle keeps the count that stopped early and its validation block."""
    from formbook.operators import folds, models
    from formbook.plans.tables import training_table
    pre = training_table(spark, SF)
    table = folds.season_folds(pre)
    last = table.agg(F.max("fold")).first()[0]
    filled = models.materialise(models.fold_rows(pre, table.filter(F.col("fold") == last)), "tuned-test")
    grid = [{"maxDepth": 1, "minInstancesPerNode": 40}, {"maxDepth": 3, "minInstancesPerNode": 5}]
    found, fitted = models.search_folds(filled, [last], grid, 2)
    rows = {r["config"]: r for r in found.collect()}
    best = max(rows, key=lambda c: (rows[c]["ndcg_3"], -c))
    assert [c for c, r in rows.items() if r["chosen"]] == [best] and set(fitted) == {(last, 0), (last, 1)}
    scored = models.fold_scores(filled, 2, tune=grid).select(*models.ID, "rank_score")
    test = filled.filter("role in ('val', 'test')")
    want = models.with_grade(models.fit_grade_ranker(filled.filter("role = 'train'"), 2, **grid[best]), test).select(*models.ID, "rank_score")
    keyed = lambda df: {str(tuple(r)[:-1]): r["rank_score"] for r in df.collect()}
    assert keyed(scored) == pytest.approx(keyed(want))

    path = scratch(spark, "bundle-test")
    manifest = models.develop_and_refit(pre, path).first()
    assert manifest["iterations"] in models.ITERATIONS and models.load_bundle(spark, path)[2].first() == manifest
    stops = models.stop_early(filled.filter("role = 'train'"), filled.filter("role = 'val'"), (1, 5)).collect()
    assert [r["iterations"] for r in stops if r["chosen"]] == [max(stops, key=lambda r: (r["ndcg_3"], -r["iterations"]))["iterations"]]
    block = manifest["validation"]
    assert block["val_season"] == pre.filter("partition = 'val'").agg(F.max("year")).first()[0]
    assert 0 <= block["ndcg_3"] <= 1 and block["winner_log_loss"] > 0 and block["uniform_log_loss"] > 0


def test_model_queries_take_the_documented_defaults(spark, monkeypatch):
    import inspect
    from unittest.mock import MagicMock

    from formbook.functions import vocab
    from formbook.operators import gates, models
    from formbook.plans import queries_models

    class Called(Exception):
        pass

    def record(module, name):
        signature = inspect.signature(getattr(module, name))

        def call(*args, **kwargs):
            bound = signature.bind(*args, **kwargs)
            bound.apply_defaults()
            raise Called(bound.arguments)
        monkeypatch.setattr(module, name, call)

    for name in ("fit_classifier", "fit_grade_ranker", "search", "run_folds", "forecast"):
        record(models, name)
    record(gates, "probability_gates")
    monkeypatch.setattr(queries_models, "_parts", lambda *_: (None, None, None))
    monkeypatch.setattr(queries_models, "training_table", MagicMock())
    monkeypatch.setattr(queries_models, "_bundle", MagicMock())
    monkeypatch.setattr(models, "load_bundle", MagicMock())
    for name in ("features", "folds", "grid"):
        monkeypatch.setattr(queries_models, name, MagicMock())
    future = MagicMock()
    future.select.return_value.first.return_value = (2024, 1)
    monkeypatch.setattr(queries_models, "next_contest", lambda *_: (None, future))
    monkeypatch.setattr(queries_models, "stored", lambda spark, sf, name, build: build())

    def asked(query):
        with pytest.raises(Called) as e:
            entry.queries()[query](spark, SF)
        return e.value.args[0]

    for query, rounds in (("ml1_top10_classifier", 40), ("ml2_grade_challenger", 20), ("ml3_specialist_heads", 40), ("ml4_bounded_search", 20),
                          ("ml5_fold_runner", 40), ("eval14_feature_importance", 40)):
        assert asked(query)["max_iter"] == rounds, query
    assert asked("ml5_fold_runner")["n_draws"] == asked("ml9_forecast_table")["n_draws"] == vocab.PL_DRAWS
    monkeypatch.setattr(queries_models, "_predictions", lambda *_: None)
    assert asked("ml5_fold_gates")["n"] == vocab.BOOTSTRAP_REPLICATES


def test_ndcg_of_the_counterpart_is_finite_in_any_field():
    """Gains of grades beyond 1,023 leave the doubles unless they are scaled by the best grade."""
    import duckdb
    from formbook.plans.oracle import _PARTS
    con = duckdb.connect()
    con.execute("create table grades as select 2000 as year, 1 as round, i as driver, i::double as grid_position, -i::double as rank_score, 2500 - i as relevance from range(2500) t(i)")
    gains = con.execute(f"select max(gain), bool_and(isfinite(gain)) from ({_PARTS['ideal'][1]})").fetchone()
    assert gains == (1.0, True)


def test_peers_of_a_large_group_share_its_past_in_the_counterpart():
    """The window runs over one row per group and contest, so that no frame bound falls among a contest's rows."""
    from formbook.plans import catalog
    from formbook.plans.oracle import _PARTS
    import duckdb
    con = duckdb.connect()
    con.execute("""create table entries as select 2000 as year, m as round, m as d, i as driver, 1 as team, 'v' || m as circuit_id,
        (i * 7 + m) % 3 = 0 as hit, cast((i * 7 + m) % 3 = 0 as int) as is_dnf, 1.0 as points, cast(i as double) as position from range(1, 9) x(m), range(20000) y(i)""")
    got = con.execute(f"select d, team_dnf_rate, constructor_standing_prior from ({_PARTS['team_record'][1]}) order by d").fetchall()
    hits = [sum((i * 7 + m) % 3 == 0 for i in range(20000)) for m in range(1, 9)]
    want = [(m, sum(hits[:m - 1]) / (20000 * (m - 1)) if m > 1 else None, 20000.0 * (m - 1) if m > 1 else None) for m in range(1, 9)]
    assert got == want
    for name in ("win6_past_mean_excluding_contest", "feat2_reliability", "feat14_asof_features"):
        assert "join team_record" in catalog.ORACLES[name]


def test_sprint_places_of_the_counterpart_follow_the_pace():
    """Two medians one unit in the last place apart have one pace, and equal paces fall to the lower id."""
    import math
    import duckdb
    from formbook.plans import catalog
    low = next(x for x in (1000.0 + i / 7 for i in range(1000))
               if low_pace(x, 3 * x) == low_pace(math.nextafter(x, math.inf), 3 * x))
    con = duckdb.connect()
    con.execute("create table sprint_mid (year int, round int, driver int, mid double)")
    con.executemany("insert into sprint_mid values (2000, 1, ?, ?)",
                    [(1, math.nextafter(low, math.inf)), (2, low), (3, 3 * low), (4, 3 * low), (5, 3 * low)])
    con.execute("insert into sprint_mid values (2000, 2, 1, 0.0)")
    final = catalog.ORACLES["feat15_sprint_pace"].rsplit("\nselect year, round, driver, floor", 1)[1]
    got = con.execute(f"select year, round, driver, floor{final}").fetchall()
    assert sorted((r[1], r[4], r[2]) for r in got) == [(1, i, i) for i in range(1, 6)]


def low_pace(mid, field):
    return 100.0 * (mid / field - 1.0)
