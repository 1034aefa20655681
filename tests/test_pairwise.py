"""The pairwise ranker without pairs, against the pairs themselves."""

import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.sql import functions as F

from formbook.operators import models, pairwise
from formbook.operators.grouping import ranks
from formbook.sources.schema import FEATURE_COLS

K = ["year", "round"]


@pytest.fixture
def entries(spark):
    rng = random.Random(5)
    rows = []
    for rnd, n in ((1, 60), (2, 1), (3, 17), (4, 33)):
        for d in range(n):
            x = [rng.gauss(0, 1) for _ in FEATURE_COLS]
            x[3] = 4.0  # never varies
            rows.append((2024, rnd, f"d{d:03}", 1 if rng.random() < 0.9 else 0, x[0] + 0.5 * x[1] + rng.gauss(0, 1), *x))
    return spark.createDataFrame(rows, "year int, round int, driver string, officially_classified int, result_order double, "
                                 + ", ".join(f"{c} double" for c in FEATURE_COLS))


@pytest.mark.parametrize("rows", [3, 7, 496])
def test_blocks_hold_every_pair_once(spark, entries, rows):
    """Number, spread, loss and gradient are those of the table of pairs, however short the blocks are."""
    placed = models.inputs(ranks(entries.filter("officially_classified = 1"), K, {"_place": [("result_order", "asc"), ("driver", "asc")]}))
    width = len(models.FILLED)
    table = pairwise.blocks(placed, models.FILLED, models.OFFSETS, rows).localCheckpoint()
    assert table.agg(F.max(F.length("x")) <= 8 * width * (rows + max(models.OFFSETS))).first()[0]
    pairs = models.ranker_pairs(entries).toPandas()
    gaps, labels = pairs[list(models.FILLED)].to_numpy(), pairs["_label"].to_numpy()
    n, spread = pairwise.spreads(table, width, models.OFFSETS)
    assert n == len(gaps) and spread == pytest.approx(gaps.std(0, ddof=1), abs=1e-9)
    scale = np.divide(1, gaps.std(0, ddof=1), out=np.zeros(width), where=spread > 0)
    path = pairwise.fit(table, width, models.OFFSETS, 0.01, 3)
    assert len(path) == 4 and not path[0].any()

    def loss(w):
        margin = gaps @ w * (2 * labels - 1)
        return np.logaddexp(0, -margin).mean() + 0.005 * ((w * np.divide(1, scale, out=np.zeros(width), where=scale > 0)) ** 2).sum()

    steps = [loss(w) for w in path]
    assert steps == sorted(steps, reverse=True) and steps[0] == pytest.approx(np.log(2))


def test_ranker_is_the_logistic_fit_on_pairs(spark, entries, tmp_path):
    """The converged ranker is that of Spark's logistic regression on all pairs; fewer rounds begin the same path."""
    pairs = models.ranker_pairs(entries)
    stages = [models._assembler(), StandardScaler(inputCol="features", outputCol="scaled", withMean=False),
              LogisticRegression(labelCol="_label", featuresCol="scaled", fitIntercept=False, regParam=0.01, maxIter=200, tol=1e-12)]
    fitted = Pipeline(stages=stages).fit(pairs)
    want = np.divide(fitted.stages[2].coefficients.toArray(), fitted.stages[1].std.toArray(), out=np.zeros(len(models.FILLED)),
                     where=fitted.stages[1].std.toArray() > 0)
    model, early = models.fit_rankers(entries, (200, 2))
    model.write().overwrite().save(f"{tmp_path}/ranker")
    model = models.PipelineModel.load(f"{tmp_path}/ranker")
    got = models.with_rank_score(model, entries).orderBy("year", "round", "driver").toPandas()["rank_score"].to_numpy()
    x = models.inputs(entries).orderBy("year", "round", "driver").select(*models.FILLED).toPandas().to_numpy()
    assert got == pytest.approx(x @ want, abs=2e-4)
    alone = models.with_rank_score(models.fit_ranker(entries, max_iter=2), entries).orderBy("year", "round", "driver").toPandas()
    together = models.with_rank_score(early, entries).orderBy("year", "round", "driver").toPandas()
    assert together["rank_score"].to_numpy() == pytest.approx(alone["rank_score"].to_numpy())


def test_ranker_of_no_pairs(entries):
    """A contest of one entry compares nothing: every score is 0."""
    one = entries.filter("round = 2").withColumn("officially_classified", F.lit(1))
    assert [r["rank_score"] for r in models.with_rank_score(models.fit_ranker(one), one).collect()] == [0.0]
