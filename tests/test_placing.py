"""Successive sampling of Plackett-Luce places."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from formbook.operators import placing, probability

K = ["year", "round"]


def enumerated(w, k):
    """Chance of each entry to be among the first k, from all orders."""
    out = np.zeros(len(w))
    for order in itertools.permutations(range(len(w)), k):
        p, left = 1.0, sum(w)
        for i in order:
            p, left = p * w[i] / left, left - w[i]
        out[list(order)] += p
    return out


def test_places_follow_the_distribution():
    w = np.array([0.05, 0.1, 0.5, 1.0, 2.0, 4.0])
    order = placing.successive(np.log(w), np.random.default_rng(1).random((200_000, 10)))
    assert (np.sort(order, 1) == np.arange(6)).all()
    for k in (1, 3):
        got = np.bincount(order[:, :k].ravel(), minlength=6) / 200_000
        assert got == pytest.approx(enumerated(w, k), abs=0.006)


@pytest.mark.parametrize("gap", [50.0, 900.0])
def test_a_favourite_beyond_the_digits_leaves_the_rest_right(gap):
    """The rest is picked by its own weights, or by utility where no double holds them; missing utilities come last."""
    u = np.array([math.nan, 0.0, 0.0, math.log(2.0), gap])
    order = placing.successive(u, np.random.default_rng(2).random((40_000, 10)))
    assert (order[:, 0] == 4).all() and (order[:, 4] == 0).all()
    share = (order[:, 1] == 3).mean()
    assert share == pytest.approx(0.5, abs=0.015) if gap < 700 else share == 1.0


def test_shares_agree_with_the_ranked_draws(spark):
    """Same totals as the Gumbel draws within their error, for two utilities, ids as text, missing utilities and short fields."""
    rows = [(2024, 1, f"d{i:02}", None if i == 13 else (i * 7 % 20) / 5.0) for i in range(20)] + [(2024, 2, f"d{i}", float(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "year int, round int, driver string, u double")
    wanted = {"": F.col("u"), "_turned": -F.col("u")}
    a, b = ({(r["round"], r["driver"]): r.asDict() for r in f(df, wanted, 4000).collect()} for f in (placing.sampled_shares, probability.drawn_shares))
    assert (1, "d13") not in a and {k for k in a if k[0] == 2} == {(2, f"d{i}") for i in range(3)}
    for key, row in b.items():
        for c in ("p_podium", "p_top10", "p_podium_turned", "p_top10_turned"):
            assert a.get(key, {c: 0.0})[c] == pytest.approx(row[c], abs=0.05), (key, c)
    again = placing.sampled_shares(df.repartition(5, "driver"), wanted, 4000).collect()
    assert {(r["round"], r["driver"]): r.asDict() for r in again} == a


def test_a_draw_does_not_visit_the_field(spark, monkeypatch):
    """Forecast draws of a field of 3,000 form no row per entry and draw."""
    monkeypatch.setattr(placing, "drawn_shares", None)
    df = spark.range(3000).select(F.lit(2024).alias("year"), F.lit(1).alias("round"), F.col("id").alias("driver"), (F.col("id") / 1000.0).alias("u"))
    rows = probability.plackett_luce(df, "u", 1.0, 20_000, shares=placing.sampled_shares)
    one = rows.agg(F.sum("p_win"), F.sum("p_podium"), F.sum("p_top10"), F.count("driver")).first()
    assert tuple(one) == pytest.approx((1.0, 3.0, 10.0, 3000))


def test_the_flagship_chances_take_the_documented_draws():
    """20,000 draws in the query and in its counterpart, as in folds and forecasts; 500 are left to the queries that say so."""
    from formbook.functions import vocab
    from formbook.plans import catalog
    assert f"range({vocab.PL_DRAWS})" in catalog.ORACLES["prob5_plackett_luce"] and "range(500)" not in catalog.ORACLES["prob5_plackett_luce"]
    assert "range(500)" in catalog.ORACLES["prob10_podium_brier"]


def test_the_query_draws_as_documented(spark):
    from formbook.functions import vocab
    from formbook.plans import catalog
    rows = catalog.QUERIES["prob5_plackett_luce"](spark, "/root/testdata/sf0.001")
    assert {r[0] for r in rows.select("mc_error").collect()} == {math.floor(math.sqrt(0.25 / vocab.PL_DRAWS) * 1e6 + 0.5) / 1e6}


@pytest.mark.parametrize("hot", [2_000_000, 3])
def test_hashed_draws_are_the_ranked_ones(spark, hot):
    """The same numbers as the built-in md5: long and short ids, ties, missing, no and endless utilities, two of them, several blocks of draws."""
    from formbook.operators import hashed
    rows = [(2024, 1, f"d{i}" + "x" * (i % 4 * 25), [-1.0, 0.5, None, math.nan, math.inf, -math.inf, 2.0][i % 7] if i < 21 else -1.0) for i in range(60)]
    rows += [(2024, 2, f"e{i}", [None, -1.0, None, None][i % 4]) for i in range(30)] + [(2024, 3, "f", 0.0)]
    df = spark.createDataFrame(rows, "year int, round int, driver string, u double")
    some = df.select("*", F.col("u").alias("_u0"), (-F.col("u")).alias("_u1"), F.lit(True).alias("_r0"), (F.col("round") < 3).alias("_r1"))
    found = [{tuple(r) for r in of(some, {0: "_u0", 1: "_u1"}, 1203, 7, K, K).groupBy(*K, "driver", "_of").agg(F.sum("_podium"), F.sum("_top")).collect()}
             for of in (hashed.hashed_draws, hashed.ranked_draws)]
    assert found[0] == found[1] and len(found[0]) > 60
    spark.conf.set("spark.formbook.hotGroupRows", str(hot))
    try:
        got = {tuple(r) for r in probability.drawn_shares(df, {"": F.col("u")}, 600).collect()}
    finally:
        spark.conf.unset("spark.formbook.hotGroupRows")
    assert max(r[4] for r in got) == 1.0 and len(got) > 30
