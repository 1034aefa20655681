"""Adapter views: a monthly supplier league over the TPC-H style tables.

Contest = month of shipping, entity = supplier, group = the supplier's nation,
observation = order line. The entry table is a derived base table: it is built
once per session, written to the shared folder and then scanned like any other
parquet input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import CONTEST
from ..functions import vocab
from ..functions.expr import flag
from ..functions.text import status_category
from ..operators.grouping import attach, has_hot_group, ranks, with_row
from ..operators.labels import derive_labels
from ..operators.observe import race_pace
from ..session import materialise, path_exists, scratch_path

K = list(CONTEST)
_built: dict[tuple, tuple[str, DataFrame]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, sf_dir: str, label: str, build) -> DataFrame:
    """The derived table of this session, rebuilt if its files are gone."""
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key in _built:
        path, df = _built[key]
        if path_exists(spark, path):
            return df
    path = scratch_path(spark, label)
    df = materialise(build(), label, path)
    _built[key] = (path, df)
    return df


def laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per observation."""
    d = F.col("l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        F.year(d).alias("year"), F.month(d).alias("round"), F.col("l_suppkey").alias("driver"),
        F.col("l_linestatus").alias("stint"), F.col("l_returnflag").alias("compound"),
        F.col("l_linenumber").alias("tyre_life"),
        (F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0.0))).alias("secs"),
        F.when(F.col("l_discount") < 0.08, F.lit("1")).otherwise(F.lit("4")).alias("track_status"),
        (F.col("l_tax") <= 0.07).alias("is_accurate"),
        F.when(F.col("l_tax") == 0.05, d).alias("pit_in_time"),
        F.when(F.col("l_tax") == 0.06, d).alias("pit_out_time"),
        F.when(F.col("l_discount") > 0.0, F.col("l_discount") == 0.07).alias("deleted"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_shipdate")
    month = (table(spark, sf_dir, "lineitem")
             .groupBy(F.year(d).alias("year"), F.month(d).alias("round"),
                      F.col("l_suppkey").alias("driver"))
             .agg(F.round(F.sum("l_extendedprice"), 2).alias("rev"),
                  F.sum("l_quantity").alias("qty"),
                  F.count(F.lit(1)).cast("int").alias("n"),
                  F.count(F.when(F.col("l_returnflag") == "R", 1)).cast("int").alias("n_ret")))
    teams = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("driver"), F.col("s_nationkey").alias("team"))
    base = materialise(month.join(teams, "driver"), "months")

    sizes = base.groupBy(*K).agg(F.count(F.lit(1)).cast("int").alias("field_size"))
    base = attach(base, sizes, K, calendar=True)
    base = ranks(base, K, {"result_order": [("rev", "desc"), ("driver", "asc")],
                           "grid0": [("qty", "desc"), ("driver", "asc")]},
                 split=has_hot_group(base, K))

    kinds = F.col("n_ret") % 5
    status = (F.when(F.col("n_ret") * 2 > F.col("n"), "Engine").when(kinds == 0, "Finished")
              .when(kinds == 1, "+1 Lap").when(kinds == 2, "Lapped")
              .when(kinds == 3, "Collision").otherwise("Retired"))
    hidden = (F.col("driver") + F.col("round")) % 29 == 0
    points = F.coalesce(F.try_element_at(F.array(*[F.lit(float(p)) for p in vocab.POINTS]),
                                         F.col("result_order")), F.lit(0.0))
    pace = F.col("rev") / F.col("qty")
    share = F.col("grid0") / F.col("field_size")
    full = base.select(
        *K, F.make_date("year", "round", F.lit(1)).alias("date"), "driver", "team",
        F.concat(F.lit("venue_"), F.col("round").cast("string")).alias("circuit_id"),
        "rev", "qty", "n", "n_ret", "field_size", "result_order",
        F.when(~hidden, F.col("grid0").cast("double")).alias("grid_raw"),
        F.when(hidden, F.col("field_size")).otherwise(F.col("grid0")).cast("double").alias("grid_position"),
        flag(hidden).alias("pit_start"), status.alias("status"),
        F.when(status != "Engine", F.col("result_order").cast("double")).alias("position"),
        points.alias("points"),
        flag((F.col("year") * 7 + F.col("round")) % 6 == 0).alias("is_wet"),
        pace.alias("q1_s"),
        F.when(share <= 0.75, F.lit(0.99) * F.col("rev") / F.col("qty")).alias("q2_s"),
        F.when(share <= 0.5, F.lit(0.98) * F.col("rev") / F.col("qty")).alias("q3_s"))
    raw = (F.when(F.col("driver") % 7 == 0, F.lit(None).cast("string"))
           .when(F.col("status").isin("Engine", "Collision", "Retired"),
                 F.when(F.col("n_ret") % 2 == 0, "R").otherwise("N"))
           .otherwise(F.col("result_order").cast("string")))
    return full.withColumn("is_dnf", flag(status_category("status") != vocab.FINISHED)) \
               .withColumn("classified_position_raw", raw)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (contest, entity)."""
    return stored(spark, sf_dir, "entries", lambda: _entries(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with the separated outcome labels (order taken from `position`)."""
    return derive_labels(entries(spark, sf_dir).drop("result_order"))


def paced_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with the pace of their own contest, for use as later history."""
    def build():
        pace = race_pace(laps(spark, sf_dir))
        return entries(spark, sf_dir).join(pace, [*K, "driver"], "left")
    return stored(spark, sf_dir, "paced", build)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat forecast rows of every contest, from the known order alone.

    Made six hours before the first of the month, or a day after it when the
    contest number is a multiple of 5 (a late forecast).
    """
    return stored(spark, sf_dir, "forecasts", lambda: _forecasts(spark, sf_dir))


def _forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.probability import softmax
    rows = entries(spark, sf_dir).select(*K, "date", "driver", "team", "grid_position", "pit_start")
    rows = softmax(rows.withColumn("_u", -F.col("grid_position")), "_u", 10.0)
    rows = ranks(rows, K, {"pred_finish_rank": [("grid_position", "asc"), ("driver", "desc")]})
    late = (F.col("year") * 12 + F.col("round")) % 5 == 0
    start = F.col("date").cast("timestamp_ntz")
    made = F.when(late, start + F.expr("interval 24 hours")).otherwise(start - F.expr("interval 6 hours"))
    return rows.select(
        *K, "date", F.concat(F.lit("Contest "), F.col("round").cast("string")).alias("event_name"),
        made.alias("created_utc"), F.lit(vocab.PROVISIONAL).alias("grid_status"), "pred_finish_rank",
        "driver", "team", "grid_position", "pit_start", "p_win",
        F.least(F.lit(1.0), 3 * F.col("p_win")).alias("p_podium"),
        F.least(F.lit(1.0), 10 * F.col("p_win")).alias("p_top10"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that have arrived: every labelled contest but those of the last year."""
    rows = labelled(spark, sf_dir)
    last = rows.agg(F.max("year").alias("_last"))
    return with_row(rows, last).filter(F.col("year") < F.col("_last")).drop("_last")


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar of contests: every month of shipping, testing months marked."""
    months = (table(spark, sf_dir, "lineitem")
              .select(F.trunc("l_shipdate", "month").alias("date")).distinct())
    start = F.col("date").cast("timestamp_ntz")
    return months.select(
        F.year("date").alias("year"), F.month("date").alias("round"), "date", start.alias("start_utc"),
        F.concat(F.lit("Venue #"), F.month("date").cast("string"), F.lit("!")).alias("location"),
        F.when(F.month("date") == 2, "testing").otherwise("conventional").alias("format"))
