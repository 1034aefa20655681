"""Registered queries: streams over the adapter tables, compared with their batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import league
from ..sources.league import K
from ..streaming import online
from .oracle import r, sql
from .queries_base import scratch
from .queries_score import _SCORE, SCORE_COLS
from .registry import out, query


def _stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("str1_stream_scoring",
       sql("fr_score", f"select year, round, event_name, grid_status, drivers_unmatched, winner_hit, grid_winner_hit, {r(_SCORE)} from fr_score"))
def _(spark, sf):
    landed, scored = scratch(spark, "landed"), scratch(spark, "scored")
    results = league.results(spark, sf)
    # A contest's rows lie in several files, and each file is a batch of its own.
    results.withColumn("_half", F.col("driver") % 2).repartition(2, "_half").drop("_half").write.parquet(landed)
    q = online.score_results(_stream(spark, landed, results.schema), league.forecasts(spark, sf), scored, scratch(spark, "cp"))
    q.awaitTermination()
    return out(online.latest_scores(spark.read.parquet(f"{scored}/scored")), *SCORE_COLS)


@query("str2_online_history",
       f"""with k as (select *, row_number() over (partition by user_id order by ts, event_id) as k from events)
           select event_id, count(*) over w as n_before, {r('sum(value) over w as sum_before', 'min(value) over w as min_before')},
           {r('sum(value * pow(2.0, k / 3.0)) over w / sum(pow(2.0, k / 3.0)) over w as ewm_before')} from k
           window w as (partition by user_id order by k rows between unbounded preceding and 1 preceding)""")
def _(spark, sf):
    landed, rows, state, scratch_cp = (scratch(spark, n) for n in ("landed", "rows", "state", "cp"))
    events = league.events(spark, sf).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    # Three landings in event-time order; each is one batch of any number of files.
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    one, two = (low + (high - low) * k / 3 for k in (1, 2)) if low else (None, None)
    first, second = F.coalesce(F.col("ts") < F.lit(one), F.lit(False)), F.coalesce(F.col("ts") < F.lit(two), F.lit(False))
    for some in (first, ~first & second, ~second):
        events.filter(some).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(events.schema).parquet(landed)
        q = online.online_history(stream, ["user_id"], "ts", "event_id", "value", 3.0, rows, state, scratch_cp)
        q.awaitTermination()
    return out(spark.read.parquet(f"{rows}/rows"), "event_id", "n_before", "sum_before", "min_before", "ewm_before")


@query("str3_late_forecasts",
       sql("forecasts", "select year, round, driver, created_utc > cast(date as timestamp) as is_late from forecasts"))
def _(spark, sf):
    landed, flagged = scratch(spark, "landed"), scratch(spark, "flagged")
    rows = league.forecasts(spark, sf).select(*K, "driver", F.col("created_utc").cast("timestamp").alias("created_utc"))
    schedule = league.schedule(spark, sf).withColumn("start_utc", F.col("start_utc").cast("timestamp"))
    # Two landings in the order of creation, so no forecast lies below the watermark of those before it.
    low, high, cp = *rows.agg(F.min("created_utc"), F.max("created_utc")).first(), scratch(spark, "cp")
    early = F.coalesce(F.col("created_utc") < F.lit(low + (high - low) / 2 if low else None), F.lit(False))
    for some in (early, ~early):
        rows.filter(some).write.mode("append").parquet(landed)
        online.flag_late(spark.readStream.schema(rows.schema).parquet(landed), schedule, flagged, cp).awaitTermination()
    return spark.read.parquet(flagged).select(*K, "driver", "is_late")
