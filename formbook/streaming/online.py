"""Streams: scoring results as they land, online history, late forecasts.

State lives in tables of the shared folder, and a batch is processed with the
same distributed operators as a full table. A hot key therefore never has to fit
one stateful task, and a repeated batch writes the same version again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import CONTEST
from ..operators import asof, records
from ..session import child_names, delete_tree, materialise, path_exists

K = list(CONTEST)


def score_results(results: DataFrame, forecasts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Score static forecasts against a stream of results.

    The rows of a contest may land in any number of batches: each batch files its
    rows under `<out>/landed/<contest>/batch=<n>`, reads back the folders of the
    contests that it touches and no others, and scores these under `<out>/scored`.
    So the files that a batch reads follow its own contests, not the number of
    batches before it; the driver holds the batch's contest keys, which the calendar
    bounds. `latest_scores` reads each contest's last version. A repeated batch
    replaces its own folders. Rows whose contest is NULL belong to none and are
    written to `<out>/unkeyed`.
    """
    def batch(rows: DataFrame, batch_id: int) -> None:
        score_batch(rows, batch_id, forecasts, out)

    return (results.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def landed_rows(rows: DataFrame, batch_id: int, out: str) -> DataFrame:
    """File one batch by contest; all rows landed so far of the contests that it touches."""
    spark, landed = rows.sparkSession, f"{out}/landed"
    unkeyed = F.exists(F.array(*[F.col(k).isNull() for k in K]), lambda x: x)
    rows.filter(unkeyed).write.mode("overwrite").parquet(f"{out}/unkeyed/batch={batch_id}")
    # The files keep the keys; the folder columns only locate them.
    places = [f"_at_{k}" for k in K]
    filed = rows.filter(~unkeyed).withColumns(dict(zip(places, map(F.col, K)))).withColumn("batch", F.lit(batch_id).cast("long"))
    (filed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*places, "batch").parquet(landed))
    touched = rows.filter(~unkeyed).select(*K).distinct().collect()
    if not touched:
        return rows.filter(~unkeyed)
    paths = ["/".join([landed, *(f"{p}={r[k]}" for p, k in zip(places, K))]) for r in touched]
    # A repeated batch does not see the batches after it.
    found = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType())])).option("basePath", landed).parquet(*paths)
    return found.where(F.col("batch") <= batch_id).select(*rows.columns)


def score_batch(rows: DataFrame, batch_id: int, forecasts: DataFrame, out: str) -> None:
    """One batch of `score_results`; repeating it writes the same folders again."""
    landed = landed_rows(rows, batch_id, out)
    scored = records.score(forecasts.join(landed.select(*K).distinct(), K, "left_semi"), landed)
    scored.write.mode("overwrite").parquet(f"{out}/scored/batch={batch_id}")


def latest_scores(scored: DataFrame) -> DataFrame:
    """The last version of each contest of `<out>/scored`."""
    last = scored.groupBy(*K).agg(F.max("batch").alias("batch"))
    return scored.join(last, [*K, "batch"]).drop("batch")


# After so many batches the changed keys are merged into a new base, and older versions go.
COMPACT_EVERY = 16
_FIELDS = ("n", "s", "mn", "num", "den", "last")


def known_state(spark: SparkSession, state: str, keys: Sequence[str], upto: int) -> DataFrame | None:
    """Each key's last state after batch `upto`: the newest base and the changes since."""
    base, logs = _versions(spark, state, upto)
    paths = ([f"{state}/base={base}"] if base is not None else []) + [f"{state}/log={v}" for v in logs]
    if not paths:
        return None
    rows = spark.read.parquet(*paths)
    last = F.max_by(F.struct(*_FIELDS), "version").alias("_state")
    return rows.groupBy(*keys).agg(last).select(*keys, "_state.*")


def _versions(spark: SparkSession, state: str, upto: int) -> tuple[int | None, list[int]]:
    """The newest base up to a batch and the later change logs."""
    names = [n.split("=") for n in child_names(spark, state)]
    bases = [int(v) for kind, v in names if kind == "base" and int(v) <= upto]
    base = max(bases, default=None)
    return base, sorted(int(v) for kind, v in names if kind == "log" and int(v) <= upto and (base is None or int(v) > base))


def _drop_old(spark: SparkSession, state: str, upto: int) -> None:
    """Remove what the newest base up to a finished batch has replaced."""
    base, _ = _versions(spark, state, upto)
    for kind, v in (n.split("=") for n in child_names(spark, state)):
        if base is not None and (int(v) < base or kind == "log" and int(v) == base):
            delete_tree(spark, f"{state}/{kind}={v}")


def fold_batch(rows: DataFrame, batch_id: int, keys: Sequence[str], time: str, tie: str, value: str, half_life: float,
               out: str, state: str, delay: str = "0 seconds") -> None:
    """One batch of `online_history`; repeating it writes the same folders again."""
    spark, keys, h = rows.sparkSession, list(keys), float(half_life)

    def fade(n):
        return F.pow(F.lit(2.0), -n / F.lit(h))

    def zero(c):
        return F.coalesce(F.col(c), F.lit(0.0))

    edge = None
    if batch_id > 0:
        if not path_exists(spark, f"{state}/edge={batch_id - 1}"):
            raise FileNotFoundError(f"the state of batch {batch_id - 1} is missing in {state}")
        edge = spark.read.parquet(f"{state}/edge={batch_id - 1}").first()["edge"]
        _drop_old(spark, state, batch_id - 1)
    # Keys that are NULL belong to no history: such rows are kept apart.
    unkeyed = F.exists(F.array(*[F.col(k).isNull() for k in keys]), lambda x: x)
    rows.filter(unkeyed).write.mode("overwrite").parquet(f"{out}/unkeyed/batch={batch_id}")
    late = F.coalesce(F.col(time) < F.lit(edge).cast("timestamp") - F.expr(f"interval {delay}"), F.lit(False))
    rows.filter(~unkeyed & late).write.mode("overwrite").parquet(f"{out}/late/batch={batch_id}")
    fresh = rows.filter(~unkeyed & ~late)

    local = materialise(asof.long_ewm_state(fresh, keys, time, [tie], value, h, {"_s": ("sum", value), "_mn": ("min", value)}), "batch-history")
    touched = local.select(*keys).distinct()
    known = known_state(spark, state, keys, batch_id - 1)
    if known is None:
        blank = F.lit(None).cast("double")
        known = touched.limit(0).select(*keys, F.lit(0).cast("bigint").alias("n"), *[blank.alias(f) for f in _FIELDS[1:-1]],
                                        F.lit(None).cast("timestamp").alias("last"))
    known = known.join(touched, keys, "left_semi")
    both = local.join(known.select(*keys, *[F.col(f).alias(f"_0{f}") for f in _FIELDS]), keys, "left")
    count = F.col("seen") + F.coalesce("_0n", F.lit(0))
    num = zero("_0num") * fade(F.col("seen")) + zero("num")
    den = zero("_0den") * fade(F.col("seen")) + zero("den")
    total = F.coalesce(F.col("_s") + F.col("_0s"), "_s", "_0s")
    emitted = both.select(
        tie, *keys, count.alias("n_before"), total.alias("sum_before"), (total / F.nullif(count, F.lit(0))).alias("mean_before"),
        F.least("_mn", "_0mn").alias("min_before"), (num / F.nullif(den, F.lit(0.0))).alias("ewm_before"))
    emitted.write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")

    # The batch's own weights count back from its last value: at most 1, so nothing overflows.
    seen = local.filter(F.col(value).isNotNull())
    back = fade(F.col("_k") - 1 - F.col("seen"))
    gained = seen.join(seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")), keys).groupBy(*keys).agg(
        F.max("_k").alias("_k"), F.sum(value).cast("double").alias("_gs"), F.min(value).cast("double").alias("_gmn"),
        F.sum(F.col(value) * back).alias("_gnum"), F.sum(back).alias("_gden"), F.max(time).alias("_last"))
    changed = gained.join(known, keys, "left").select(
        *keys, (F.coalesce("n", F.lit(0)) + F.col("_k")).alias("n"), F.coalesce(F.col("s") + F.col("_gs"), "_gs").alias("s"),
        F.least("mn", "_gmn").alias("mn"), (zero("num") * fade(F.col("_k")) + F.col("_gnum")).alias("num"),
        (zero("den") * fade(F.col("_k")) + F.col("_gden")).alias("den"), F.greatest("last", "_last").alias("last"),
        F.lit(batch_id).cast("long").alias("version"))
    changed.write.mode("overwrite").parquet(f"{state}/log={batch_id}")
    if (batch_id + 1) % COMPACT_EVERY == 0:
        whole = known_state(spark, state, keys, batch_id)
        whole.withColumn("version", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{state}/base={batch_id}")
    newest = spark.read.parquet(f"{state}/log={batch_id}").agg(F.greatest(F.max("last"), F.lit(edge).cast("timestamp")).alias("edge"))
    newest.write.mode("overwrite").parquet(f"{state}/edge={batch_id}")


def online_history(events: DataFrame, keys: Sequence[str], time: str, tie: str, value: str, half_life: float,
                   out: str, state: str, checkpoint: str, delay: str = "0 seconds") -> StreamingQuery:
    """Emit the prior state of each key for every event, then fold the event in.

    Emitted: count, sum, mean, minimum and weighted mean before the event. Rows older
    than the watermark of the batches before (`delay` behind the newest time
    seen) are written to `<out>/late` instead of changing history, rows with a NULL
    key to `<out>/unkeyed`. A missing state is an error.

    The state is a change log: a batch reads the states of the keys it touches
    and writes only these. Every `COMPACT_EVERY` batches the log is merged into a
    base; the next batch, which proves that the merge is committed, removes what
    it replaced.
    """
    def batch(rows: DataFrame, batch_id: int) -> None:
        fold_batch(rows, batch_id, keys, time, tie, value, half_life, out, state, delay)

    return (events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def flag_late(forecasts: DataFrame, schedule: DataFrame, out: str, checkpoint: str,
              delay: str = "7 days", start: str = "start_utc") -> StreamingQuery:
    """Mark forecasts made after the scheduled start; the schedule is a static calendar.

    A forecast that is sent again (same contest, entity and time) is kept once. The
    watermark, `delay` behind the newest creation time of the batches before, bounds
    the state that this needs: one small record per forecast inside the delay,
    spread by contest and entity. A forecast that arrives below the watermark is
    refused; `refused_count` counts these and `refused_forecasts` lists them. A NULL
    creation time is below no watermark and is not late.
    """
    once = forecasts.withWatermark("created_utc", delay).dropDuplicatesWithinWatermark([*K, "driver", "created_utc"])
    marked = (once.join(schedule.select(*K, start), K, "left")
              .withColumn("is_late", F.coalesce(F.col("created_utc") > F.col(start), F.lit(False))))
    return (marked.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def refused_count(query: StreamingQuery) -> int:
    """Rows below the watermark that the recent batches of a stream refused."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def refused_forecasts(forecasts: DataFrame, flagged: DataFrame) -> DataFrame:
    """Landed forecasts that are not in the output of `flag_late`, each once."""
    names = [*K, "driver", "created_utc"]
    kept = flagged.select(*[F.col(n).alias(f"_{n}") for n in names])
    same = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]
    return forecasts.dropDuplicates(names).join(kept, same, "left_anti")
