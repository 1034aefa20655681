"""Prefix scan over order position: running folds where one key, or one instant, may hold most rows.

Rows are range-partitioned by (key, order, hash of the row) through splitters that
Spark measures on the data, sorted and written once, so a part is a fixed
piece of the order and no part grows with a key or an instant. Each (key, part)
is folded on its own; its totals, one row per (key, part), carry forward; the
carried row joins back on (key, part). No task holds more of a key than one
part. Rows that are equal in every column stay in one part.

Peers (rows at one order value) may lie in several parts. Such values are the
ends of their parts, so their prefix and total come from the parts' first and
last values, again one row per (key, part).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import col
from ..session import materialise

MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
FOLD = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
EARLIEST = -(1 << 62)  # stands for an unknown order value


def merged(fold: str, a: Column, b: Column) -> Column:
    """Two partial folds as one; NULL is the empty fold."""
    if fold in ("sum", "count"):
        return F.coalesce(a + b, a, b)
    return (F.least if fold == "min" else F.greatest)(a, b)


def prefix_scan(df: DataFrame, keys: Sequence[str], at: Column, wanted: Mapping[str, tuple[str, Column | str]],
                tie: Sequence[Column] | None = None, inclusive: bool = False) -> DataFrame:
    """`df` with the folds (sum, count, min, max of a value) of each key's earlier rows.

    With `tie`, earlier means lower in (at, tie) and `at` may have any orderable
    type. Without, rows with equal `at` are peers, left out of each other's folds
    (or all included with `inclusive`), and `at` is a long; a NULL is lower than
    any value. NULL keys equal each other. The folds come first as NULL, counts as 0.
    """
    names = df.columns
    parts = [F.struct(*[F.col(n) for n in names]).alias("_row"), (F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)).alias("_key"),
             (at if tie is not None else F.coalesce(at, F.lit(EARLIEST))).alias("_at")]
    ties = [t.alias(f"_tie{i}") for i, t in enumerate(tie or ())]
    rows = df.select(*parts, *ties, F.xxhash64(*names).alias("_hash"), *[col(v).alias(f"_in_{o}") for o, (_, v) in wanted.items()])
    order = ["_key", "_at", *[f"_tie{i}" for i in range(len(ties))], "_hash"]
    placed = materialise(rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("_part", F.shiftright("_id", 33).cast("int")).drop(*order[2:])

    piece, last = Window.partitionBy("_key", "_part"), 0 if inclusive else -1
    frame = (piece.orderBy("_id").rowsBetween(Window.unboundedPreceding, last) if tie is not None
             else piece.orderBy("_at").rangeBetween(Window.unboundedPreceding, last))
    local = placed.select("*", F.min("_at").over(piece).alias("_lo"), F.max("_at").over(piece).alias("_hi"),
                          *[FOLD[f](f"_in_{o}").over(frame).alias(f"_loc_{o}") for o, (f, _) in wanted.items()])
    carry = _carried(local, wanted) if tie is not None else _with_spans(_carried(local, wanted, ends=True), wanted)
    both = local.join(carry, ["_key", "_part"])

    outs = []
    for o, (f, _) in wanted.items():
        value = merged(f, F.col(f"_carry_{o}"), F.col(f"_loc_{o}"))
        if tie is None and inclusive:
            for end in ("_hi", "_lo"):
                span = F.col(f"_at{end}")
                value = F.when((F.col("_at") == F.col(end)) & span.isNotNull(), merged(f, span[f"_pre_{o}"], span[f"_tot_{o}"])).otherwise(value)
        elif tie is None:
            value = F.when((F.col("_at") == F.col("_lo")) & F.col("_at_lo").isNotNull(), F.col("_at_lo")[f"_pre_{o}"]).otherwise(value)
        outs.append((F.coalesce(value, F.lit(0)) if f == "count" else value).alias(o))
    return both.select("_row.*", *outs)


def _carried(local: DataFrame, wanted: Mapping[str, tuple[str, object]], ends: bool = False) -> DataFrame:
    """One row per (key, part): the folds of all earlier parts, and of the part's ends."""
    at, lo, hi = F.col("_at"), F.col("_lo"), F.col("_hi")
    folds = [F.min("_lo").alias("_from"), F.max("_hi").alias("_to")] if ends else []
    for o, (f, _) in wanted.items():
        value = F.col(f"_in_{o}")
        folds.append(FOLD[f](value).alias(f"_all_{o}"))
        if ends:
            folds += [FOLD[f](F.when(at == lo, value)).alias(f"_first_{o}"), FOLD[f](F.when(at == hi, value)).alias(f"_last_{o}"),
                      FOLD[f](F.when(at < hi, value)).alias(f"_body_{o}")]
    table = local.groupBy("_key", "_part").agg(*folds)
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    kept = [c for c in table.columns if not c.startswith("_all_")]
    return table.select(*kept, *[MERGE[f](f"_all_{o}").over(earlier).alias(f"_carry_{o}") for o, (f, _) in wanted.items()])


def _with_spans(parts: DataFrame, wanted: Mapping[str, tuple[str, object]]) -> DataFrame:
    """Each part with the prefix and total of its first and last value, where these lie in several parts."""
    def end(value, fold, body):
        return F.struct(F.col(value).alias("_e"), *[F.col(f"_{fold}_{o}").alias(f"_f_{o}") for o in wanted],
                        *[(F.col(f"_body_{o}") if body else F.when(F.lit(False), F.col(f"_body_{o}"))).alias(f"_b_{o}") for o in wanted])

    low, high = end("_from", "first", False), end("_to", "last", True)
    ends = parts.select("_key", "_part", *[f"_carry_{o}" for o in wanted],
                        F.inline(F.when(F.col("_from") == F.col("_to"), F.array(low)).otherwise(F.array(low, high))))
    first = F.min_by(F.struct(*[F.col(f"_carry_{o}") for o in wanted], *[F.col(f"_b_{o}") for o in wanted]), "_part")
    spans = ends.groupBy("_key", "_e").agg(F.count(F.lit(1)).alias("_n"), first.alias("_q"),
                                           *[MERGE[f](f"_f_{o}").alias(f"_tot_{o}") for o, (f, _) in wanted.items()]).where("_n > 1")
    spans = spans.select("_key", "_e", F.struct(
        *[merged(f, F.col("_q")[f"_carry_{o}"], F.col("_q")[f"_b_{o}"]).alias(f"_pre_{o}") for o, (f, _) in wanted.items()],
        *[F.col(f"_tot_{o}") for o in wanted]).alias("_span"))
    for side, value in (("_at_lo", "_from"), ("_at_hi", "_to")):
        parts = parts.join(spans.select("_key", F.col("_e").alias(value), F.col("_span").alias(side)), ["_key", value], "left")
    return parts.select("_key", "_part", "_at_lo", "_at_hi", *[f"_carry_{o}" for o in wanted])
