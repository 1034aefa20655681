"""Small null-safe expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def ratio(num, den) -> Column:
    """num / den, NULL when den is 0 (division by zero raises under ANSI mode)."""
    return col(num) / F.nullif(col(den), F.lit(0))


def flag(cond: Column) -> Column:
    """1 when `cond` is true, 0 when false or NULL."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


# Steps of a steady sum, and the size up to which a value's steps fit a long.
STEP, STEPPED = 2.0 ** -40, 2.0 ** 22


def steady_sum(value) -> Column:
    """Aggregate: a sum that no order of the rows changes.

    Values are counted in steps of 2^-40 and the steps are added exactly. A group
    with a value of 2^22 or more (or none that is finite) is added as doubles.
    """
    v = col(value).cast("double")
    fits = F.abs(v) < STEPPED
    steps = F.sum(F.floor(F.when(fits, v) / STEP + 0.5).cast("decimal(20,0)")).cast("double") * STEP
    return F.when(F.count(v) == F.count(F.when(fits, v)), steps).otherwise(F.sum(v))


def complete_sum(value) -> Column:
    """Aggregate: the `steady_sum`, or NULL when any value in the group is missing."""
    v = col(value)
    return F.when(F.count(v) == F.count(F.lit(1)), steady_sum(v))


def leave_one_out(value, total, size) -> Column:
    """Mean of the other members, from a group's `complete_sum` and its size."""
    return ratio(col(total) - col(value), col(size) - 1)


def r6(c) -> Column:
    """Six decimals, half up in plain double arithmetic (the same steps in any engine)."""
    return F.floor(col(c) * 1000000.0 + 0.5) / F.lit(1000000.0)


def correlation(x, y) -> Column:
    """Aggregate: Pearson correlation of complete pairs, NULL without variation.

    The built-in `corr` divides by zero on constant input under ANSI mode, even
    behind a guard, since aggregates are evaluated first.
    """
    seen = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(seen, col(x).cast("double")), F.when(seen, col(y).cast("double"))
    varied = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varied, F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))
