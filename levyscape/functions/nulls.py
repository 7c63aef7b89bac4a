"""Aggregates and joins that keep the survey rules for missing values.

Spark skips nulls in ``sum``/``avg`` and never matches a null key. Survey code
treats a missing value as contagious and lets missing keys meet each other.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_sum(c: str | Column, na: str = "propagate") -> Column:
    """Sum that is null as soon as one input is null (``na="skip"``: plain sum)."""
    c = _col(c)
    if na == "skip":
        return F.sum(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def strict_mean(c: str | Column, na: str = "propagate") -> Column:
    """Mean that is null as soon as one input is null (``na="skip"``: plain mean)."""
    c = _col(c)
    if na == "skip":
        return F.avg(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def ratio(a: str | Column, b: str | Column) -> Column:
    """IEEE division: x/0 is infinite and 0/0 is NaN instead of an error."""
    a, b = _col(a).cast("double"), _col(b).cast("double")
    by_zero = (
        F.when(a > 0, F.lit(float("inf")))
        .when(a < 0, F.lit(float("-inf")))
        .otherwise(F.lit(float("nan")))
    )
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def natural_join(
    a: DataFrame,
    b: DataFrame,
    how: str = "left",
    keys: Sequence[str] | None = None,
    null_safe: bool = True,
) -> DataFrame:
    """Equi-join on every shared column name (or on ``keys``).

    Null keys match null keys unless ``null_safe`` is off. The result has the
    left columns, then the right columns that are not keys. No side is hinted:
    Spark broadcasts a side only when its own size estimate, or the size AQE
    measured, is under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    keys = list(keys) if keys is not None else [c for c in a.columns if c in set(b.columns)]
    if not keys:
        raise ValueError("no shared column to join on")
    if not null_safe:
        joined = a.join(b, on=keys, how=how)
        if how in ("left_semi", "left_anti"):
            return joined
        return joined.select(*a.columns, *[c for c in b.columns if c not in keys])
    left_of = lambda c: F.col(f"__l.`{c}`")
    right_of = lambda c: F.col(f"__r.`{c}`")
    cond = reduce(and_, [left_of(k).eqNullSafe(right_of(k)) for k in keys])
    joined = a.alias("__l").join(b.alias("__r"), cond, how)
    if how in ("left_semi", "left_anti"):
        return joined
    either = how in ("full", "outer", "full_outer", "right")
    left = [
        (F.coalesce(left_of(c), right_of(c)) if either and c in keys else left_of(c)).alias(c)
        for c in a.columns
    ]
    return joined.select(*left, *[right_of(c).alias(c) for c in b.columns if c not in keys])
