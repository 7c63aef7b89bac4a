"""Reshaping, group totals on rows, and column-set helpers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levyscape.functions.nulls import natural_join, ratio, strict_sum
from levyscape.operators.ranking import ranked


def to_long(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str
) -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(ids), list(values), name, value)


def pivot_fill(
    df: DataFrame,
    ids: Sequence[str],
    key: str,
    value: str,
    keys: Sequence,
    prefix: str = "",
    fill: float | None = None,
    agg=F.sum,
) -> DataFrame:
    """Long to wide over the listed keys, in one shuffle on ``ids``.

    Every key is one conditional aggregate, so partial results combine before
    the shuffle. Absent combinations are null, or ``fill``.
    """
    cols = []
    for k in keys:
        c = agg(F.when(F.col(key) == F.lit(k), F.col(value)))
        cols.append((c if fill is None else F.coalesce(c, F.lit(fill))).alias(f"{prefix}{k}"))
    return df.groupBy(*ids).agg(*cols)


def transpose_summary(df: DataFrame, group: str, groups: Sequence) -> DataFrame:
    """One row per variable, one column per group (the input has one row per group)."""
    variables = [c for c in df.columns if c != group]
    long = df.select(group, *[F.col(c).cast("double").alias(c) for c in variables]).unpivot(
        [group], variables, "variable", "value"
    )
    return pivot_fill(long, ["variable"], group, "value", groups, agg=F.max)


def with_totals(df: DataFrame, by: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Group aggregates on every row.

    Aggregated first (with map-side combine) and joined back, so a hot group is
    never gathered in one task as a window over it would do; AQE splits its join.
    """
    totals = df.groupBy(*by).agg(*[c.alias(name) for name, c in aggs.items()])
    return natural_join(df, totals, "left", list(by))


def group_size(df: DataFrame, by: Sequence[str], out: str = "number") -> DataFrame:
    return with_totals(df, by, {out: F.count(F.lit(1))})


def share_of(
    df: DataFrame, value: str, by: Sequence[str], out: str = "share", na: str = "propagate"
) -> DataFrame:
    """Each row's part of its group's total."""
    total = with_totals(df, by, {"_total": strict_sum(value, na)})
    return total.withColumn(out, ratio(value, "_total")).drop("_total")


def flag_share(df: DataFrame, flag: str, by: Sequence[str], out: str) -> DataFrame:
    """Share of flagged rows in the group, on every row."""
    return with_totals(df, by, {out: F.avg(flag)})


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key, the first in ``order`` (then by all other columns).

    A ``min`` over a struct combines on the map side, so copies of one key are
    thinned before the shuffle and the choice does not depend on partitioning.
    """
    rest = [c for c in df.columns if c != key and c not in order]
    lead = [c for c in order if c != key]
    return (
        df.groupBy(key)
        .agg(F.min(F.struct(*lead, *rest)).alias("_first"))
        .select(*[F.col(c) if c == key else F.col(f"_first.{c}").alias(c) for c in df.columns])
    )


def surrogate_join(df: DataFrame, keys: DataFrame, key: str, new: str) -> DataFrame:
    """Replace ``key`` by the surrogate in ``keys``; the result keeps the key's name."""
    out = natural_join(df, keys, "left", [key])
    return out.select(F.col(new).alias(key), *[c for c in df.columns if c != key])


def row_index(df: DataFrame, by: Sequence[str], order: str, out: str = "index") -> DataFrame:
    """Row number within the group in the order of an ordinal column of any type that sorts."""
    return ranked(df, order, order, by, out, "_n").drop("_n")


def with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def drop_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*with_prefix(df, prefix))


def move_last(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in names], *names)


def move_first(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names, *[c for c in df.columns if c not in names])


def add_prefix(df: DataFrame, columns: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in columns})


def apply_to(df: DataFrame, columns: Sequence[str], fn) -> DataFrame:
    """Replace every listed column by ``fn(column)``."""
    return df.withColumns({c: fn(F.col(c)) for c in columns})
