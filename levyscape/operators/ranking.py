"""Exact global order statistics without a global sort in one task.

Row numbers: rows are dealt to ranges of (group, order, tie), ordered there and written;
the counts of ranges and groups give the offsets. The keys may be of any type that sorts,
and neither a hot group nor a mass of nulls or ties stays in one range.

Quantiles (``weighted``): a value is placed in one of a fixed number of cells by
comparing it with bounds from one mergeable sketch. The cell is a pure function of the
value, so it is the same on every retry. The bounds follow the data, so a cell holds
about 2,000 rows, or 1/4096 of the rows of the *whole* table if that is more, whatever
the grouping: a hot group is spread over many cells.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from levyscape.functions.nulls import natural_join
from levyscape.sources.staging import stage

MAX_CELLS = 4096
ROWS_PER_CELL = 2_000
# Rank error of a bound is at most 1/ACCURACY of the rows, less than half a cell.
ACCURACY = 10_000


def cell_bounds(
    df: DataFrame, limits: Mapping[str, int], rows_per_cell: int = ROWS_PER_CELL, most: str | None = None, count: Column | None = None
) -> dict[str, list[float]]:
    """Distinct ascending bounds for each numeric column, at most ``limit - 1`` of them.

    One job over the table with a mergeable sketch that also counts the rows:
    a small table gets few cells. The driver holds the bounds only, and the largest value
    of the column ``most`` as its single bound; so with the aggregate ``count``.
    """
    aggs = [(F.lit(0) if count is None else count).alias("count"), F.count(F.lit(1)).alias("n"), (F.lit(None) if most is None else F.max(most)).cast("double").alias("most")]
    for i, (column, limit) in enumerate(limits.items()):
        probs = ", ".join(f"{j / limit!r}D" for j in range(1, limit))
        aggs.append(
            F.expr(f"percentile_approx(`{column}`, array({probs}), {ACCURACY})").alias(f"b{i}")
        )
    columns = dict.fromkeys([*limits, *([most] if most else [])])
    found = df.withColumns({c: F.col(c).cast("double") for c in columns}).agg(*aggs).first()
    out = {most: [found.most or 1.0]} if most else {}
    if count is not None:
        out["count"] = [found["count"]]
    for i, (column, limit) in enumerate(limits.items()):
        every = max(1, limit * rows_per_cell // max(found["n"], 1))
        sketched = found[f"b{i}"] or [0.0]
        out[column] = sorted(set(sketched[every // 2 :: every] or sketched[:1]))
    return out


def with_cell(df: DataFrame, column: str, bounds: Sequence[float], out: str) -> DataFrame:
    """Add the value cell: how many bounds are at or below the value; -1 for a null, which sorts first."""
    binner = Bucketizer(
        splits=[float("-inf"), *bounds, float("inf")], inputCol="_value", outputCol=out, handleInvalid="keep"
    )
    cell = F.when(F.col(column).isNull(), F.lit(-1)).otherwise(F.col(out).cast("int"))
    return binner.transform(df.withColumn("_value", F.col(column).cast("double"))).drop("_value").withColumn(out, cell)


def dealt_by_range(df: DataFrame, keys: Sequence[str], rows_per_cell: int | None = None) -> DataFrame:
    """df written in ranges of ``keys``, each ordered: `_part` is a row's range, `_at` its place there.

    The bounds come from a sample of whole keys, of any types that sort, so a point mass
    or the nulls of one key are divided by the keys behind it; a hash of the whole row
    comes last, so that only equal rows cannot be told apart. The number of ranges is the
    session's number of shuffle partitions, or follows ``rows_per_cell``.
    """
    last = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if not _is_map(df, c)])
    order = [*[F.col(f"`{k}`") for k in dict.fromkeys(keys)], F.col("_last")]
    dealt = df.withColumn("_last", last)
    if rows_per_cell is None:
        dealt = dealt.repartitionByRange(*order)
    else:
        dealt = dealt.repartitionByRange(max(1, -(-df.count() // rows_per_cell)), *order)
    # the number of a row is its range's number and its place in the range
    numbered = dealt.sortWithinPartitions(*order).drop("_last").withColumn("_id", F.monotonically_increasing_id())
    return stage(numbered.select(*[F.col(f"`{c}`") for c in df.columns], F.shiftright("_id", 33).cast("int").alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))


def _is_map(df: DataFrame, column: str) -> bool:
    return "map<" in df.schema[column].dataType.simpleString()


def placed(df: DataFrame, order: str, tie: str, by: Sequence[str] = (), rows_per_cell: int | None = None) -> DataFrame:
    """df with each row's number by ``(order, tie)``, nulls first: `_rn`, of `_n`, the first `_nulls` without ``order``.

    Numbers are overall or within ``by``. The rows move once, to their range; what each
    range and each group holds gives the offsets.
    """
    by = list(by)
    dealt = dealt_by_range(df, [*by, order, tie], rows_per_cell)
    group = Window.partitionBy(*(by or [F.lit(0)]))
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range and group in it: without groups as many as there are ranges
    cells = (
        dealt.groupBy("_part", *by)
        .agg(F.count(F.lit(1)).alias("_c"), F.count_if(F.col(order).isNull()).alias("_z"), F.min("_at").alias("_first"))
        .select(
            "_part",
            *by,
            (F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_first") + 1).alias("_off"),
            F.sum("_c").over(group).alias("_n"),
            F.sum("_z").over(group).alias("_nulls"),
        )
    )
    # written, so that the planner knows how few they are: the rows stay where they are
    joined = natural_join(dealt, stage(cells), "inner", ["_part", *by], null_safe=bool(by))
    return joined.withColumn("_rn", F.col("_at") + F.col("_off")).drop("_part", "_at", "_off")


def ranked(
    df: DataFrame,
    order: str,
    tie: str,
    by: Sequence[str] = (),
    rn: str = "rn",
    n: str = "n",
    rows_per_cell: int | None = None,
) -> DataFrame:
    """Row number by ``(order, tie)``, nulls first, and row count, overall or within ``by``; keys of any type that sorts."""
    out = placed(df, order, tie, by, rows_per_cell)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_n").alias(n), F.col("_rn").alias(rn))


def ntile_of(rn: Column, n: Column, k: int) -> Column:
    """Bucket 1..k of row ``rn`` of ``n``; the first ``n mod k`` buckets hold one row more."""
    q, r = F.floor(n / k), n % k
    head = r * (q + 1)
    return F.when(rn <= head, F.ceil(rn / (q + 1))).otherwise(
        r + F.ceil(F.try_divide(rn - head, q))
    ).cast("int")


def ntile(
    df: DataFrame, value: str, k: int, tie: str, out: str, by: Sequence[str] = (), rows_per_cell: int | None = None
) -> DataFrame:
    """Equal-count buckets; a null value has no bucket."""
    at = placed(df, value, tie, by, rows_per_cell)
    # nulls come first: the others are numbered behind them
    bucket = ntile_of(F.col("_rn") - F.col("_nulls"), F.col("_n") - F.col("_nulls"), k)
    return at.select(*[F.col(f"`{c}`") for c in df.columns], F.when(F.col("_rn") > F.col("_nulls"), bucket).alias(out))


def surrogate_index(df: DataFrame, key: str, out: str) -> DataFrame:
    """Distinct keys of any type that sorts, numbered 1..n in key order, a null first."""
    return ranked(df.select(key).distinct(), key, key, rn=out, n="_n").drop("_n")
