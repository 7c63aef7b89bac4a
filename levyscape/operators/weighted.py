"""Exact survey-weighted distribution statistics.

Definition: rows whose weight is null, NaN, infinite, zero or negative, or whose value is
null or NaN, are left out, of quantiles and means alike. Weights are summed as pairs of
whole numbers (``Limbs``: 14 decimal places below the largest weight, whatever its
magnitude; a sum that does not fit is an error), so the sums, and with them every rank,
do not depend on the order of the rows, on partitions or on cells. With
``n`` the weight total and ``h = 1 + (n-1)p``, the quantile lies between the
smallest value whose running weight reaches ``max(floor(h), 1)`` and the one
reaching one more (at most ``n``), at the fraction ``frac(h)``.

Plan: one mergeable sketch gives value cells, one small histogram of weights
per (group, cell) tells which cells hold a wanted rank, and only the rows of
those few cells are shuffled and ordered. The rest of the table is never moved.
The sketch and, for groups, the histogram run when the operator is called (they
yield the bounds and a checked size); the last pass is lazy.

Many small groups (by the sketch's estimate): the rows move once, to ranges of (group,
value). A task streams over its ordered range and finishes every group that lies inside;
only the first and the last may go on elsewhere, and their running weights get the
offsets of the ranges before. The result is the same either way.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from levyscape.functions.nulls import natural_join
from levyscape.operators.ranking import MAX_CELLS, ROWS_PER_CELL, cell_bounds, with_cell
from levyscape.sources.staging import stage

# Groups for each shuffle partition from which on most groups lie inside one range.
GROUPS_PER_RANGE = 4

BOX_PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)
BOX_NAMES = ("y5", "y25", "y50", "y75", "y95")


class Limbs:
    """Weights as ``high`` and ``low`` whole numbers, in units that follow the largest weight.

    The largest has six digits in ``high``; ``low`` counts 1e-8 of a unit. Weights with
    so many decimal places are exact, and whole totals come out as whole numbers. Sums
    fit for 9e10 rows of a cell and 9e12 of a group.
    """

    HIGH, LOW = 6, 8

    def __init__(self, largest: float):
        self.places = self.HIGH - math.ceil(math.log10(largest))

    def split(self, w: Column) -> tuple[Column, Column]:
        s = self._scaled(w, self.places)
        high = F.floor(s)
        return high, F.round((s - high) * 10.0**self.LOW).cast("long")

    def carried(self, high: Column, low: Column) -> tuple[Column, Column]:
        """The same total with ``low`` under one unit."""
        unit = F.lit(10**self.LOW)
        return high + self._times(low, unit), low % unit

    @staticmethod
    def _times(x: Column, unit: Column) -> Column:
        """How often the whole number ``unit`` fits, for all that fits a long."""
        return F.round((x - x % unit) / unit).cast("long")

    def number(self, high: Column, low: Column) -> Column:
        """The total as a double: the whole part exactly, then the rest of it."""
        high, low = self.carried(high, low)
        part = low / F.lit(10.0**self.LOW)
        if self.places <= 0:
            return self._scaled(high.cast("double"), -self.places) + self._scaled(part, -self.places)
        if self.places > 18:
            return self._scaled(high + part, -self.places)
        unit = F.lit(10**self.places)
        return self._times(high, unit) + self._scaled(high % unit + part, -self.places)

    def value(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """``number`` of arrays."""
        high, part = high + low // 10**self.LOW, low % 10**self.LOW / 10.0**self.LOW
        if self.places <= 0:
            return self._scaled(high.astype(float), -self.places) + self._scaled(part, -self.places)
        if self.places > 18:
            return self._scaled(high + part, -self.places)
        unit = 10**self.places
        return high // unit + self._scaled(high % unit + part, -self.places)

    @staticmethod
    def _scaled(x: Column, places: int) -> Column:
        return x * 10.0**places if places >= 0 else x / 10.0**-places


def _hits(probs: Sequence[float]) -> Column:
    """The wanted ranks that fall into a cell, as {i, v}.

    For every probability j these are the lower (i = 2j) and the upper (2j+1) rank.
    """
    parts = []
    for j, p in enumerate(probs):
        low = f"greatest(CAST(floor(1 + (_n - 1) * {float(p)!r}D) AS DOUBLE), 1D)"
        parts += [f"struct({2 * j} AS i, {low} AS v)", f"struct({2 * j + 1} AS i, least({low} + 1, _n) AS v)"]
    return F.expr(f"filter(array({', '.join(parts)}), r -> r.v > _before AND (r.v <= _upto OR _last))")


def _fraction(n: Column, p: float) -> Column:
    h = 1 + (n - 1) * float(p)
    return h - F.floor(h).cast("double")


def weighted_stats(
    df: DataFrame,
    value: str,
    weight: str | None,
    probs: Sequence[float],
    names: Sequence[str],
    by: Sequence[str] = (),
    mean: str | None = None,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """One row per group: the quantiles ``probs`` as ``names`` and, if asked, the mean.

    ``weight=None`` counts every row once. A group without a usable row is absent.
    """
    by = list(by)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.select(*by, F.col(value).cast("double").alias("_x"), w.alias("_w")).filter(present(F.col("_x")) & usable(F.col("_w")))
    groups = F.approx_count_distinct(F.struct(*by)) if by else F.lit(1)
    bounds = cell_bounds(rows, {"_x": MAX_CELLS}, rows_per_cell, most="_w", count=groups)
    limbs = Limbs(bounds["_w"][0])
    high, low = limbs.split(F.col("_w"))
    if by and bounds["count"][0] >= GROUPS_PER_RANGE * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return _streamed(rows.withColumns({"_h": high, "_l": low}), by, probs, names, mean, limbs)
    placed = with_cell(rows.withColumns({"_h": high, "_l": low}), "_x", bounds["_x"], "_cell")

    # (group, cell) histogram: at most MAX_CELLS rows per group reach this window.
    group = Window.partitionBy(*(by or [F.lit(0)]))
    walk = group.orderBy("_cell")
    upto = walk.rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy(*by, "_cell").agg(F.sum("_h").alias("_h"), F.sum("_l").alias("_l"), F.sum(F.col("_w") * F.col("_x")).alias("_cwx"))
    high, low = limbs.carried(F.col("_h"), F.col("_l"))
    hist = (
        sums.withColumns({"_h": high, "_l": low})
        .select(
            *by,
            "_cell",
            (F.sum("_h").over(upto) - F.col("_h")).alias("_bh"),
            (F.sum("_l").over(upto) - F.col("_l")).alias("_bl"),
            limbs.number(F.sum("_h").over(upto), F.sum("_l").over(upto)).alias("_upto"),
            limbs.number(F.sum("_h").over(group), F.sum("_l").over(group)).alias("_n"),
            F.sum("_cwx").over(group).alias("_wx"),
            F.lead("_cell").over(walk).isNull().alias("_last"),
        )
        .withColumn("_before", limbs.number(F.col("_bh"), F.col("_bl")))
    )
    # Cells holding a wanted rank: at most two per group and probability.
    state = ["_bh", "_bl", "_before", "_upto", "_n", "_wx", "_last"]
    targets = hist.filter(F.size(_hits(probs)) > 0).select(*by, "_cell", *state)
    # Ungrouped, two rows per probability; of groups, the planner knows the written size.
    targets = stage(targets) if by else F.broadcast(targets)

    # With a broadcast all other rows drop out before any shuffle. Equal values
    # collapse on the map side, so a point mass is a single row.
    keys = [*by, "_cell"]
    chosen = (
        natural_join(placed, targets, "inner", keys, null_safe=bool(by))
        .groupBy(*keys, "_x")
        .agg(F.sum("_h").alias("_h"), F.sum("_l").alias("_l"), *[F.max(c).alias(c) for c in state])
    )
    inside = (
        Window.partitionBy(*by, "_cell")
        .orderBy("_x")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    cum = chosen.withColumn("_cum", limbs.number(F.col("_bh") + F.sum("_h").over(inside), F.col("_bl") + F.sum("_l").over(inside)))
    # Per wanted rank the smallest value reaching it, else the cell's largest.
    ranks = (
        cum.select(*by, "_x", "_cum", "_n", "_wx", F.explode(_hits(probs)).alias("_r"))
        .groupBy(*by, F.col("_r.i").alias("_i"))
        .agg(
            F.coalesce(
                F.min(F.when(F.col("_cum") >= F.col("_r.v"), F.col("_x"))), F.max("_x")
            ).alias("_q"),
            F.max("_n").alias("_n"),
            F.max("_wx").alias("_wx"),
        )
    )
    found = ranks.groupBy(*by).agg(
        F.max("_n").alias("_n"),
        F.max("_wx").alias("_wx"),
        F.map_from_entries(F.collect_list(F.struct("_i", "_q"))).alias("_qs"),  # 2 per probability
    )
    out = []
    for j, (p, name) in enumerate(zip(probs, names, strict=True)):
        low, high = F.try_element_at("_qs", F.lit(2 * j)), F.try_element_at("_qs", F.lit(2 * j + 1))
        # low + f*(high-low) so that equal neighbours give exactly their value.
        out.append((low + _fraction(F.col("_n"), p) * (high - low)).alias(name))
    if mean is not None:
        out.append(F.try_divide("_wx", "_n").alias(mean))
    result = found.filter(F.col("_n").isNotNull()).select(*by, *out)
    return result if by else F.broadcast(result)  # one row


def _stream(n_by: int, probs: Sequence[float], limbs: Limbs):
    """Rows ordered by group and value: one row for each group that ends here, those of the range's first and last group as they are.

    Columns in: the group, _part, _x, _h, _l, _wx. Out: the group, _part, _x, _h and _l (running), _wx,
    _n and _q (both ranks of each probability) of finished groups.
    """

    def changes(batch, before):
        """Where a group begins, given the group of the row before."""
        new = np.zeros(batch.num_rows, bool)
        for c in range(n_by):
            code = batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        first = [batch.column(c)[0].as_py() for c in range(n_by)]
        new[0] = before is not None and not all(a == b or (a != a and b != b) for a, b in zip(first, before))
        return new, [batch.column(c)[-1].as_py() for c in range(n_by)]

    def numbers(table):
        return [table.column(n_by + 1 + i).to_numpy() for i in range(4)]

    def unfinished(table):
        """Rows of one group with running weights; of equal values the last."""
        x, h, low, wx = numbers(table)
        last = np.concatenate((x[1:] != x[:-1], [True]))
        sums = np.zeros(int(last.sum()))
        sums[-1] = wx.sum()
        kept = table.filter(pa.array(last))
        nothing = [pa.nulls(kept.num_rows, pa.float64()), pa.nulls(kept.num_rows, pa.list_(pa.float64()))]
        columns = [*kept.columns[: n_by + 2], *(pa.array(np.cumsum(v)[last]) for v in (h, low)), pa.array(sums), *nothing]
        return pa.Table.from_arrays(columns, [*kept.column_names, "_n", "_q"])

    def finished(table, start):
        x, h, low, wx = numbers(table)
        sizes = np.diff(np.concatenate((start, [len(x)])))
        h, low = (np.cumsum(v) - np.repeat(np.cumsum(v)[start] - v[start], sizes) for v in (h, low))
        cum, end = limbs.value(h, low), start + sizes - 1
        n, q = cum[end], []
        for p in probs:
            rank = np.maximum(np.floor(1 + (n - 1) * p), 1.0)
            for v in (rank, np.minimum(rank + 1, n)):
                short = np.add.reduceat(cum < np.repeat(v, sizes), start, dtype=np.int64)
                q.append(x[np.minimum(start + short, end)])
        offsets = pa.array(np.arange(len(start) + 1, dtype=np.int32) * len(q))
        columns = [*table.take(pa.array(end)).columns[: n_by + 2], pa.array(h[end]), pa.array(low[end]), pa.array(np.add.reduceat(wx, start))]
        columns += [pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(np.stack(q, axis=1).ravel()))]
        return pa.Table.from_arrays(columns, [*table.column_names, "_n", "_q"])

    def run(batches):
        held, before, first = [], None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            new, before = changes(batch, before)
            cut = np.flatnonzero(new)
            if not len(cut):
                held.append(batch)
                continue
            size = sum(b.num_rows for b in held)
            whole = pa.Table.from_batches([*held, batch.slice(0, cut[-1])])
            start = np.concatenate(([0], size + cut[:-1]))
            if first:  # it may have begun in the range before
                at = int(size + cut[0])
                yield from unfinished(whole.slice(0, at)).to_batches()
                whole, start, first = whole.slice(at), start[1:] - at, False
            if len(start):
                yield from finished(whole, start).to_batches()
            held = [batch.slice(cut[-1])]
        if held:
            yield from unfinished(pa.Table.from_batches(held)).to_batches()

    return run


def _streamed(rows: DataFrame, by: list[str], probs: Sequence[float], names: Sequence[str], mean: str | None, limbs: Limbs) -> DataFrame:
    """The statistics of many small groups: one range shuffle, one pass over the ordered rows."""
    dealt = rows.withColumn("_wx", F.col("_w") * F.col("_x")).withColumn("_to", F.pmod(F.xxhash64(*by, "_x", "_w"), F.lit(1 << 16)))
    dealt = dealt.repartitionByRange(*by, "_x", "_to").sortWithinPartitions(*by, "_x")
    dealt = dealt.select(*by, F.spark_partition_id().alias("_part"), "_x", "_h", "_l", "_wx")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema]
    found = stage(dealt.mapInArrow(_stream(len(by), probs, limbs), ", ".join([*kinds, "_n double", "_q array<double>"])))
    # groups that go on in other ranges: at most two pieces a range
    pieces = found.filter("_n is null")
    group = Window.partitionBy(*by)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = pieces.groupBy(*by, "_part").agg(F.max("_h").alias("_h"), F.max("_l").alias("_l"))
    offsets = sums.select(
        *by,
        "_part",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b{c}") for c in ("_h", "_l")],
        limbs.number(F.sum("_h").over(group), F.sum("_l").over(group)).alias("_n"),
    )
    joined = natural_join(pieces.drop("_n", "_q"), offsets, "inner", [*by, "_part"])
    joined = joined.withColumn("_cum", limbs.number(F.col("_h") + F.col("_b_h"), F.col("_l") + F.col("_b_l")))
    ranks = []
    for p in probs:
        low = F.greatest(F.floor(1 + (F.col("_n") - 1) * float(p)).cast("double"), F.lit(1.0))
        ranks += [low, F.least(low + 1, F.col("_n"))]
    reached = [F.coalesce(F.min(F.when(F.col("_cum") >= v, F.col("_x"))), F.max("_x")) for v in ranks]
    joined = joined.groupBy(*by).agg(F.max("_n").alias("_n"), F.array(*reached).alias("_q"), F.sum("_wx").alias("_wx"))
    every = found.filter("_n is not null").select(*by, "_n", "_q", "_wx").unionByName(joined)
    out = []
    for j, (p, name) in enumerate(zip(probs, names, strict=True)):
        low, high = F.get("_q", F.lit(2 * j)), F.get("_q", F.lit(2 * j + 1))
        out.append((low + _fraction(F.col("_n"), p) * (high - low)).alias(name))
    if mean is not None:
        out.append(F.try_divide("_wx", "_n").alias(mean))
    return every.select(*by, *out)


def weighted_quantile(
    df: DataFrame,
    value: str,
    weight: str | None,
    probs: Sequence[float],
    by: Sequence[str] = (),
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Exact weighted quantiles, one column per probability."""
    names = names or [f"q{round(p * 100):02d}" for p in probs]
    return weighted_stats(df, value, weight, probs, names, by)


def weighted_mean(
    df: DataFrame, value: str, weight: str, by: Sequence[str] = (), out: str = "mean"
) -> DataFrame:
    """Weighted mean over the rows that count for the quantiles."""
    return df.groupBy(*by).agg(wmean(value, weight).alias(out))


def present(x: Column) -> Column:
    """Neither null nor NaN: a share of nothing (0/0) is a missing value."""
    return x.isNotNull() & ~F.isnan(x.cast("double"))


def usable(w: Column) -> Column:
    """A weight that counts: positive and finite."""
    return (w > 0) & (w < float("inf"))


def wmean(value: str | Column, weight: str | Column) -> Column:
    """Weighted mean as an aggregate expression, over the values that are present and the weights that count."""
    x = F.col(value) if isinstance(value, str) else value
    w = F.col(weight) if isinstance(weight, str) else weight
    counts = present(x) & usable(w.cast("double"))
    return F.try_divide(F.sum(F.when(counts, w * x)), F.sum(F.when(counts, w)))


def weighted_box(df: DataFrame, value: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """Box table ``y5, y25, y50, y75, y95, mean`` per group."""
    return weighted_stats(df, value, weight, BOX_PROBS, BOX_NAMES, by, mean="mean")


def weighted_bins(
    df: DataFrame, value: str, weight: str, ks: Sequence[int], prefix: str = "bin_"
) -> DataFrame:
    """Bins 1..k of equal weight for every k, as ``<prefix><k>``.

    Intervals are closed on the right, the lowest value included; breaks that
    fall together collapse, which gives fewer, consecutive codes. All k share
    one quantile pass.
    """
    probs = sorted({i / k for k in ks for i in range(1, k)})
    names = [f"b{i}" for i in range(len(probs))]
    at = dict(zip(probs, names, strict=True))
    stats = weighted_stats(df, value, weight, [0.0, *probs, 1.0], ["b_min", *names, "b_max"])
    inner = [
        F.array_distinct(
            F.filter(
                F.array(*[at[i / k] for i in range(1, k)]),
                lambda b: (b > F.col("b_min")) & (b < F.col("b_max")),
            )
        ).alias(f"k{k}")
        for k in ks
    ]
    breaks = stats.select(F.struct(*inner).alias("_b")).scalar()
    x = F.col(value).cast("double")
    out = df.withColumn("_breaks", breaks)
    cols = {
        f"{prefix}{k}": F.when(
            x.isNotNull(), F.size(F.filter(F.col(f"_breaks.k{k}"), lambda b: x > b)) + 1
        ).cast("int")
        for k in ks
    }
    return out.withColumns(cols).drop("_breaks")


def flag_outliers(
    df: DataFrame,
    value: str,
    weight: str,
    by: Sequence[str] = (),
    probs: Sequence[float] = (0.95, 0.99),
) -> DataFrame:
    """Add ``outlier_<p>`` (the weighted quantile) and ``flag_outlier_<p>`` (value at or above it)."""
    names = [f"outlier_{round(p * 100)}" for p in probs]
    stats = weighted_stats(df, value, weight, probs, names, by)
    if by:
        out = natural_join(df, stage(stats), "left", list(by))
    else:
        out = df.withColumn("_s", stats.select(F.struct(*names)).scalar()).select(
            *df.columns, *[F.col(f"_s.{n}").alias(n) for n in names]
        )
    return out.withColumns({f"flag_{n}": (F.col(value) >= F.col(n)).cast("int") for n in names})


def replace_outliers(
    df: DataFrame,
    value: str,
    weight: str,
    by: Sequence[str],
    prob: float = 0.99,
    out: str | None = None,
) -> DataFrame:
    """Values at or above the weighted quantile of their group become its weighted median."""
    # written, so that the planner knows how few rows there are and need not move the table to them
    stats = stage(weighted_stats(df, value, weight, [prob, 0.5], ["_cap", "_mid"], by))
    joined = natural_join(df, stats, "left", list(by))
    kept = F.when(F.col(value) >= F.col("_cap"), F.col("_mid")).otherwise(F.col(value))
    return joined.withColumn(out or value, kept).drop("_cap", "_mid")
