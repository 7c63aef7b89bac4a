"""Data-quality reports. Each returns a DataFrame, so it composes and scales.

Households found by a report can be dropped from any table with ``drop_flagged``
or looked at item by item with ``drill_down``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levyscape.functions.nulls import natural_join
from levyscape.operators.reshape import group_size
from levyscape.sources.staging import stage


class CheckFailed(ValueError):
    """A report that had to be empty is not."""


def require(report: DataFrame, message: str) -> None:
    """Stop when the report holds a row (fetches one row at most)."""
    worst = report.take(1)
    if worst:
        raise CheckFailed(f"{message}: {worst[0].asDict()}")


def key_coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys on both sides and how many miss on either."""
    left = a.select(key).distinct().withColumn("_a", F.lit(1))
    right = b.select(key).distinct().withColumn("_b", F.lit(1))
    return natural_join(left, right, "full", [key]).agg(
        F.count("_a").alias("n_left"),
        F.count("_b").alias("n_right"),
        F.count_if(F.col("_b").isNull()).alias("only_left"),
        F.count_if(F.col("_a").isNull()).alias("only_right"),
    )


def duplicate_rows(df: DataFrame, key: str) -> DataFrame:
    """Keys of rows equal to another row in every column but the key."""
    rest = [c for c in df.columns if c != key]
    return group_size(df, rest).filter(F.col("number") > 1).select(key, "number")


def duplicate_baskets(exp: DataFrame, key: str, item: str, value: str) -> DataFrame:
    """Households whose items and amounts all equal those of another household.

    A basket is summarised by commutative hashes, which combine on the map side
    and never gather a household's lines. Households under one hash are verified
    together: their baskets are equal if every line among them is reported by all
    of them, which again is a combinable count, whatever the number of copies.
    A group that fails (two baskets under one hash) is compared line by line. The
    counted lines and the baskets are staged: the input is aggregated once.
    """
    lines = stage(
        exp.filter(F.col(value).isNotNull())
        .groupBy(key, item, value)
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    hashed = lines.withColumns(
        {
            "_h1": F.xxhash64(item, value, "_c"),
            "_h2": F.xxhash64("_c", value, item, F.lit("second")).cast("decimal(20,0)"),
        }
    )
    signature = ["_n", "_s1", "_s2"]
    baskets = stage(
        hashed.groupBy(key).agg(
            F.count(F.lit(1)).alias("_n"), F.bit_xor("_h1").alias("_s1"), F.sum("_h2").alias("_s2")
        )
    )
    groups = (
        baskets.groupBy(*signature)
        .agg(F.count(F.lit(1)).alias("_k"), F.min(key).alias("_rep"))
        .filter(F.col("_k") > 1)
    )
    candidates = baskets.join(groups, on=signature).select(key, "_rep", "_k")
    tagged = lines.join(candidates, on=key)
    verdict = (
        tagged.groupBy("_rep", "_k", item, value, "_c")
        .agg(F.count(F.lit(1)).alias("_m"))
        .groupBy("_rep")
        .agg(F.bool_and(F.col("_m") == F.col("_k")).alias("_same"))
    )
    judged = candidates.join(verdict, on="_rep")
    confirmed = judged.filter("_same").select(key, F.col("_k").alias("number"))
    odd = lines.join(judged.filter(~F.col("_same")).select(key), on=key, how="left_semi")
    spelled = odd.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(item, value, "_c"))).alias("_basket")
    )
    collided = group_size(spelled, ["_basket"]).filter(F.col("number") > 1).select(key, "number")
    return confirmed.unionByName(collided)


def shared_values(exp: DataFrame, key: str, item: str, value: str) -> DataFrame:
    """Households with no (item, amount) of their own: every line is reported elsewhere too.

    A pair seen once has one owner; households that own no such pair remain.
    The lines themselves are never joined.
    """
    lines = exp.filter(F.col(value).isNotNull() & (F.col(value) != 0))
    owners = (
        lines.groupBy(item, value)
        .agg(F.count(F.lit(1)).alias("_c"), F.min(key).alias(key))
        .filter(F.col("_c") == 1)
        .select(key)
        .distinct()
    )
    return lines.select(key).distinct().join(owners, on=key, how="left_anti")


def household_totals(exp: DataFrame, key: str, value: str) -> DataFrame:
    lines = exp.filter(F.col(value).isNotNull() & (F.col(value) != 0))
    return lines.groupBy(key).agg(F.sum(value).alias("hh_expenditures"))


def duplicate_totals(exp: DataFrame, key: str, value: str) -> DataFrame:
    """Households whose total, in cents, equals another household's."""
    totals = household_totals(exp, key, value).withColumn(
        "hh_expenditures", F.round("hh_expenditures", 2)
    )
    return group_size(totals, ["hh_expenditures"]).filter(F.col("number") > 1)


def negative_totals(exp: DataFrame, key: str, value: str) -> DataFrame:
    return household_totals(exp, key, value).filter(F.col("hh_expenditures") < 0)


def duplicate_lines(exp: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every line whose key combination occurs more than once.

    Lines are staged, so what they are joined from runs once; only combinations that
    repeat are joined back to them.
    """
    lines = stage(exp)
    repeated = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("number")).filter(F.col("number") > 1)
    return natural_join(lines, repeated, "inner", list(keys))


def collapse_lines(exp: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sum repeated lines after dropping rows with a missing value or key."""
    return exp.na.drop("any", subset=[*keys, value]).groupBy(*keys).agg(F.sum(value).alias(value))


def unmatched_codes(fact: DataFrame, dim: DataFrame, code: str) -> DataFrame:
    """Codes in use that the concordance does not know."""
    return natural_join(fact.select(code).distinct(), dim, "left_anti", [code])


def ambiguous_codes(dim: DataFrame, code: str) -> DataFrame:
    """Codes mapped more than once."""
    return dim.groupBy(code).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != 1)


def two_sided_coverage(a: DataFrame, b: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Codes found on one side only."""
    both = natural_join(a, b, "full", [key])
    return both.filter(F.col(left).isNull() | F.col(right).isNull()).select(key, left, right)


def any_infinite(columns: Sequence[str]) -> Column:
    """Aggregate: is any of the columns infinite anywhere."""
    hit = reduce(or_, [F.abs(c) == F.lit(float("inf")) for c in columns])
    return F.coalesce(F.bool_or(hit), F.lit(False))


def has_infinite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: is any of the columns infinite anywhere."""
    return df.agg(any_infinite(columns).alias("infinite"))


def drill_down(df: DataFrame, flagged: DataFrame, key: str) -> DataFrame:
    """Rows of the flagged households."""
    return df.join(flagged.select(key).distinct(), on=key, how="left_semi")


def drop_flagged(df: DataFrame, flagged: DataFrame, key: str) -> DataFrame:
    """Rows of all other households."""
    return df.join(flagged.select(key).distinct(), on=key, how="left_anti")


def report_row(report: DataFrame, check: str, template: str) -> DataFrame:
    """Summarise a report as ``check, n, detail`` with the count put into the text."""
    return report.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(check).alias("check"), "n", F.format_string(template, "n").alias("detail")
    )
