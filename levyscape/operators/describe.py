"""Unweighted descriptions of one column; the numbers behind the plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levyscape.operators.reshape import share_of
from levyscape.operators.weighted import weighted_stats


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Equal-width bins 0..bins-1; the highest value belongs to the last bin."""
    x = F.col(value).cast("double")
    edges = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).select(F.struct("lo", "hi")).scalar()
    width = (F.col("_e.hi") - F.col("_e.lo")) / bins
    at = F.coalesce(F.floor(F.try_divide(x - F.col("_e.lo"), width)), F.lit(0))
    return (
        df.filter(x.isNotNull())
        .withColumn("_e", edges)
        .groupBy(F.least(at, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def box_stats(df: DataFrame, value: str) -> DataFrame:
    """Five numbers and how many values lie beyond 1.5 interquartile ranges."""
    names = ["lowest", "q1", "median", "q3", "highest"]
    five = weighted_stats(df, value, None, [0.0, 0.25, 0.5, 0.75, 1.0], names)
    fence = five.select(
        F.struct(
            (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("low"),
            (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("high"),
        )
    ).scalar()
    outliers = (
        df.withColumn("_f", fence)
        .agg(
            F.count_if((F.col(value) < F.col("_f.low")) | (F.col(value) > F.col("_f.high")))
        )
        .scalar()
    )
    return five.withColumn("n_outliers", outliers)


def summary6(df: DataFrame, value: str) -> DataFrame:
    """Lowest, quartiles, mean, highest and the number of missing values."""
    names = ["lowest", "q1", "median", "q3", "highest"]
    five = weighted_stats(df, value, None, [0.0, 0.25, 0.5, 0.75, 1.0], names, mean="mean")
    missing = df.agg(F.count_if(F.col(value).isNull())).scalar()
    return five.withColumn("n_missing", missing)


def variances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sample variance of every column, in one row."""
    return df.agg(*[F.var_samp(c).alias(c) for c in columns])


def value_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count and percentage of every value of every listed column."""
    as_text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    counts = (
        as_text.unpivot([], list(columns), "column_name", "value")
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return share_of(counts, "count", ["column_name"], "_s").select(
        "column_name", "value", "count", (F.col("_s") * 100).alias("percentage")
    )
