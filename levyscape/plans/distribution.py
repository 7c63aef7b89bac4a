"""Who pays: weighted tables of the mart by expenditure group and attribute."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levyscape.operators.weighted import weighted_box, weighted_mean, wmean

WEIGHT = "hh_weights"


def mean_by(df: DataFrame, value: str, by: Sequence[str], out: str = "mean") -> DataFrame:
    return weighted_mean(df, value, WEIGHT, by, out)


def means_by(df: DataFrame, values: Mapping[str, str], by: Sequence[str], scale: float = 1.0) -> DataFrame:
    """Weighted means of several columns, ``{output: column}``, in one aggregation."""
    return df.groupBy(*by).agg(
        *[(wmean(c, WEIGHT) * scale).alias(name) for name, c in values.items()]
    )


def box_by(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    return weighted_box(df, value, WEIGHT, by)


def box_by_carrier(df: DataFrame, bin_: str, carriers: Sequence[str]) -> DataFrame:
    """Box tables of several burdens, stacked: the burdens become one long column first."""
    columns = [f"burden_CO2_{c}" for c in carriers]
    long = df.select(bin_, WEIGHT, *columns).unpivot([bin_, WEIGHT], columns, "category", "burden")
    box = weighted_box(long, "burden", WEIGHT, [bin_, "category"])
    return box.select(*[c for c in box.columns if c != "category"], "category")


def crosstab(df: DataFrame, value: str, row: str, bin_: str, bins: Sequence[int]) -> DataFrame:
    """Weighted mean by attribute (rows) and bin (columns "1".."k"), in one shuffle."""
    x, w, b = F.col(value), F.col(WEIGHT), F.col(bin_)
    return df.groupBy(row).agg(
        *[wmean(F.when(b == k, x), F.when(b == k, w)).alias(str(k)) for k in bins]
    )
