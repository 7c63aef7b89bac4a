"""Carbon intensities, household footprints and the cost of a carbon price."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levyscape.functions.nulls import natural_join, ratio, strict_sum
from levyscape.operators.quality import drill_down
from levyscape.plans.spending import merge_gas

# Carrier name -> emission column of the intensity source.
CARRIERS = {
    "global": "CO2_Mt",
    "national": "CO2_Mt_within",
    "electricity": "CO2_Mt_Electricity",
    "transport": "CO2_Mt_Transport",
}
CONSUMPTION = "Total_HH_Consumption_MUSD"
PRICE = 30.0  # USD per tonne
OUTSIDE = "other"


def carbon_intensity(sectors: DataFrame, emissions: DataFrame) -> DataFrame:
    """Tonnes per dollar of final consumption for each sector and carrier.

    Emissions carry the sector *number* in a column also called GTAP.
    """
    numbered = emissions.withColumnRenamed("GTAP", "Number")
    merged = natural_join(
        sectors.select("Number", "GTAP"), numbered, "left", ["Number"]
    ).withColumn("GTAP", merge_gas("GTAP"))
    columns = [*CARRIERS.values(), CONSUMPTION]
    totals = merged.groupBy("GTAP").agg(*[strict_sum(c).alias(c) for c in columns])
    return totals.select(
        "GTAP",
        *[ratio(c, CONSUMPTION).alias(f"CO2_t_per_dollar_{name}") for name, c in CARRIERS.items()],
    )


def carbon_footprint(
    usd: DataFrame, intensity: DataFrame, year: int = 2014, exclude: Sequence[str] = (OUTSIDE,)
) -> DataFrame:
    """Tonnes per household and carrier.

    Spending outside the sector model carries no emissions but stays in the
    household total, which is taken before. A sector without an intensity makes
    the household's tonnes unknown.
    """
    spent, total = f"expenditures_USD_{year}", f"hh_expenditures_USD_{year}"
    lines = natural_join(
        usd.filter(~F.col("GTAP").isin(*exclude)), intensity, "left", ["GTAP"]
    )
    return lines.groupBy("hh_id").agg(
        F.max(total).alias(total),
        *[
            strict_sum(F.col(spent) * F.col(f"CO2_t_per_dollar_{name}")).alias(f"CO2_t_{name}")
            for name in CARRIERS
        ],
    )


def incidence(footprint: DataFrame, price: float = PRICE, year: int = 2014) -> DataFrame:
    """Cost of the carbon price and its share of household spending, per carrier."""
    total = f"hh_expenditures_USD_{year}"
    return footprint.withColumns(
        {f"exp_CO2_{name}": F.col(f"CO2_t_{name}") * price for name in CARRIERS}
    ).withColumns({f"burden_CO2_{name}": ratio(f"exp_CO2_{name}", total) for name in CARRIERS})


def high_footprint(footprint: DataFrame, threshold: float) -> DataFrame:
    """Households above the threshold in tonnes a year."""
    return footprint.filter(F.col("CO2_t_national") > threshold).select("hh_id")


def high_footprint_detail(
    footprint: DataFrame, threshold: float, *tables: DataFrame
) -> tuple[DataFrame, ...]:
    """The rows of each table (categories, items, bins) for those households."""
    high = high_footprint(footprint, threshold)
    return tuple(drill_down(t, high, "hh_id") for t in tables)
