"""Compensation schemes: what a household gains or loses once revenue is returned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levyscape.functions.nulls import ratio, strict_mean, strict_sum
from levyscape.operators.reshape import pivot_fill
from levyscape.operators.weighted import BOX_NAMES, weighted_box, wmean

TOTAL = "hh_expenditures_USD_2014"
BIN = "Income_Group_5"
# Scheme labels.
NONE, LUMP_SUM, CARRIER = "burden_CO2_national", "burden_CO2_revenue100", "burden_elec_sub"


def per_head_transfer(mart: DataFrame) -> DataFrame:
    """Revenue per head: weighted cost over weighted population."""
    w = F.col("hh_weights")
    return mart.agg(
        ratio(strict_sum(F.col("exp_CO2_national") * w), strict_sum(F.col("hh_size") * w)).alias(
            "transfer"
        )
    )


def unweighted_totals(mart: DataFrame) -> DataFrame:
    """Cost per household and the electricity carrier's total, both unweighted."""
    return mart.agg(
        strict_mean("exp_CO2_national").alias("cost_per_household"),
        strict_sum("exp_CO2_electricity").alias("total_electricity"),
    )


def _net_box(mart: DataFrame, gain: Column, label: str) -> DataFrame:
    table = mart.select(BIN, "hh_weights", gain.alias("_gain"))
    return weighted_box(table, "_gain", "hh_weights", [BIN]).withColumn("category", F.lit(label))


def lump_sum_gain(mart: DataFrame, total: str = TOTAL) -> DataFrame:
    """Net gain of each household, in shares of the total, when all revenue returns per head."""
    paid = mart.withColumn("_transfer", per_head_transfer(mart).scalar())
    net = F.col("exp_CO2_national") - F.col("_transfer") * F.col("hh_size")
    return paid.withColumn("net_gain", -ratio(net, total)).drop("_transfer")


def carrier_gain(carrier: str = "electricity", total: str = TOTAL) -> Column:
    """Net gain when the carrier's cost is refunded in full."""
    return -ratio(F.col("exp_CO2_national") - F.col(f"exp_CO2_{carrier}"), total)


def lump_sum(mart: DataFrame) -> DataFrame:
    return _net_box(lump_sum_gain(mart), F.col("net_gain"), LUMP_SUM)


def carrier_compensation(mart: DataFrame, carrier: str = "electricity") -> DataFrame:
    """The carrier's cost is refunded in full."""
    return _net_box(mart, carrier_gain(carrier), CARRIER)


def _sign_turned(box: DataFrame) -> DataFrame:
    """The burden with its sign turned: the columns keep their names, so they descend."""
    of_none = F.col("category") == NONE
    return box.withColumns({c: F.when(of_none, -F.col(c)).otherwise(F.col(c)) for c in [*BOX_NAMES, "mean"]})


def no_recycling(mart: DataFrame) -> DataFrame:
    return _sign_turned(_net_box(mart, F.col("burden_CO2_national"), NONE))


def _gains(mart: DataFrame, total: str = TOTAL) -> DataFrame:
    """Three columns per household, named by scheme; of no recycling, the burden itself."""
    paid = lump_sum_gain(mart, total)
    return paid.select(
        BIN, "hh_weights", F.col("net_gain").alias(LUMP_SUM), carrier_gain("electricity", total).alias(CARRIER), F.col("burden_CO2_national").alias(NONE)
    )


def all_schemes(mart: DataFrame, total: str = TOTAL) -> DataFrame:
    """Box of the net gain by quintile and scheme, all from one quantile run."""
    long = _gains(mart, total).unpivot([BIN, "hh_weights"], [LUMP_SUM, CARRIER, NONE], "category", "_gain")
    box = weighted_box(long, "_gain", "hh_weights", [BIN, "category"])
    return _sign_turned(box).select(BIN, *BOX_NAMES, "mean", "category")


def compare_schemes(mart: DataFrame, total: str = TOTAL) -> DataFrame:
    """Mean net gain, scheme by quintile: one aggregation."""
    schemes = (LUMP_SUM, CARRIER, NONE)
    means = _gains(mart, total).groupBy(BIN).agg(*[wmean(s, "hh_weights").alias(s) for s in schemes])
    turned = means.withColumn(NONE, -F.col(NONE)).unpivot([BIN], list(schemes), "category", "mean").filter("mean IS NOT NULL")
    return pivot_fill(turned, ["category"], BIN, "mean", range(1, 6), agg=F.max)
